"""License scans by ordered signature rules.

Method.  Rules are regular expressions over lower-case text, built for each license from its entry below and the hand-written forms:
its identifier tag, its names (alone, granted, versioned), its address, and sentences of its text.  A keyword prefilter comes
first: one Aho-Corasick pass names the keywords that a text holds, and only rules whose keywords are all among them run.  Detections are then
settled in the order of priority, then length, then place: one that lies inside an accepted interval, or holds one of no lower priority, is
suppressed.  What is left gives the labels; the score is the largest weight of an accepted rule.

Base labels.  Three phrases are found as consecutive words (letters, digits and characters beyond ASCII) and are never suppressed.
Words are counted with numpy on the whole text.

Edge cases.  Null and empty texts have no words, no labels and score 0.  Very long texts are scanned whole; only texts with a keyword reach the
regular expressions.  Repeated rows and ids each get a row.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.decontaminate import WORD
from tessera.llm.text import FOLD, buffers, slices, spans

# Base phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, SPDX identifiers, names (regular expressions), address, sentences of the text or usual notice.
LICENSES = [
    ("mit", ["mit", "mit-0", "x11"], ["mit licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"], r"opensource\.org/licenses?/mit",
     [r"permission is hereby granted, free of charge, to any person obtaining a copy", r"the above copyright notice and this permission notice shall be included in all copies"]),
    ("apache", ["apache-2.0", "apache-1.1", "apache-1.0"], ["apache(?: software)? licen[sc]e", "apl"], r"apache\.org/licenses?/license-[12]\.[01]",
     [r"unless required by applicable law or agreed to in writing, software distributed under the license", r"you may not use this file except in compliance with the license"]),
    ("gpl", ["gpl-1.0", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"], ["(?:gnu )?general public licen[sc]e", r"gnu gpl", r"gpl\s*v?[123]"], r"gnu\.org/licenses/(?:old-licenses/)?gpl",
     [r"this program is free software[:;] you can redistribute it", r"you should have received a copy of the gnu general public license"]),
    ("lgpl", ["lgpl-2.0", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-or-later"], ["(?:gnu )?(?:lesser|library) general public licen[sc]e", r"gnu lgpl", r"lgpl\s*v?[23]"], r"gnu\.org/licenses/(?:old-licenses/)?lgpl",
     [r"you should have received a copy of the gnu lesser general public license"]),
    ("agpl", ["agpl-1.0", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], ["(?:gnu )?affero general public licen[sc]e", r"gnu agpl", r"agpl\s*v?3"], r"gnu\.org/licenses/agpl",
     [r"you should have received a copy of the gnu affero general public license"]),
    ("gfdl", ["gfdl-1.1", "gfdl-1.2", "gfdl-1.3"], ["(?:gnu )?free documentation licen[sc]e"], r"gnu\.org/licenses/fdl", [r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free"]),
    ("bsd", ["bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"], [r"(?:new |modified |simplified |revised |[234][- ]clause )*bsd(?:[- ][234][- ]clause)? licen[sc]e", "freebsd licen[sc]e", "bsd [234][- ]clause"], r"opensource\.org/licenses?/bsd-[23]-clause",
     [r"redistribution and use in source and binary forms, with or without modification", r"neither the name of .{1,80}? nor the names of its contributors may be used"]),
    ("isc", ["isc"], ["isc licen[sc]e"], r"opensource\.org/licenses?/isc", [r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"]),
    ("zlib", ["zlib", "zlib-acknowledgement"], ["zlib(?:/libpng)? licen[sc]e"], r"zlib\.net/zlib_license", [r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors"]),
    ("mpl", ["mpl-1.0", "mpl-1.1", "mpl-2.0"], ["mozilla public licen[sc]e"], r"mozilla\.org/mpl", [r"this source code form is subject to the terms of the mozilla public"]),
    ("epl", ["epl-1.0", "epl-2.0"], ["eclipse public licen[sc]e"], r"eclipse\.org/(?:legal|org/documents)/epl-v", [r"this program and the accompanying materials are made available under the terms of the eclipse public"]),
    ("edl", ["edl-1.0"], ["eclipse distribution licen[sc]e"], r"eclipse\.org/org/documents/edl-v", []),
    ("cpl", ["cpl-1.0"], ["common public licen[sc]e"], r"opensource\.org/licenses?/cpl", []),
    ("cddl", ["cddl-1.0", "cddl-1.1"], ["common development and distribution licen[sc]e"], r"opensource\.org/licenses?/cddl", [r"the contents of this file are subject to the terms of the common development"]),
    ("eupl", ["eupl-1.0", "eupl-1.1", "eupl-1.2"], ["european union public licen[sc]e"], r"(?:joinup|interoperable-europe)\.ec\.europa\.eu/.{0,60}?eupl", [r"licensed under the eupl"]),
    ("unlicense", ["unlicense"], ["the unlicen[sc]e"], r"unlicense\.org", [r"this is free and unencumbered software released into the public domain"]),
    ("wtfpl", ["wtfpl"], ["do what the f\\S{2,3} you want to public licen[sc]e"], r"wtfpl\.net", []),
    ("boost", ["bsl-1.0"], ["boost software licen[sc]e"], r"boost\.org/license_1_0", [r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"]),
    ("busl", ["busl-1.1"], ["business source licen[sc]e"], r"mariadb\.com/bsl11", []),
    ("sspl", ["sspl-1.0"], ["server side public licen[sc]e"], r"mongodb\.com/licensing/server-side-public-license", []),
    ("elastic", ["elastic-2.0"], ["elastic licen[sc]e"], r"elastic\.co/licensing/elastic-license", []),
    ("artistic", ["artistic-1.0", "artistic-2.0"], ["(?:perl )?artistic licen[sc]e"], r"opensource\.org/licenses?/artistic", []),
    ("python", ["psf-2.0", "python-2.0"], ["python software foundation licen[sc]e", "psf licen[sc]e"], r"docs\.python\.org/\d/license", []),
    ("php", ["php-3.0", "php-3.01"], ["php licen[sc]e"], r"php\.net/license", []),
    ("ruby", ["ruby"], ["ruby licen[sc]e"], r"ruby-lang\.org/en/about/license", []),
    ("postgresql", ["postgresql"], ["postgresql licen[sc]e"], r"postgresql\.org/about/licence", []),
    ("openssl", ["openssl", "ssleay"], ["openssl licen[sc]e", "ssleay licen[sc]e"], r"openssl\.org/source/license", []),
    ("ofl", ["ofl-1.0", "ofl-1.1"], ["(?:sil )?open font licen[sc]e"], r"scripts\.sil\.org/ofl", []),
    ("cecill", ["cecill-1.0", "cecill-2.0", "cecill-2.1", "cecill-b", "cecill-c"], ["cecill(?:-[bc])?(?: free software)? licen[sc]e", "licence cecill"], r"cecill\.info", []),
    ("mulan", ["mulanpsl-1.0", "mulanpsl-2.0"], ["mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?"], r"license\.coscl\.org\.cn/mulanpsl", []),
    ("ms-pl", ["ms-pl"], ["microsoft public licen[sc]e"], r"opensource\.org/licenses?/ms-pl", []),
    ("ms-rl", ["ms-rl"], ["microsoft reciprocal licen[sc]e"], r"opensource\.org/licenses?/ms-rl", []),
    ("apsl", ["apsl-1.0", "apsl-2.0"], ["apple public source licen[sc]e"], r"opensource\.apple\.com/apsl", []),
    ("osl", ["osl-1.0", "osl-2.0", "osl-3.0"], ["open software licen[sc]e"], r"opensource\.org/licenses?/osl", []),
    ("afl", ["afl-1.1", "afl-2.0", "afl-3.0"], ["academic free licen[sc]e"], r"opensource\.org/licenses?/afl", []),
    ("ncsa", ["ncsa"], ["university of illinois/ncsa open source licen[sc]e"], r"otm\.illinois\.edu/uiuc_opensource", []),
    ("qpl", ["qpl-1.0"], ["q public licen[sc]e"], r"opensource\.org/licenses?/qpl", []),
    ("upl", ["upl-1.0"], ["universal permissive licen[sc]e"], r"oss\.oracle\.com/licenses/upl", []),
    ("odbl", ["odbl-1.0"], ["open(?: data(?:commons)?)? database licen[sc]e"], r"opendatacommons\.org/licenses/odbl", []),
    ("odc-by", ["odc-by-1.0"], ["open data commons attribution licen[sc]e"], r"opendatacommons\.org/licenses/by", []),
    ("pddl", ["pddl-1.0"], ["public domain dedication (?:and|&) licen[sc]e"], r"opendatacommons\.org/licenses/pddl", []),
    ("cc0", ["cc0-1.0"], ["cc0(?: 1\\.0)?", "cc zero", "creative commons zero"], r"creativecommons\.org/publicdomain/zero", []),
    ("cc-by-nc-nd", ["cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"], ["cc[- ]by[- ]nc[- ]nd", "creative commons attribution[- ]non-?commercial[- ]no[-\\s]?deriv\\w*"], r"creativecommons\.org/licenses/by-nc-nd", []),
    ("cc-by-nc-sa", ["cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"], ["cc[- ]by[- ]nc[- ]sa", "creative commons attribution[- ]non-?commercial[- ]share[-\\s]?alike"], r"creativecommons\.org/licenses/by-nc-sa", []),
    ("cc-by-nc", ["cc-by-nc-3.0", "cc-by-nc-4.0"], ["cc[- ]by[- ]nc", "creative commons attribution[- ]non-?commercial"], r"creativecommons\.org/licenses/by-nc", []),
    ("cc-by-nd", ["cc-by-nd-3.0", "cc-by-nd-4.0"], ["cc[- ]by[- ]nd", "creative commons attribution[- ]no[-\\s]?deriv\\w*"], r"creativecommons\.org/licenses/by-nd", []),
    ("cc-by-sa", ["cc-by-sa-3.0", "cc-by-sa-4.0"], ["cc[- ]by[- ]sa", "creative commons attribution[- ]share[-\\s]?alike"], r"creativecommons\.org/licenses/by-sa", []),
    ("cc-by", ["cc-by-3.0", "cc-by-4.0"], ["cc[- ]by", "creative commons attribution"], r"creativecommons\.org/licenses/by/", []),
    ("public-domain", [], ["dedicated to the public domain", "released into the public domain", "in the public domain"], r"creativecommons\.org/publicdomain/mark", []),
    ("proprietary", [], ["all rights reserved", "proprietary and confidential", "unauthorized copying of this file"], r"licenseref-proprietary", []),
]

# The forms around names.  A rule runs only if all of its keywords are in the text.
GRANTS = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|redistributed?)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+|a\s+)?"
VERSION = r"(?:,?\s*(?:version|ver\.?|v)?\s*\d+(?:\.\d+)?)"
LEFT, RIGHT = r"(?<![\w-])", r"(?![\w-])"


def _flexible(text: str) -> str:
    """Blanks of a pattern match any run of white space and comment marks; a blank with a quantifier stays as it is."""
    return regex.sub(r" (?![?*+{])", lambda _: r"[\s*#/]+", text.replace("[- ]", r"\W{1,3}"))


def _keywords(pattern: str) -> frozenset[str]:
    """The runs of plain letters of a pattern outside its groups: every match holds them all."""
    plain = regex.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)[*?]?|\[[^]]*\][*?]?|\{[^}]*\}|\\.|.\?", "\0", pattern)
    return frozenset(regex.findall(r"[a-z0-9]{2,}", plain))


class Rule:
    def __init__(self, label: str, priority: int, weight: float, pattern: str, keywords: frozenset[str]):
        self.label, self.priority, self.weight, self.keywords = label, priority, weight, keywords
        self.pattern = regex.compile(pattern)


def build_rules() -> list[Rule]:
    """All rules in their order: tags, addresses and sentences first, bare names last."""
    made = []
    for label, ids, names, address, sentences in LICENSES:
        for i in ids:
            tag = regex.escape(i)
            made.append(Rule(label, 0, 1.0, rf"spdx-license-identifier:?\s*{tag}{RIGHT}", frozenset(["spdx", *_keywords(i)])))
            made.append(Rule(label, 3, 0.8, rf"(?:licen[sc]e\w*\W{{1,4}}){tag}{RIGHT}", frozenset(["licen", *_keywords(i)])))
        for t in [address, *sentences]:
            made.append(Rule(label, 1, 0.95, _flexible(t), _keywords(t)))
        for name in names:
            n, own = _flexible(name), _keywords(name)
            made.append(Rule(label, 2, 0.9, GRANTS + n + VERSION + "?" + RIGHT, own | {"under"}))
            made.append(Rule(label, 4, 0.7, LEFT + n + VERSION + RIGHT, own))
            made.append(Rule(label, 5, 0.5, LEFT + n + RIGHT, own))
    return made


class Scanner:
    def __init__(self):
        self.rules = build_rules()
        self.keywords = ahocorasick.Automaton()
        for word in sorted({w for r in self.rules for w in r.keywords}):
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()
        self.base = [
            (label, regex.compile(r"(?<![0-9a-z\x80-\U0010FFFF])" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split()) + r"(?![0-9a-z\x80-\U0010FFFF])"))
            for p, label in PHRASES.items()
        ]

    def base_places(self, text: str) -> list[tuple[int, str]]:
        """(character, label) of each base phrase in a lower-cased text."""
        return [(m.start(), label) for label, p in self.base for m in p.finditer(text)]

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """All matches of the rules whose keyword occurs."""
        held = {word for _, word in self.keywords.iter(text)}
        return [(m.start(), m.end(), r) for r in self.rules if r.keywords <= held for m in r.pattern.finditer(text)] if held else []

    @staticmethod
    def settle(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
        """Accepted detections: none inside another, and none around one of higher or equal priority."""
        kept: list[tuple[int, int, Rule]] = []
        for s, e, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
            if not any((a <= s and e <= b) or (s <= a and b <= e) for a, b, _ in kept):
                kept.append((s, e, r))
        return kept


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every document."""

    def run(batches):
        scanner = Scanner()
        for b in batches:
            for part in slices(b, "text"):
                data, offsets = buffers(part.column(1))
                data = FOLD[data]
                starts, _, counts = spans(WORD[data], offsets)
                first = np.cumsum(counts) - counts
                n_base, low, high, base, labels, score, found = ([] for _ in range(7))
                for k in range(len(counts)):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    places = scanner.base_places(text) if "license" in text else []
                    kept = scanner.settle(scanner.detections(text))
                    own = {label for _, label in places}
                    more = own | {r.label for _, _, r in kept}
                    at = sorted(int(np.searchsorted(starts, offsets[k] + len(text[:c].encode())) - first[k]) for c, _ in places)
                    n_base.append(len(places)), low.append(at[0] if at else None), high.append(at[-1] if at else None)
                    base.append(",".join(sorted(own))), labels.append(",".join(sorted(more)))
                    score.append(max([r.weight for _, _, r in kept] + [0.9] * bool(places), default=0.0))
                    found.append([{"label": r.label, "priority": r.priority, "start": s, "stop": e} for s, e, r in sorted(kept, key=lambda x: x[:2])])
                kind = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(n_base, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                     pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(found, kind)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,priority:int,start:long,stop:long>>"
    )
