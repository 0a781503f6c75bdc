"""Chat formatting into prefix trees.

Method.  A turn becomes ``<s>[ROLE] text</s>`` with ROLE marks that can be read back; inside a text and a role every character that could begin a
control string, and the escape itself, is preceded by a backslash, so no text can hold a control string and the form is reversible.
Conversations that begin with the same turns share them: a *node* is a distinct path of turns.  Each tree (one per first turn)
is laid out depth first, every node's tokens once.  A node has its place in the flat sequence, the position id of its first token
(the tokens of its ancestors), and the intervals of the flat sequence that its tokens attend to besides themselves.  Tokens are
the code points of the formatted text, so masks and intervals are exact to the character.

Scale.  Turns are sorted within a hash partition of conversations and read as a stream, so a conversation of any length needs no more memory than a turn.  A node is a
128-bit digest of its path; its owner is the smallest conversation that holds it.  Depth-first order is the
order of conversations by their owner runs (owner of each stretch of the path, longer stretches first), so a tree is numbered by a
distributed sort and running sums over buckets, and no task holds a tree.

Edge cases.  A null text is empty, a null role is the empty role; rows that repeat (conv_id, turn) are turns of their own, in the order of role and text;
null conv_ids form one conversation; null turns come first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import cut

# The template.
OPEN, CLOSE = "<s>", "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", "")}
OTHER = ("[ROLE:{}] ", "")
ESCAPED = regex.compile(r"([\\\[\]<>:])")
PLAIN = regex.compile(r"\\(.)", regex.DOTALL)
TURN = regex.compile(
    r"<s>(?:\[INST\] (?P<user>(?:[^\\\[\]<>:]|\\.)*) \[/INST\]|\[SYS\] (?P<system>(?:[^\\\[\]<>:]|\\.)*) \[/SYS\]|\[OUT\] (?P<assistant>(?:[^\\\[\]<>:]|\\.)*)"
    r"|\[ROLE:(?P<role>(?:[^\\\[\]<>:]|\\.)*)\] (?P<other>(?:[^\\\[\]<>:]|\\.)*))</s>",
    regex.DOTALL,
)
#: Conversations that one bucket of the depth-first numbering holds, about.
BUCKET = 5_000


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return PLAIN.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text lies in it."""
    left, right = MARKS.get(role) or (OTHER[0].format(escape(role)), OTHER[1])
    body = escape(text)
    head = OPEN + left
    return head + body + right + CLOSE, len(head), len(head) + len(body)


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    m = TURN.fullmatch(turn)
    if m is None:
        raise ValueError("not a formatted turn")
    for role in MARKS:
        if m[role] is not None:
            return role, unescape(m[role])
    return unescape(m["role"]), unescape(m["other"])


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """(conv, depth, path, turn, loss_start, loss_stop): every turn with the digest of the path that leads to it."""
    rows = conversations.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, path = object(), 0, b""
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != conv:
                    conv, depth, path = c, 0, b""
                turn, start, stop = format_turn(role, text)
                path = hashlib.blake2b(path + turn.encode(), digest_size=16).digest()
                for x, v in zip(out, (c, depth, path, turn, start if role == "assistant" else 0, stop if role == "assistant" else 0)):
                    x.append(v)
                depth += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["conv", "depth", "path", "turn", "loss_start", "loss_stop"])

    return rows.repartition(parts, "conv").sortWithinPartitions(*order).mapInArrow(
        run, "conv long, depth long, path binary, turn string, loss_start long, loss_stop long"
    )


def prefix_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (tree, path, start, length, position, turn, loss_start, loss_stop, attend) and the members (conv, depth, path).

    ``start`` is a node's place in its tree's flat sequence, ``position`` the position id of its first token, and ``attend`` the
    ancestor intervals in order.
    """
    turns = cut(formatted_turns(conversations))
    # a null conversation takes part as the smallest one
    conv = F.coalesce(F.col("conv"), F.lit(-(1 << 63)).cast("long"))
    members = turns.select("conv", conv.alias("c"), "depth", "path", F.length("turn").alias("length"))
    nodes = cut(
        turns.groupBy("path").agg(F.min(conv).alias("owner"), F.first("depth").alias("depth"), F.first("turn").alias("turn"), F.first("loss_start").alias("loss_start"), F.first("loss_stop").alias("loss_stop"))
        .withColumn("length", F.length("turn").cast("long"))
    )
    owned = members.join(nodes.select("path", "owner"), "path")
    # a conversation's path as stretches of one owner each; their number is the number of branchings on it
    stretches = cut(owned.groupBy("c", "owner").agg(F.count(F.lit(1)).alias("turns"), F.min("depth").alias("depth"), F.sum("length").alias("tokens")))
    roots = owned.where("depth = 0").select("c", F.col("path").alias("tree"))
    keys = stretches.groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("depth", "owner", "turns", "tokens"))).alias("run"),
    ).join(roots, "c")
    order = F.transform("run", lambda x: F.struct(x["owner"].alias("o"), (-x["turns"]).alias("t")))
    mine = F.filter("run", lambda x: x["owner"] == F.col("c"))
    own = keys.where(F.size(mine) > 0).select("tree", "c", order.alias("key"), F.element_at(mine, 1)["tokens"].alias("tokens"), "run")
    own = cut(own)

    # depth-first places: running sums over the owners of a tree in key order, by buckets
    n = own.count()
    buckets = max(1, n // BUCKET)
    placed = cut(own.repartitionByRange(buckets, "tree", "key").withColumn("bucket", F.spark_partition_id()))
    totals = placed.groupBy("tree", "bucket").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("tree").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("tree", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("tree", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(
        placed.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(totals, ["tree", "bucket"])
        .select("tree", "c", (F.col("base") + F.col("within")).alias("first"), "run")
    )
    # an owner's nodes follow each other: the place of one is the owner's first plus the lengths of those above it
    above = Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    laid = nodes.withColumn("above", F.coalesce(F.sum("length").over(above), F.lit(0))).join(starts.select("tree", F.col("c").alias("owner"), "first"), "owner")
    # intervals: the stretch of each owner on the path begins at that owner's first node
    walks = starts.select("c", F.posexplode("run").alias("k", "x")).select("c", "k", F.col("x.owner").alias("owner"), F.col("x.tokens").alias("tokens"))
    walks = walks.join(starts.select(F.col("c").alias("owner"), "first"), "owner").groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("k", F.col("first").alias("start"), (F.col("first") + F.col("tokens")).alias("stop")))).alias("walk")
    )
    laid = laid.join(walks.withColumnRenamed("c", "owner"), "owner")
    ancestors = F.slice("walk", 1, F.size("walk") - 1)
    spans = F.transform(ancestors, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    own_span = F.when(F.col("above") > 0, F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("above")).alias("stop")))).otherwise(
        F.array().cast("array<struct<start:long,stop:long>>")
    )
    position = F.aggregate(ancestors, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]) + F.col("above")
    tree = laid.select(
        "tree", "path", (F.col("first") + F.col("above")).alias("start"), "length", position.alias("position"), "turn", "loss_start", "loss_stop",
        F.concat(spans, own_span).alias("attend"),
    )
    return tree, members.select("conv", "depth", "path")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, parsed from the trees."""
    rows = members.join(nodes.select("path", "position", "turn", "loss_start", "loss_stop"), "path").select("conv", "depth", "position", "turn", "loss_start", "loss_stop")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, size, chars = object(), 0, 0, 0
        text = loss = None

        def done():
            values = (conv, n, text.hexdigest(), chars, loss.hexdigest(), size)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, depth, position, turn, low, high in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv or text is None:
                    if text is not None:
                        yield done()
                    conv, n, size, chars, text, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if depth != n or position != size:
                    raise ValueError(f"conversation {c}: turn {depth} at {position}, not {n} at {size}")
                role, body = parse_turn(turn)
                text.update(f"{role}\n{body}\n".encode())
                masked = unescape(turn[low:high])
                loss.update(masked.encode())
                n, size, chars = n + 1, size + len(turn), chars + len(masked)
        if text is not None:
            yield done()

    return rows.repartition(parts, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "depth").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def digests(conversations: DataFrame) -> DataFrame:
    nodes, members = prefix_trees(with_probe(conversations))
    return read_back(cut(nodes), members)
