"""Registered queries over the star-schema tables, each with SQL for the same result.

Roles: a line item plays one measured cell (its supplier is the scene, its return flag the
treatment), an embedding plays an 8 x 8 image, events play track points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sizes, text
from tessera.operators import diagnostics, prefix, summary, tables, tracking
from tessera.operators import pixels as px

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


MEASURES = ["q", "v", "dsc", "tax"]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("ds"), F.col("l_suppkey") % 5).alias("source_dataset"),
        (F.col("l_suppkey") % 5).alias("plate_num"),
        F.col("l_suppkey").alias("scene"),
        F.col("l_returnflag").alias("treatment"),
        (F.col("l_returnflag") == "N").alias("is_control"),
        (F.year("l_shipdate") - 1995).alias("timepoint"),
        F.expr("chr(65 + l_partkey % 8)").alias("well_row"),
        (F.col("l_partkey") % 12 + 1).alias("well_column"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("v"),
        F.col("l_discount").alias("dsc"),
        F.col("l_tax").alias("tax"),
    ).withColumn("replicate", summary.replicate_key("scene", F.col("source_dataset"), F.col("scene"), None))


CELLS = """cells AS (SELECT 'ds' || (l_suppkey % 5) AS source_dataset, l_suppkey % 5 AS plate_num, l_suppkey AS scene,
  l_returnflag AS treatment, l_returnflag = 'N' AS is_control, year(l_shipdate) - 1995 AS timepoint,
  chr((65 + l_partkey % 8)::INT) AS well_row, l_partkey % 12 + 1 AS well_column,
  l_quantity AS q, l_extendedprice AS v, l_discount AS dsc, l_tax AS tax,
  'ds' || (l_suppkey % 5) || '|' || l_suppkey AS replicate FROM lineitem)"""
LONG = CELLS + """, long AS (SELECT * FROM (
  SELECT source_dataset, scene, treatment, is_control, timepoint, replicate, unnest(['q','v','dsc','tax']) AS "column",
         unnest([q, v, dsc, tax]) AS value FROM cells))"""
STATS = """count(value) AS n_cells, round(avg(value),6)+0.0 AS mean, round(stddev_samp(value),6)+0.0 AS std,
  round(quantile_cont(value,0.25),6)+0.0 AS q25, round(median(value),6)+0.0 AS median, round(quantile_cont(value,0.75),6)+0.0 AS q75"""


# ---------------------------------------------------------------- names, discovery, jobs


@register(
    "name_filter_include_exclude",
    """SELECT page_id, url FROM pages WHERE (contains(lower(url),'a') OR contains(lower(url),'page'))
       AND NOT contains(lower(url),'9')""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.where(text.name_filter(F.col("url"), ["A", "PAGE"], ["9"])).select("page_id", "url")


@register(
    "name_filter_regex",
    """SELECT page_id, url FROM pages WHERE regexp_matches(url,'[0-4]$') AND NOT regexp_matches(url,'1[0-9]$')""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    keep = text.name_filter(F.col("url"), ["[0-4]$"], ["1[0-9]$"], regex=True, case_sensitive=True)
    return p.where(keep).select("page_id", "url")


FILE_NAMES = """names AS (SELECT doc_id, source || '_' || doc_id ||
  CASE doc_id % 7 WHEN 0 THEN '.OME.tif' WHEN 1 THEN '.tif' WHEN 2 THEN '.lif' WHEN 3 THEN '.czi' WHEN 4 THEN '.nd2'
    WHEN 5 THEN '.ome.tiff' ELSE '.txt' END AS name FROM documents)"""


def file_names(spark, sf):
    d = table(spark, sf, "documents")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in (".OME.tif", ".tif", ".lif", ".czi", ".nd2", ".ome.tiff", ".txt")]),
        (F.col("doc_id") % 7 + 1).cast("int"),
    )
    return d.select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext).alias("name"))


@register(
    "format_census",
    f"""WITH {FILE_NAMES} SELECT format, count(*) AS n_files FROM (SELECT CASE
      WHEN lower(name) LIKE '%.ome.tif' OR lower(name) LIKE '%.ome.tiff' THEN 'ome.tif'
      WHEN lower(name) LIKE '%.tif' OR lower(name) LIKE '%.tiff' THEN 'tif' WHEN lower(name) LIKE '%.lif' THEN 'lif'
      WHEN lower(name) LIKE '%.czi' THEN 'czi' WHEN lower(name) LIKE '%.nd2' THEN 'nd2' END AS format FROM names)
      WHERE format IS NOT NULL GROUP BY format""",
)
def _(spark, sf):
    f = file_names(spark, sf).select(text.format_of(F.col("name")).alias("format"))
    return f.where("format is not null").groupBy("format").agg(F.count(F.lit(1)).alias("n_files"))


@register(
    "file_stem_safe_name",
    f"""WITH {FILE_NAMES} SELECT doc_id,
      regexp_replace(name, '(?i)(\\.ome\\.tiff|\\.ome\\.tif|\\.tiff|\\.tif|\\.lif|\\.czi|\\.nd2|\\.txt)$', '') AS stem,
      regexp_replace('a/b:' || doc_id || '?', '[\\\\/:*?"<>|]', '_', 'g') AS safe,
      'ds_' || regexp_replace('s/' || doc_id, '[\\\\/:*?"<>|]', '_', 'g') || '_t' || lpad((doc_id % 50)::VARCHAR, 4, '0')
        AS scene_stem FROM names""",
)
def _(spark, sf):
    ident = F.col("doc_id").cast("string")
    return file_names(spark, sf).select(
        "doc_id",
        text.file_stem(F.col("name")).alias("stem"),
        text.safe_name(F.concat(F.lit("a/b:"), ident, F.lit("?"))).alias("safe"),
        text.scene_stem(F.lit("ds"), F.concat(F.lit("s/"), ident), F.col("doc_id") % 50).alias("scene_stem"),
    )


@register(
    "stem_collisions",
    """WITH f AS (SELECT doc_id, source AS parent, 'f' || (doc_id % 100) AS stem,
         '/' || source || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.tif' AS path FROM documents),
       a AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS i FROM f),
       b AS (SELECT *, CASE WHEN i = 1 THEN stem ELSE parent || '_' || stem END AS s FROM a),
       c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY i, path) AS j FROM b)
       SELECT doc_id, CASE WHEN j = 1 THEN s ELSE s || '_' || j END AS stem FROM c""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    f = d.select(
        "doc_id",
        F.concat(F.lit("f"), F.col("doc_id") % 100).alias("stem"),
        F.concat(F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".tif")).alias("path"),
    )
    return tables.disambiguate_stems(f).select("doc_id", "stem")


@register(
    "job_expansion",
    """WITH ds AS (SELECT l_suppkey % 5 AS dataset, l_suppkey AS scene FROM lineitem GROUP BY ALL),
       t AS (SELECT DISTINCT l_suppkey % 5 AS dataset, year(l_shipdate) - 1990 AS timepoint FROM lineitem)
       SELECT dataset, scene, timepoint FROM ds JOIN t USING (dataset) WHERE scene % 3 <> 0""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("dataset"), F.col("l_suppkey").alias("scene"),
        (F.year("l_shipdate") - 1990).alias("timepoint"),
    )
    # the scenes and timepoints of one file are short lists
    ds = li.groupBy("dataset").agg(
        F.collect_set("scene").alias("scenes"), F.collect_set("timepoint").alias("timepoints")
    )
    jobs = tables.expand_jobs(ds.withColumn("scenes", F.filter("scenes", lambda s: s % 3 != 0)))
    return jobs.withColumn("timepoint", F.col("timepoint").cast("bigint"))


@register(
    "pending_jobs_manifest",
    """SELECT conv_id, turn FROM conversations WHERE NOT EXISTS (SELECT 1 FROM conversations d
       WHERE d.role = 'assistant' AND d.conv_id = conversations.conv_id AND d.turn = conversations.turn)""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return tables.pending_jobs(c.select("conv_id", "turn"), c.where("role = 'assistant'"), ["conv_id", "turn"])


@register(
    "skip_limit_sorted",
    "SELECT url FROM pages ORDER BY url OFFSET 10 LIMIT 25",
)
def _(spark, sf):
    return tables.sorted_slice(table(spark, sf, "pages").select("url"), ["url"], 10, 25)


@register(
    "evenly_spaced_sample",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders),
       want AS (SELECT DISTINCT round_even(i * (n - 1) / 39.0, 0)::BIGINT AS rn
                FROM (SELECT max(n) AS n FROM r), (SELECT unnest(range(40)) AS i))
       SELECT o_orderkey FROM r JOIN want USING (rn)""",
)
def _(spark, sf):
    return tables.evenly_spaced(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 40)


@register(
    "parse_well",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr((65 + doc_id % 8)::INT) WHEN doc_id % 3 = 1 THEN chr((65 + doc_id % 16)::INT) END AS well_row,
       CASE WHEN doc_id % 3 = 0 THEN (doc_id % 12 + 1)::VARCHAR WHEN doc_id % 3 = 1 THEN (doc_id % 32 + 1)::VARCHAR END AS well_column
       FROM documents""",
)
def _(spark, sf):
    k = F.col("doc_id")
    scene = F.when(
        k % 3 == 0, F.expr("concat('plate/', chr(65 + doc_id % 8), '/', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '_Merged')")
    ).otherwise(F.lit("Image:0"))
    file = F.when(k % 3 == 1, F.expr("concat('exp_', chr(97 + doc_id % 16), cast(doc_id % 32 + 1 as string), '_x.czi')")).otherwise(
        F.lit("scan.czi")
    )
    return table(spark, sf, "documents").select("doc_id", text.parse_well(scene, file).alias("w")).select(
        "doc_id", F.col("w.row").alias("well_row"), F.col("w.col").alias("well_column")
    )


@register(
    "parse_dataset_name",
    """SELECT o_orderkey, (CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 17 END)::DOUBLE AS plate,
       (CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 7 END)::DOUBLE AS sample,
       (CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 3 WHEN o_orderkey % 5 < 4 THEN 0 END)::DOUBLE AS rescan FROM orders""",
)
def _(spark, sf):
    name = F.expr(
        """case when o_orderkey % 5 < 2 then concat('run_Plate', o_orderkey % 17, '_Sample', o_orderkey % 7, '_', o_orderkey % 3)
                when o_orderkey % 5 < 4 then concat('run_Plate', o_orderkey % 17, '_Sample', o_orderkey % 7) else 'abc' end"""
    )
    got = text.parse_dataset(F.col("name"))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name")).select(
        "o_orderkey", *[c.cast("double").alias(n) for n, c in got.items()]
    )


@register(
    "value_normalise",
    """SELECT p_partkey, (p_size)::VARCHAR AS whole, CASE WHEN p_retailprice = floor(p_retailprice)
         THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS price, trim(' ' || p_brand || ' ') AS brand,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size::VARCHAR END AS grp FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        text.normal_value(F.col("p_size").cast("double"), True).alias("whole"),
        text.normal_value(F.col("p_retailprice"), True).alias("price"),
        text.normal_value(F.concat(F.lit(" "), "p_brand", F.lit(" ")), False).alias("brand"),
        text.group_value(
            F.when(F.col("p_partkey") % 4 == 0, F.lit("NaN")).otherwise(F.col("p_size").cast("string")), False
        ).alias("grp"),
    )


@register(
    "row_index_and_tokens",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 100 < 26 THEN s_suppkey % 100 ELSE
         26 + (s_suppkey % 100 - 26) END AS row_index,
       regexp_replace(regexp_replace(s_name || ' (x)/', '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS token,
       'g' || lpad(s_suppkey::VARCHAR, 18, '0') || 'b' AS sort_key FROM supplier""",
)
def _(spark, sf):
    k = F.col("s_suppkey") % 100
    letters = F.when(k < 26, F.expr("chr(65 + s_suppkey % 100)")).otherwise(
        F.expr("concat(chr(64 + cast(floor((s_suppkey % 100) / 26) as int)), chr(65 + (s_suppkey % 100) % 26))")
    )
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        text.row_index(letters).cast("bigint").alias("row_index"),
        text.safe_token(F.concat("s_name", F.lit(" (x)/"))).alias("token"),
        text.natural_key(F.concat(F.lit("G"), F.col("s_suppkey").cast("string"), F.lit("b"))).alias("sort_key"),
    )


@register(
    "nonconfluent_filter_keeps_null",
    """SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'True' WHEN 0 THEN 'False' END AS flag,
       coalesce(l.toxic = 1, false) AS control FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE l.quality IS NULL OR l.quality <> 0""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    flag = F.when(F.col("quality") == 1, "True").when(F.col("quality") == 0, "False")
    return d.select("doc_id", flag.alias("flag"), text.truthy(F.col("toxic").cast("string")).alias("control")).where(
        text.not_nonconfluent(F.col("flag"))
    )


@register(
    "first_group_label",
    """SELECT p_brand AS grp, p_brand || ' · ' || min_by(p_type, p_partkey) AS label FROM part GROUP BY p_brand""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), "p_type", "p_partkey")
    lab = tables.first_known(p, ["grp"], "p_type", ["p_partkey"])
    return lab.select("grp", text.display_label(F.col("grp"), F.col("p_type")).alias("label"))


# ---------------------------------------------------------------- metadata, controls, unions


@register(
    "control_flag",
    f"""WITH {CELLS} SELECT treatment, well_row || well_column AS well, count(*) AS n,
        (treatment IN ('N') OR well_row || well_column IN ('A1','C7')) AS is_control FROM cells GROUP BY ALL""",
)
def _(spark, sf):
    well = text.well_id(F.col("well_row"), F.col("well_column"))
    flag = tables.control_flag(F.col("treatment"), F.col("well"), ["N "], ["a01", "C07"])
    return (
        cells(spark, sf).withColumn("well", well).withColumn("is_control", flag)
        .groupBy("treatment", "well", "is_control").agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "plate_map_lookup",
    """WITH pm AS (SELECT p_partkey % 5 AS plate, chr((65 + (p_partkey // 5) % 8)::INT) || ((p_partkey // 40) % 12 + 1) AS well_id,
         p_size::VARCHAR AS treatment, p_partkey FROM part),
       one AS (SELECT plate, well_id, min_by(treatment, p_partkey) AS treatment FROM pm GROUP BY ALL),
       comp AS (SELECT s_suppkey::VARCHAR AS treatment, n_name AS source_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
       full_map AS (SELECT one.*, source_name FROM one LEFT JOIN comp USING (treatment))
       SELECT l.l_suppkey % 5 AS plate_num, chr((65 + l_partkey % 8)::INT) || (l_partkey % 12 + 1) AS well_id,
         m.treatment, m.source_name, count(*) AS n
       FROM lineitem l LEFT JOIN full_map m ON m.plate = l.l_suppkey % 5
         AND m.well_id = chr((65 + l_partkey % 8)::INT) || (l_partkey % 12 + 1) GROUP BY ALL""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(
        (F.col("p_partkey") % 5).alias("Plate"),
        F.expr("chr(65 + (p_partkey div 5) % 8)").alias("well_row"),
        F.expr("(p_partkey div 40) % 12 + 1").cast("double").alias("well_column"),
        F.col("p_size").cast("double").alias("Treatment"), "p_partkey",
    )
    plates = part.groupBy("Plate", "well_row", "well_column").agg(F.min_by("Treatment", "p_partkey").alias("Treatment"))
    comp = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").cast("double").alias("Treatment"), F.col("n_name").alias("Source Name"))
    pm = tables.build_plate_map(plates, comp)
    c = cells(spark, sf).drop("treatment").withColumn("well_id", text.well_id(F.col("well_row"), F.col("well_column")))
    # cells are counted per well before the lookup; the key is unique, which is checked
    per_well = c.groupBy("plate_num", "well_id").agg(F.count(F.lit(1)).alias("n"))
    out = tables.add_plate_metadata(per_well, pm, ["Treatment", "Source Name"])
    return out.select("plate_num", "well_id", F.col("Treatment").alias("treatment"), F.col("Source Name").alias("source_name"), "n")


@register(
    "latest_rescan",
    """WITH s AS (SELECT CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS plate, o_custkey % 3 AS sample,
         year(o_orderdate) AS rescan, o_orderkey AS discovery_index FROM orders)
       SELECT plate::DOUBLE AS plate, sample, rescan, discovery_index FROM (SELECT *, row_number() OVER (PARTITION BY plate, sample
         ORDER BY rescan DESC, discovery_index DESC) AS rn FROM s WHERE plate IS NOT NULL) WHERE rn = 1
       UNION ALL SELECT plate::DOUBLE, sample, rescan, discovery_index FROM s WHERE plate IS NULL""",
)
def _(spark, sf):
    s = table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")).alias("plate"),
        (F.col("o_custkey") % 3).alias("sample"),
        F.year("o_orderdate").cast("bigint").alias("rescan"),
        F.col("o_orderkey").alias("discovery_index"),
    )
    return tables.latest_rescans(s).withColumn("plate", F.col("plate").cast("double"))


@register(
    "rescan_by_discovery",
    """WITH f AS (SELECT o_orderkey % 2 AS layout, 'run' || (o_orderkey % 5) || CASE WHEN o_custkey % 10 > 0 THEN '_Plate' || (o_custkey % 40) || '_Sample' || (o_custkey % 3) ELSE '_other' END
           || CASE WHEN o_orderkey % 7 > 2 THEN '_' || (o_orderkey % 7) ELSE '' END AS dataset, o_orderkey AS path FROM orders),
         d AS (SELECT dataset, min(layout) AS layout, arg_min(path, layout * 1000000000 + path) AS path FROM f GROUP BY dataset),
         p AS (SELECT *, regexp_extract(dataset, 'Plate([0-9]+)', 1) AS plate, regexp_extract(dataset, 'Sample([0-9]+)', 1) AS sample,
           coalesce(try_cast(regexp_extract(dataset, 'Sample[0-9]+_([0-9]+)', 1) AS BIGINT), 0) AS rescan FROM d)
       SELECT dataset, path FROM p WHERE plate = ''
       UNION ALL SELECT dataset, path FROM (SELECT *, row_number() OVER (PARTITION BY plate, sample ORDER BY rescan DESC, layout DESC, dataset DESC) AS n FROM p WHERE plate <> '') WHERE n = 1""",
)
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scan = F.when(c % 10 > 0, F.concat(F.lit("_Plate"), c % 40, F.lit("_Sample"), c % 3)).otherwise("_other")
    name = F.concat(F.lit("run"), k % 5, scan, F.when(k % 7 > 2, F.concat(F.lit("_"), k % 7)).otherwise(""))
    found = tables.discovered(table(spark, sf, "orders").select((k % 2).alias("layout"), name.alias("dataset"), k.alias("path")))
    parsed = text.parse_dataset(F.col("dataset"), text.DATASET_PATTERN)
    scans = found.select(*[x.alias(n) for n, x in parsed.items()], "dataset", "path", "discovery_index")
    return tables.latest_rescans(scans).select("dataset", "path")


@register(
    "union_by_name_missing_columns",
    """SELECT kind, nation, count(*) AS n, round(sum(acct),6)+0.0 AS acct, count(segment) AS n_segment FROM (
         SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS acct, c_mktsegment AS segment FROM customer
         UNION ALL SELECT 's', s_nationkey, s_acctbal, NULL FROM supplier) GROUP BY kind, nation""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acct"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf, "supplier").select(
        F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acct")
    )
    return tables.union_tables([c, s]).groupBy("kind", "nation").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("acct")).alias("acct"), F.count("segment").alias("n_segment")
    )


def _zscore_sql(ref: str) -> str:
    over = f"(PARTITION BY {ref})" if ref else "()"
    return f"""WITH {CELLS}, z AS (SELECT *, avg(CASE WHEN is_control THEN v END) OVER {over} AS m,
      stddev_samp(CASE WHEN is_control THEN v END) OVER {over} AS s FROM cells)
      SELECT source_dataset, treatment, count(*) AS n, round(avg((v-m)/s),6)+0.0 AS z_mean,
        round(stddev_samp((v-m)/s),6)+0.0 AS z_sd, round(max((v-m)/s),6)+0.0 AS z_max FROM z GROUP BY 1, 2"""


def _zscore(ref):
    def run(spark, sf):
        z = tables.zscores(cells(spark, sf), ["v"], ref)
        return z.groupBy("source_dataset", "treatment").agg(
            F.count(F.lit(1)).alias("n"), r6(F.avg("Zscore_v")).alias("z_mean"),
            r6(F.stddev_samp("Zscore_v")).alias("z_sd"), r6(F.max("Zscore_v")).alias("z_max"),
        )

    return run


register("zscore_dataset", _zscore_sql("source_dataset"))(_zscore(["source_dataset"]))
register("zscore_plate", _zscore_sql("plate_num"))(_zscore(["plate_num"]))
register("zscore_all", _zscore_sql(""))(_zscore([]))


@register(
    "upsert_scene_timepoint",
    """SELECT src, conv_id AS scene, turn AS timepoint, length(text) AS n FROM (
         SELECT 'old' AS src, * FROM conversations WHERE turn % 2 = 1
         UNION ALL SELECT 'new' AS src, * FROM conversations WHERE turn % 2 = 0)""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("scene"), F.col("turn").alias("timepoint"), F.length("text").cast("bigint").alias("n")
    )
    old = c.withColumn("src", F.lit("old"))
    new = c.where("timepoint % 2 = 0").withColumn("src", F.lit("new"))
    return tables.upsert_scenes(old, new).select("src", "scene", "timepoint", "n")


@register(
    "upsert_done_without_rows",
    """SELECT conv_id, turn, role FROM conversations WHERE turn % 3 <> 0""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return tables.upsert(c, c.limit(0), ["conv_id", "turn"], done=c.where("turn % 3 = 0"))


# ---------------------------------------------------------------- statistics


@register(
    "group_summary",
    f"""WITH {LONG} SELECT "column", treatment, {STATS} FROM long GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(summary.describe_groups(_long(spark, sf, ["treatment"]), ["column", "treatment"]))


@register(
    "group_summary_spread",
    f"""WITH {LONG} SELECT "column", treatment, {STATS} FROM long GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(summary.describe_groups(_long(spark, sf, ["treatment"]), ["column", "treatment"], spread=True))


def _long(spark, sf, keys):
    return summary.long_values(cells(spark, sf), keys, MEASURES)


def _rounded(df, skip=()):
    return df.select(
        *[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
          for f in df.schema.fields]
    )


@register(
    "replicate_summary",
    f"""WITH {LONG}, m AS (SELECT "column", treatment, replicate, median(value) AS med FROM long GROUP BY ALL)
      SELECT "column", treatment, count(med) AS n_replicates, round(avg(med),6)+0.0 AS replicate_median_mean,
        round(stddev_samp(med),6)+0.0 AS replicate_median_sd FROM m GROUP BY ALL""",
)
def _(spark, sf):
    med = summary.replicate_medians(cells(spark, sf), ["treatment"], MEASURES, "replicate")
    return _rounded(summary.describe_replicates(med, ["column", "treatment"]).drop("replicate_median_var"))


@register(
    "control_comparison",
    f"""WITH {LONG}, c AS (SELECT "column", median(value) AS cm FROM long WHERE is_control GROUP BY ALL),
      g AS (SELECT "column", treatment, median(value) AS gm FROM long GROUP BY ALL)
      SELECT "column", treatment, round(gm/nullif(cm,0),6)+0.0 AS median_ratio_vs_ctrl, round(gm-cm,6)+0.0 AS median_diff_vs_ctrl
      FROM g JOIN c USING ("column")""",
)
def _(spark, sf):
    long = _long(spark, sf, ["treatment", "is_control"])
    g = prefix.quantiles(long, ["column", "treatment"], "value", {"gm": 0.5})
    c = prefix.quantiles(long.where("is_control"), ["column"], "value", {"cm": 0.5})
    return _rounded(g.join(c, "column").select(
        "column", "treatment", F.try_divide("gm", "cm").alias("median_ratio_vs_ctrl"), (F.col("gm") - F.col("cm")).alias("median_diff_vs_ctrl")
    ))


RANKS = """pairs AS (SELECT DISTINCT treatment AS g FROM cells WHERE NOT is_control),
  obs AS (SELECT g, "column", value, NOT is_control AS mine FROM pairs JOIN long ON is_control OR treatment = g),
  tab AS (SELECT g, "column", value, count(*) AS t, count_if(mine) AS t1 FROM obs GROUP BY ALL),
  run AS (SELECT *, sum(t) OVER (PARTITION BY g, "column" ORDER BY value) - t AS below FROM tab),
  u AS (SELECT g AS treatment, "column", sum(t1)::DOUBLE AS n1, sum(t-t1)::DOUBLE AS n2,
    sum((below + (t+1)/2.0) * t1) - sum(t1)::DOUBLE*(sum(t1)::DOUBLE+1)/2 AS u,
    sum(t::DOUBLE*t*t - t) AS tie FROM run GROUP BY ALL)"""
ZED = """(greatest(u, n1*n2-u) - n1*n2/2 - 0.5) / sqrt(n1*n2/12*((n1+n2+1) - tie/((n1+n2)*(n1+n2-1))))"""


@register(
    "mannwhitney_u",
    f"""WITH {LONG}, {RANKS} SELECT "column", treatment, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u,6)+0.0 AS u, round(tie,6)+0.0 AS tie_term,
      round({ZED},6)+0.0 AS z FROM u""",
)
def _(spark, sf):
    r = summary.rank_sums(_long(spark, sf, ["treatment", "is_control"]), "treatment", F.col("is_control"), spread=True)
    z = summary.rank_sum_z(*[F.col(c) for c in ("u", "n1", "n2", "tie_term")])
    return _rounded(r.withColumn("z", z))


@register(
    "mannwhitney_p",
    f"""WITH {LONG}, {RANKS}, z AS (SELECT "column", treatment, abs({ZED})/sqrt(2) AS x FROM u)
      SELECT "column", treatment, round(CASE WHEN x > 6 THEN 0 ELSE 1 - 2/sqrt(pi())*exp(-x*x)*list_sum(list_transform(range(0,250),
        lambda n: exp(2*n*ln(2) + (2*n+1)*ln(greatest(x,1e-300)) - lgamma(2*n+2) + lgamma(n+1)))) END,6)+0.0 AS p FROM z""",
)
def _(spark, sf):
    r = summary.rank_sums(_long(spark, sf, ["treatment", "is_control"]), "treatment", F.col("is_control"))
    p = summary.rank_sum_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie_term"))
    return _rounded(r.select("column", "treatment", p.alias("p")))


WELCH = """m AS (SELECT "column", treatment, is_control, replicate, median(value) AS med FROM long GROUP BY ALL),
  s AS (SELECT "column", treatment, is_control, avg(med) AS a, var_samp(med) AS v, count(*)::DOUBLE AS n FROM m GROUP BY ALL),
  w AS (SELECT g."column", g.treatment, g.a AS ga, c.a AS ca, g.v/g.n AS gv, c.v/c.n AS cv, g.n AS gn, c.n AS cn
    FROM s g JOIN s c ON g."column" = c."column" AND c.is_control AND NOT g.is_control),
  td AS (SELECT "column", treatment, (ga-ca)/sqrt(gv+cv) AS t, (gv+cv)*(gv+cv)/(gv*gv/(gn-1)+cv*cv/(cn-1)) AS df FROM w)"""


def _welch_td(spark, sf):
    med = summary.replicate_medians(cells(spark, sf), ["treatment", "is_control"], MEASURES, "replicate")
    s = summary.describe_replicates(med, ["column", "treatment", "is_control"])
    c = s.where("is_control").select(
        "column", F.col("replicate_median_mean").alias("cm"), F.col("replicate_median_var").alias("cv"), F.col("n_replicates").alias("cn")
    )
    t, df = summary.welch(
        F.col("replicate_median_mean"), F.col("replicate_median_var"), F.col("n_replicates"), F.col("cm"), F.col("cv"), F.col("cn")
    )
    return s.where("not is_control").join(c, "column").select("column", "treatment", t.alias("t"), df.alias("df"))


@register(
    "welch_t",
    f"""WITH {LONG}, {WELCH} SELECT "column", treatment, round(t,6)+0.0 AS t, round(df,6)+0.0 AS df FROM td""",
)
def _(spark, sf):
    return _rounded(_welch_td(spark, sf))


def _beta_series(a, b, x):
    return f"""exp({a}*ln({x}) + {b}*ln(1-({x})) + lgamma({a}+{b}) - lgamma({a}) - lgamma({b})) / ({a}) *
      (1 + list_sum(list_transform(range(0,4000), lambda n: exp(lgamma({a}+1) + lgamma({a}+{b}+n+1) - lgamma({a}+n+2) - lgamma({a}+{b}) + (n+1)*ln({x})))))"""


@register(
    "welch_p",
    f"""WITH {LONG}, {WELCH}, x AS (SELECT *, df/(df+t*t) AS x, df/2 AS a FROM td)
      SELECT "column", treatment, round(CASE WHEN x <= (a+1)/(a+2.5) THEN {_beta_series('a', '0.5', 'x')}
        ELSE 1 - ({_beta_series('0.5', 'a', '(t*t/(df+t*t))')}) END,6)+0.0 AS p FROM x""",
)
def _(spark, sf):
    td = _welch_td(spark, sf)
    return _rounded(td.select("column", "treatment", summary.welch_p("t", "df").alias("p")))


def _bh_input(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand",
        F.when(F.col("p_partkey") % 11 > 0, F.round(F.col("p_retailprice") % 100 / 100, 4)).alias("p"),
    )


BH = """WITH b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 > 0 THEN round(p_retailprice % 100 / 100, 4) END AS p FROM part),
  r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p) AS k
        FROM b WHERE p IS NOT NULL),
  q AS (SELECT p_partkey, least(1, min(k) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
  SELECT b.p_partkey, b.p, round(q.q,6)+0.0 AS q FROM b LEFT JOIN q USING (p_partkey)"""


@register("bh_adjust", BH)
def _(spark, sf):
    return _rounded(summary.adjust_p(_bh_input(spark, sf), ["p_brand"], "p", "q").select("p_partkey", "p", "q"), ("p",))


@register("bh_adjust_spread", BH)
def _(spark, sf):
    return _rounded(summary.adjust_p(_bh_input(spark, sf), ["p_brand"], "p", "q", spread=True).select("p_partkey", "p", "q"), ("p",))


def _erfc_tail(x: str) -> str:
    return f"""CASE WHEN {x} > 6 THEN 0 ELSE least(1, 1 - 2/sqrt(pi())*exp(-{x}*{x})*list_sum(list_transform(range(0,250),
        lambda n: exp(2*n*ln(2) + (2*n+1)*ln(greatest({x},1e-300)) - lgamma(2*n+2) + lgamma(n+1))))) END"""


SUMMARY = f"""WITH {LONG}, {RANKS}, {WELCH},
  g AS (SELECT "column", treatment, bool_or(is_control) AS is_control, count(value) AS n_cells, avg(value) AS mean, median(value) AS median,
    stddev_samp(value) AS std, quantile_cont(value,0.25) AS q25, quantile_cont(value,0.75) AS q75 FROM long GROUP BY ALL HAVING count(*) >= 20),
  r AS (SELECT "column", treatment, count(*) AS n_replicates, avg(med) AS rm, stddev_samp(med) AS rs FROM m GROUP BY ALL),
  c AS (SELECT "column", median(value) AS cm FROM long WHERE is_control GROUP BY ALL),
  z AS (SELECT "column", treatment, {_erfc_tail('abs(' + ZED + ')/sqrt(2)')} AS p FROM u),
  x AS (SELECT *, df/(df+t*t) AS x, df/2 AS a FROM td),
  b AS (SELECT "column", treatment, CASE WHEN x <= (a+1)/(a+2.5) THEN {_beta_series('a', '0.5', 'x')} ELSE 1 - ({_beta_series('0.5', 'a', '(t*t/(df+t*t))')}) END AS p FROM x),
  f AS (SELECT g.*, n_replicates, rm, rs, cm, z.p AS pc, b.p AS pr FROM g JOIN r USING ("column", treatment) JOIN c USING ("column")
    LEFT JOIN z USING ("column", treatment) LEFT JOIN b USING ("column", treatment)),
  k AS (SELECT *, CASE WHEN pc IS NOT NULL THEN pc * count(pc) OVER (PARTITION BY "column") / rank() OVER (PARTITION BY "column" ORDER BY pc NULLS LAST) END AS kc,
    CASE WHEN pr IS NOT NULL THEN pr * count(pr) OVER (PARTITION BY "column") / rank() OVER (PARTITION BY "column" ORDER BY pr NULLS LAST) END AS kr FROM f),
  q AS (SELECT *, min(kc) OVER (PARTITION BY "column" ORDER BY pc NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qc,
    min(kr) OVER (PARTITION BY "column" ORDER BY pr NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qr FROM k)
  SELECT 'treatment' AS group_by, treatment AS "group", "column", is_control, n_cells, n_replicates, round(mean,6)+0.0 AS mean, round(median,6)+0.0 AS median,
    round(std,6)+0.0 AS std, round(q25,6)+0.0 AS q25, round(q75,6)+0.0 AS q75, round(rm,6)+0.0 AS replicate_median_mean, round(rs,6)+0.0 AS replicate_median_sd,
    round(median/nullif(cm,0),6)+0.0 AS median_ratio_vs_ctrl, round(median-cm,6)+0.0 AS median_diff_vs_ctrl, round(pc,6)+0.0 AS p_cells_mannwhitney,
    round(pr,6)+0.0 AS p_replicates_welch, CASE WHEN pc IS NOT NULL THEN round(least(1,qc),6)+0.0 END AS "q_cells_BH",
    CASE WHEN pr IS NOT NULL THEN round(least(1,qr),6)+0.0 END AS "q_replicates_BH" FROM q"""


@register("summary_statistics", SUMMARY)
def summary_statistics(spark, sf):
    out = summary.summarise(cells(spark, sf), "treatment", MEASURES, "replicate", min_cells=20)
    return _rounded(out)


@register(
    "robust_shift",
    f"""WITH {LONG}, med AS (SELECT "column", median(value) AS m FROM long WHERE is_control GROUP BY ALL),
      mad AS (SELECT "column", median(abs(value - m)) AS d, stddev_samp(value) AS s FROM long JOIN med USING ("column") WHERE is_control GROUP BY ALL)
      SELECT treatment, "column", round((median(value) - any_value(m)) / any_value(coalesce(nullif(1.4826*d,0), nullif(s,0), 1)),6)+0.0 AS shift
      FROM long JOIN med USING ("column") JOIN mad USING ("column") GROUP BY treatment, "column" """,
)
def _(spark, sf):
    return _rounded(summary.robust_shift(cells(spark, sf), "treatment", MEASURES))


@register(
    "plate_heatmap",
    f"""WITH {CELLS} SELECT 'v' AS "column", 'Plate ' || plate_num AS plate_name, (ascii(well_row) - 65)::BIGINT AS plate_row,
      (well_column - 1)::BIGINT AS plate_col, round(median(v),6)+0.0 AS median FROM cells GROUP BY ALL""",
)
def _(spark, sf):
    m = summary.plate_medians(cells(spark, sf), ["v"])
    return m.select("column", "plate_name", F.col("plate_row").cast("bigint").alias("plate_row"),
                    F.col("plate_col").cast("bigint").alias("plate_col"), r6("median").alias("median"))


@register(
    "heatmap_limits",
    f"""WITH {CELLS}, m AS (SELECT plate_num, well_row, well_column, median(v) AS v, median(q) AS q FROM cells GROUP BY ALL),
      l AS (SELECT 'v' AS "column", v AS x FROM m UNION ALL SELECT 'q', q FROM m)
      SELECT "column", round(quantile_cont(x,0.02),6)+0.0 AS low, round(quantile_cont(x,0.98),6)+0.0 AS high FROM l GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(summary.heatmap_limits(summary.plate_medians(cells(spark, sf), ["v", "q"])))


@register(
    "time_course",
    f"""WITH {LONG} SELECT "column", treatment, timepoint::INT AS timepoint, round(quantile_cont(value,0.25),6)+0.0 AS q25,
      round(quantile_cont(value,0.5),6)+0.0 AS q50, round(quantile_cont(value,0.75),6)+0.0 AS q75
      FROM long GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(summary.time_course(cells(spark, sf), "treatment", MEASURES))


@register(
    "group_order_controls_first",
    f"""WITH {CELLS}, g AS (SELECT treatment, avg(is_control::INT) > 0.5 AS is_control FROM cells GROUP BY treatment)
      SELECT treatment, is_control, (row_number() OVER (ORDER BY is_control DESC, lower(treatment)))::INT AS position FROM g""",
)
def _(spark, sf):
    return summary.order_groups(cells(spark, sf), "treatment")


@register(
    "group_order_by_median",
    f"""WITH g AS (SELECT p_brand AS grp, median(p_retailprice) AS m FROM part GROUP BY p_brand)
      SELECT grp, (row_number() OVER (ORDER BY m, grp))::INT AS position FROM g""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), "p_retailprice", F.lit(False).alias("is_control"))
    return summary.order_groups(p, "grp", "median", True, "p_retailprice").select("grp", "position")


@register(
    "min_cells_filter",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice),6)+0.0 AS total FROM orders GROUP BY 1 HAVING count(*) >= 15""",
)
def _(spark, sf):
    kept = summary.keep_large_groups(table(spark, sf, "orders"), "o_custkey", 15)
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice")).alias("total"))


@register(
    "box_stats",
    f"""WITH {LONG}, q AS (SELECT "column", treatment, quantile_cont(value,0.25) AS q1, median(value) AS median, quantile_cont(value,0.75) AS q3
        FROM long GROUP BY ALL)
      SELECT "column", treatment, round(any_value(q1),6)+0.0 AS q1, round(any_value(median),6)+0.0 AS median, round(any_value(q3),6)+0.0 AS q3,
        round(min(CASE WHEN value >= q1-1.5*(q3-q1) THEN value END),6)+0.0 AS whisker_low,
        round(max(CASE WHEN value <= q3+1.5*(q3-q1) THEN value END),6)+0.0 AS whisker_high, round(avg(value),6)+0.0 AS mean
      FROM long JOIN q USING ("column", treatment) GROUP BY "column", treatment""",
)
def _(spark, sf):
    return _rounded(summary.box_stats(_long(spark, sf, ["treatment"]), ["column", "treatment"]))


@register(
    "ecdf",
    f"""WITH {CELLS} SELECT DISTINCT treatment, v AS value, round(count(*) OVER (PARTITION BY treatment ORDER BY v) /
      (count(*) OVER (PARTITION BY treatment))::DOUBLE,6)+0.0 AS share FROM cells""",
)
def _(spark, sf):
    long = cells(spark, sf).select("treatment", F.col("v").alias("value"))
    return summary.ecdf(long, ["treatment"], spread=True).withColumn("share", r6("share"))


@register(
    "axis_limits",
    f"""WITH {LONG}, q AS (SELECT "column", quantile_cont(value,0.005) AS lo, quantile_cont(value,0.995) AS hi FROM long GROUP BY ALL)
      SELECT "column", round(lo - CASE WHEN hi > lo THEN 0.05*(hi-lo) ELSE 1 END,6)+0.0 AS low,
        round(hi + CASE WHEN hi > lo THEN 0.05*(hi-lo) ELSE 1 END,6)+0.0 AS high FROM q""",
)
def _(spark, sf):
    return _rounded(summary.axis_limits(_long(spark, sf, [])))


@register(
    "histogram_bins",
    f"""WITH {CELLS}, q AS (SELECT treatment, quantile_cont(v,0.005) AS lo, quantile_cont(v,0.995) AS hi FROM cells GROUP BY ALL),
      s AS (SELECT treatment, greatest(least(lo, 500 - 0.04*(hi-lo)),0) AS lo, greatest(hi, 500 + 0.04*(hi-lo)) AS hi FROM q)
      SELECT treatment, (CASE WHEN v = hi THEN 49 ELSE floor((v-lo)/(hi-lo)*50) END)::BIGINT AS bin, count(*) AS n
      FROM cells JOIN s USING (treatment) WHERE v >= lo AND v <= hi GROUP BY ALL""",
)
def _(spark, sf):
    long = cells(spark, sf).select("treatment", F.col("v").alias("value"))
    return summary.histogram(long, ["treatment"], 50, [500.0])


@register(
    "log_histogram",
    f"""WITH {CELLS}, p AS (SELECT treatment, log10(v) AS x FROM cells WHERE v > 0),
      s AS (SELECT treatment, log10(greatest(min(v),1)) AS lo, log10(max(v)*1.05) AS hi FROM cells WHERE v > 0 GROUP BY ALL)
      SELECT treatment, (CASE WHEN x = hi THEN 48 ELSE floor((x-lo)/(hi-lo)*49) END)::BIGINT AS bin, count(*) AS n
      FROM p JOIN s USING (treatment) WHERE x >= lo AND x <= hi GROUP BY ALL""",
)
def _(spark, sf):
    long = cells(spark, sf).select("treatment", F.col("v").alias("value"))
    return summary.log_histogram(long, ["treatment"])


@register(
    "size_summary_percentiles",
    f"""WITH {LONG}, d AS (SELECT source_dataset AS dataset, "column", value FROM long WHERE "column" IN ('q','v')
        UNION ALL SELECT 'ALL FILES', "column", value FROM long WHERE "column" IN ('q','v'))
      SELECT dataset, 'cells' AS object, "column" AS measure, count(*) AS n, round(median(value),3)+0.0 AS median,
        round(quantile_cont(value,0.05),3)+0.0 AS p5, round(quantile_cont(value,0.25),3)+0.0 AS p25,
        round(quantile_cont(value,0.75),3)+0.0 AS p75, round(quantile_cont(value,0.95),3)+0.0 AS p95
      FROM d GROUP BY ALL""",
)
def _(spark, sf):
    out = summary.size_summary({"cells": (cells(spark, sf).withColumnRenamed("source_dataset", "dataset"), ["q", "v"])})
    return out.drop("mean")


@register(
    "suggestions",
    f"""WITH {CELLS}, m AS (SELECT source_dataset AS dataset, median(v) AS a, median(q) AS d FROM cells GROUP BY ALL)
      SELECT dataset, greatest(round_even(a/3/10,0)*10,10.0)::DOUBLE AS min_nucleus_size, greatest(round_even(0.35*d,0),1.0)::DOUBLE AS min_distance,
        greatest(round_even(a/3/50,0)*50,50.0)::DOUBLE AS min_label_size, greatest(round_even(d,0),1.0)::DOUBLE AS typical_nucleus_diameter,
        (round_even(a*pow(10.0,1-floor(log10(a))),0)/pow(10.0,1-floor(log10(a))))::DOUBLE AS typical_cell_area_um2 FROM m""",
)
def _(spark, sf):
    c = cells(spark, sf).withColumnRenamed("source_dataset", "dataset")
    m = prefix.quantiles(c, ["dataset"], "v", {"a": 0.5}).join(prefix.quantiles(c, ["dataset"], "q", {"d": 0.5}), "dataset")
    px_ = summary.suggestions(F.col("a"), F.col("d"), F.col("a"), F.lit(False))
    um = summary.suggestions(F.col("a"), F.col("d"), F.col("a"), F.lit(True))
    return m.select(
        "dataset",
        *[px_[k].cast("double").alias(k) for k in ("min_nucleus_size", "min_distance", "min_label_size", "typical_nucleus_diameter")],
        um["typical_cell_area"].cast("double").alias("typical_cell_area_um2"),
    )


#: Suppliers as datasets of objects: some have no pixel size, some have several.
OBJECTS = """objects AS (SELECT 'ds' || (l_suppkey % 7) AS dataset, l_quantity * 10 AS area_px,
  CASE WHEN l_suppkey % 7 = 0 AND l_linenumber = 1 THEN NULL WHEN l_suppkey % 7 < 3 THEN 0.5 ELSE 0.25 * (1 + l_linenumber % 2) END AS pixel_size_um,
  CASE WHEN l_suppkey % 7 = 6 THEN NULL ELSE (l_partkey % 3)::BIGINT END AS n_nuclei FROM lineitem),
  scoped AS (SELECT * FROM objects UNION ALL SELECT 'ALL FILES', area_px, pixel_size_um, n_nuclei FROM objects)"""


def objects(spark, sf):
    li, group, line = table(spark, sf, "lineitem"), F.col("l_suppkey") % 7, F.col("l_linenumber")
    ps = F.when((group == 0) & (line == 1), None).when(group < 3, 0.5).otherwise(0.25 * (1 + line % 2))
    o = li.select(
        F.concat(F.lit("ds"), group).alias("dataset"), (F.col("l_quantity") * 10).cast("double").alias("area_px"), ps.cast("double").alias("pixel_size_um"),
        F.when(group < 6, F.col("l_partkey") % 3).cast("bigint").alias("n_nuclei"),
    )
    return sizes.with_metric_columns(o, F.col("pixel_size_um"))


@register(
    "size_units",
    f"""WITH {OBJECTS}, u AS (SELECT dataset, bool_and(pixel_size_um IS NOT NULL) AS um, median(pixel_size_um)::DOUBLE AS pixel_size_um,
        count(DISTINCT pixel_size_um) > 1 AS several, median(area_px)::DOUBLE AS px, median(round(area_px * pixel_size_um * pixel_size_um, 3))::DOUBLE AS um2
      FROM scoped GROUP BY dataset)
      SELECT dataset, um, pixel_size_um, um AND several AS mixed, CASE WHEN um THEN 'µm' ELSE 'px' END AS length_unit, CASE WHEN um THEN 'µm²' ELSE 'px' END AS area_unit,
        round(CASE WHEN um THEN um2 ELSE px END, 3)+0.0 AS median_area FROM u""",
)
def _(spark, sf):
    o = objects(spark, sf)
    chosen = diagnostics.units({"cells": o})
    medians = prefix.quantiles(diagnostics.in_unit(o, ["area_px"], chosen), ["dataset", "measure"], "value", {"m": 0.5})
    return chosen.join(medians, "dataset").drop("measure").withColumn("median_area", F.round("m", 3) + 0.0).drop("m")


@register(
    "multinucleated_fraction",
    f"""WITH {OBJECTS} SELECT dataset, count(*) AS n, round(avg(CASE WHEN n_nuclei > 1 THEN 1.0 ELSE 0.0 END), 6)+0.0 AS fraction
      FROM scoped GROUP BY dataset HAVING count(n_nuclei) > 0""",
)
def _(spark, sf):
    return diagnostics.multinucleated(objects(spark, sf)).withColumn("fraction", r6(F.col("fraction")))


@register(
    "metric_columns_size_resolution",
    """SELECT p_partkey, round(p_size*0.1*0.1*((p_partkey % 9)+1)*((p_partkey % 9)+1),3)+0.0 AS area_um2,
       greatest(round_even(3.5/(0.1*((p_partkey % 9)+1)),0)::BIGINT,1) AS min_distance,
       greatest(round_even(100/((0.1*((p_partkey % 9)+1))*(0.1*((p_partkey % 9)+1))),0)::BIGINT,1) AS min_label_size,
       round(0.25/(0.1*((p_partkey % 9)+1)),6)+0.0 AS nuclei_sigma,
       round_even(0.3*(2048.0*2048*(0.1*((p_partkey % 9)+1))*(0.1*((p_partkey % 9)+1)))/1000,0)::BIGINT AS min_nuclei_confluent FROM part""",
)
def _(spark, sf):
    ps = 0.1 * (F.col("p_partkey") % 9 + 1)
    cols = sizes.size_columns({}, F.col("ps"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("area_px"), ps.alias("ps"))
    out = sizes.with_metric_columns(p, F.col("ps"))
    return out.select(
        "p_partkey", (F.col("area_um2") + 0.0).alias("area_um2"), cols["min_distance"].alias("min_distance"),
        cols["min_label_size"].alias("min_label_size"), r6(cols["nuclei_sigma"]).alias("nuclei_sigma"),
        sizes.confluent_count({}, F.lit(2048), F.lit(2048), F.col("ps")).alias("min_nuclei_confluent"),
    )


# ---------------------------------------------------------------- image plane as relations


def images(spark, sf, positive: bool = False):
    e = table(spark, sf, "embeddings")
    p = px.explode_image(e, ["vec_id", "label"], "embedding", 8).withColumnRenamed("label", "series")
    return p.withColumn("v", F.abs("v")) if positive else p


PIX = """pix AS (SELECT vec_id, label AS series, ((i-1)//8)::INT AS y, ((i-1)%8)::INT AS x, v FROM (
  SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS i FROM embeddings))"""
LAB = PIX + """, lab AS (SELECT vec_id, series, y, x, v, CASE WHEN v <= 0 THEN 0 ELSE (y//4)*2 + x//4 + 1 END AS l FROM pix)"""


def label_images(spark, sf):
    lab = F.when(F.col("v") <= 0, 0).otherwise((F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4) + 1).cast("int"))
    return images(spark, sf).withColumn("label", lab)


@register(
    "contact_pairs",
    f"""WITH {LAB}, s AS (SELECT a.vec_id, a.l AS l1, b.l AS l2, (a.v::DOUBLE+b.v)/2 AS e FROM lab a JOIN lab b ON a.vec_id=b.vec_id
        AND ((a.y=b.y AND b.x=a.x+1) OR (a.x=b.x AND b.y=a.y+1)) WHERE a.l>0 AND b.l>0 AND a.l<>b.l)
      SELECT vec_id, least(l1,l2)::INT AS cell_id_a, greatest(l1,l2)::INT AS cell_id_b, count(*) AS contact_px, round(avg(e),6)+0.0 AS junction_intensity
      FROM s GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(px.contacts(label_images(spark, sf), ["vec_id"], "v"))


@register(
    "neighbour_stats",
    f"""WITH {LAB}, s AS (SELECT a.vec_id, a.l AS l1, b.l AS l2 FROM lab a JOIN lab b ON a.vec_id=b.vec_id
        AND ((a.y=b.y AND abs(b.x-a.x)=1) OR (a.x=b.x AND abs(b.y-a.y)=1)) WHERE a.l>0 AND b.l>0 AND a.l<>b.l),
      o AS (SELECT DISTINCT vec_id, l FROM lab WHERE l > 0),
      n AS (SELECT vec_id, l1 AS l, count(DISTINCT l2) AS n, count(*) AS c FROM s GROUP BY ALL)
      SELECT o.vec_id, o.l::INT AS label, coalesce(n,0) AS n_neighbours, coalesce(c,0) AS contact_px FROM o LEFT JOIN n USING (vec_id, l)""",
)
def _(spark, sf):
    lab = label_images(spark, sf)
    n = px.neighbour_counts(px.contacts(lab, ["vec_id"]), ["vec_id"]).withColumnRenamed("cell_id", "label")
    objects = lab.where("label > 0").select("vec_id", "label").distinct()
    return objects.join(n, ["vec_id", "label"], "left").select(
        "vec_id", "label", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), F.coalesce("contact_px", F.lit(0)).alias("contact_px")
    )


@register(
    "adjacency_symmetric",
    f"""WITH {LAB} SELECT a.vec_id, a.l::INT AS cell_id, b.l::INT AS other_id, count(*) AS contact_px FROM lab a JOIN lab b ON a.vec_id=b.vec_id
        AND ((a.y=b.y AND abs(b.x-a.x)=1) OR (a.x=b.x AND abs(b.y-a.y)=1)) WHERE a.l>0 AND b.l>0 AND a.l<>b.l GROUP BY ALL""",
)
def _(spark, sf):
    return px.both_directions(px.contacts(label_images(spark, sf), ["vec_id"]), ["vec_id"])


OVERLAP = """fr AS (SELECT DISTINCT series, vec_id FROM lab), pr AS (SELECT series, vec_id, lag(vec_id) OVER (PARTITION BY series ORDER BY vec_id) AS p FROM fr),
  ar AS (SELECT vec_id, l, count(*) AS n FROM lab WHERE l>0 GROUP BY ALL),
  ov AS (SELECT c.series, c.vec_id AS t, pr.p AS t_prev, o.l AS a, c.l AS b, count(*) AS shared FROM lab c JOIN pr ON pr.vec_id = c.vec_id
    JOIN lab o ON o.vec_id = pr.p AND o.y = c.y AND o.x = c.x AND o.l > 0 WHERE c.l > 0 GROUP BY ALL),
  iou AS (SELECT ov.*, aa.n AS area_a, ab.n AS area_b, shared/(aa.n+ab.n-shared) AS iou FROM ov JOIN ar aa ON aa.vec_id=t_prev AND aa.l=a JOIN ar ab ON ab.vec_id=t AND ab.l=b)"""


@register(
    "frame_overlap_iou",
    f"""WITH {LAB}, {OVERLAP} SELECT series, t, t_prev, a::INT AS a, b::INT AS b, shared, area_a, area_b, round(iou,6)+0.0 AS iou,
      round(shared/area_b,6)+0.0 AS share_b FROM iou""",
)
def _(spark, sf):
    lab = label_images(spark, sf).withColumnRenamed("vec_id", "t")
    pairs = px.frame_pairs(lab, ["series"], "t")
    return _rounded(px.frame_overlaps(lab, ["series"], "t", pairs).drop("level"))


@register(
    "region_moments",
    f"""WITH {LAB}, g AS (SELECT vec_id, l, count(*) AS n, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y,x) AS c,
        (max(y)-min(y)+1)*(max(x)-min(x)+1) AS box FROM lab WHERE l>0 GROUP BY ALL),
      e AS (SELECT *, (vy+vx)/2 + sqrt(pow((vy-vx)/2,2)+c*c) AS big, greatest((vy+vx)/2 - sqrt(pow((vy-vx)/2,2)+c*c),0) AS small FROM g)
      SELECT vec_id, l::INT AS label, n AS area_px, round(cy,6)+0.0 AS centroid_y, round(cx,6)+0.0 AS centroid_x, round(4*sqrt(big),4)+0.0 AS major_axis_px,
        round(4*sqrt(round(small,9)),4)+0.0 AS minor_axis_px, round(sqrt(4*n/pi()),6)+0.0 AS equivalent_diameter_px, round(n/box,6)+0.0 AS extent FROM e""",
)
def _(spark, sf):
    r = px.regions(label_images(spark, sf), ["vec_id"])
    minor = 4 * F.sqrt(F.round(F.pow(F.col("minor_axis_px") / 4, 2), 9))
    return r.select("vec_id", "label", "area_px", r6("centroid_y").alias("centroid_y"), r6("centroid_x").alias("centroid_x"),
                    (F.round("major_axis_px", 4) + 0.0).alias("major_axis_px"), (F.round(minor, 4) + 0.0).alias("minor_axis_px"),
                    r6("equivalent_diameter_px").alias("equivalent_diameter_px"), r6("extent").alias("extent"))


@register(
    "size_border_filter",
    f"""WITH {LAB}, b AS (SELECT vec_id, l FROM lab WHERE l>0 GROUP BY ALL HAVING count(*) >= 3 AND min(y) > 0 AND min(x) > 0 AND max(y) < 7 AND max(x) < 7)
      SELECT lab.vec_id, y, x, (CASE WHEN b.l IS NULL THEN 0 ELSE lab.l END)::INT AS label FROM lab LEFT JOIN b ON b.vec_id=lab.vec_id AND b.l=lab.l""",
)
def _(spark, sf):
    return px.drop_small_and_border(label_images(spark, sf), ["vec_id"], 3, 0).select("vec_id", "y", "x", "label")


@register(
    "size_filter",
    f"""WITH {LAB}, b AS (SELECT vec_id, l FROM lab WHERE l>0 GROUP BY ALL HAVING count(*) >= 8)
      SELECT lab.vec_id, y, x, (CASE WHEN b.l IS NULL THEN 0 ELSE lab.l END)::INT AS label FROM lab LEFT JOIN b ON b.vec_id=lab.vec_id AND b.l=lab.l""",
)
def _(spark, sf):
    return px.drop_small_and_border(label_images(spark, sf), ["vec_id"], 8, None).select("vec_id", "y", "x", "label")


@register(
    "coarsen_projection",
    f"""WITH {PIX}, c AS (SELECT vec_id, series, (y//2)::INT AS y, (x//2)::INT AS x, avg(v::DOUBLE) AS v FROM pix GROUP BY ALL)
      SELECT series, y, x, round(max(v),6)+0.0 AS v FROM c GROUP BY ALL""",
)
def _(spark, sf):
    c = px.coarsen(images(spark, sf), ["series", "vec_id"], 2)
    return _rounded(px.project_z(c, ["series"], "max"))


@register(
    "background_mean_field",
    f"""WITH {PIX} SELECT y, x, round(avg(v::DOUBLE),6)+0.0 AS field FROM pix GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(px.mean_field(images(spark, sf), []))


@register(
    "flatfield_apply",
    f"""WITH {PIX}, f AS (SELECT y, x, avg(abs(v::DOUBLE)) AS f FROM pix GROUP BY ALL), m AS (SELECT avg(f) AS m FROM f)
      SELECT vec_id, round(avg((abs(v::DOUBLE)-0.01::DOUBLE)/greatest(f/m,1e-3)),6)+0.0 AS mean, round(max((abs(v::DOUBLE)-0.01::DOUBLE)/greatest(f/m,1e-3)),6)+0.0 AS peak
      FROM pix JOIN f USING (y,x), m GROUP BY vec_id""",
)
def _(spark, sf):
    p = images(spark, sf, positive=True)
    out = px.apply_field(p, px.mean_field(p, []), [], "divide", 0.01)
    return out.groupBy("vec_id").agg(r6(F.avg("v")).alias("mean"), r6(F.max("v")).alias("peak"))


@register(
    "otsu_threshold",
    f"""WITH {PIX}, e AS (SELECT vec_id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM pix GROUP BY ALL),
      h AS (SELECT vec_id, lo, hi, least(floor((v-lo)/(hi-lo)*256),255)::INT AS bin, count(*) AS n FROM pix JOIN e USING (vec_id) GROUP BY ALL),
      c AS (SELECT *, lo+(bin+0.5)*(hi-lo)/256 AS c FROM h),
      w AS (SELECT vec_id, bin, c, sum(n) OVER (PARTITION BY vec_id ORDER BY bin) AS w1, sum(n*c) OVER (PARTITION BY vec_id ORDER BY bin) AS s1,
        sum(n) OVER (PARTITION BY vec_id) AS w, sum(n*c) OVER (PARTITION BY vec_id) AS s FROM c),
      v AS (SELECT vec_id, bin, c, coalesce(round(w1*(w-w1)*pow(s1/w1-(s-s1)/nullif(w-w1,0),2),9),0) AS v FROM w)
      SELECT vec_id, round(arg_max(c, (v, -bin)),6)+0.0 AS threshold FROM v GROUP BY vec_id""",
)
def _(spark, sf):
    return _rounded(px.otsu_from_bins(px.bin_counts(images(spark, sf), ["vec_id"], 256), ["vec_id"], 256))


@register(
    "boundary_ring_stats",
    f"""WITH {LAB}, r AS (SELECT a.* FROM lab a WHERE l > 0 AND (SELECT count(*) FROM lab b WHERE b.vec_id=a.vec_id AND b.l=a.l AND abs(b.y-a.y)+abs(b.x-a.x)=1) < 4)
      SELECT vec_id, l::INT AS label, count(*) AS edge_px, round(avg(v::DOUBLE),6)+0.0 AS edge_mean, round(stddev_pop(v::DOUBLE),6)+0.0 AS edge_std,
        round(stddev_pop(v::DOUBLE)/nullif(avg(v::DOUBLE),0),6)+0.0 AS edge_cv FROM r GROUP BY ALL""",
)
def _(spark, sf):
    lab = label_images(spark, sf)
    return _rounded(px.boundary_stats(lab.drop("v", "series"), lab.select("vec_id", "y", "x", "v"), ["vec_id"]))


@register(
    "intensity_stats",
    f"""WITH {LAB} SELECT vec_id, l::INT AS label, round(avg(v::DOUBLE),6)+0.0 AS mean, round(median(v::DOUBLE),6)+0.0 AS median,
      round(stddev_pop(v::DOUBLE),6)+0.0 AS std, round(sum(v::DOUBLE),6)+0.0 AS sum FROM lab WHERE l>0 GROUP BY ALL""",
)
def _(spark, sf):
    lab = label_images(spark, sf)
    return _rounded(px.intensity(lab.drop("v", "series"), lab.select("vec_id", "y", "x", "v"), ["vec_id"]))


@register(
    "nearest_neighbour",
    f"""WITH {LAB}, c AS (SELECT vec_id, l, avg(y) AS cy, avg(x) AS cx FROM lab WHERE l>0 GROUP BY ALL)
      SELECT a.vec_id, a.l::INT AS label, round(min(sqrt(pow(a.cy-b.cy,2)+pow(a.cx-b.cx,2))),6)+0.0 AS distance
      FROM c a LEFT JOIN c b ON a.vec_id=b.vec_id AND a.l<>b.l GROUP BY ALL""",
)
def _(spark, sf):
    r = px.regions(label_images(spark, sf), ["vec_id"])
    return _rounded(px.nearest_neighbour(r, ["vec_id"], "label", first_cell=2.0))


@register(
    "percentile_normalise",
    f"""WITH {PIX}, q AS (SELECT vec_id, quantile_cont(v::DOUBLE,0.02) AS lo, quantile_cont(v::DOUBLE,0.98) AS hi FROM pix GROUP BY ALL)
      SELECT vec_id, round(avg(greatest(0,least(1,(v-lo)/(hi-lo)))),6)+0.0 AS mean, count_if(v >= hi)::BIGINT AS at_top FROM pix JOIN q USING (vec_id) GROUP BY ALL""",
)
def _(spark, sf):
    n = px.normalise_percentiles(images(spark, sf), ["vec_id"], 2, 98)
    return n.groupBy("vec_id").agg(r6(F.avg("v")).alias("mean"), F.count_if(F.col("v") >= 1).alias("at_top"))


# small groups of suppliers with values that never tie; every arrangement of a group among the controls is counted
EXACT = """s AS (SELECT (s_suppkey % (SELECT greatest(2, count(*) // 6) FROM supplier))::BIGINT AS g, round(s_acctbal * 100) * 1000000 + s_suppkey AS v FROM supplier),
  u AS (SELECT a.g, count(DISTINCT a.v) AS n, count(DISTINCT c.v) AS m, count(*) FILTER (a.v > c.v) AS u FROM s a JOIN s c ON c.g = 0 AND a.g <> 0 GROUP BY a.g),
  sizes AS (SELECT DISTINCT n, m FROM u),
  masks AS (SELECT n, m, unnest(range(0, (1 << (n + m))::BIGINT)) AS t FROM sizes),
  places AS (SELECT n, m, list_sum(list_transform(range(0, n + m), lambda i: i * ((t >> i) & 1))) - n * (n - 1) // 2 AS x FROM masks WHERE bit_count(t) = n),
  counts AS (SELECT n, m, x, count(*) AS c FROM places GROUP BY ALL)"""


@register(
    "mannwhitney_p_exact",
    f"""WITH {EXACT} SELECT g, n::BIGINT AS n1, m::BIGINT AS n2, u::DOUBLE AS u,
      (SELECT round(least(1, 2 * sum(c) FILTER (x >= greatest(u.u, u.n * u.m - u.u)) / sum(c)), 9) + 0.0 FROM counts k WHERE k.n = u.n AND k.m = u.m) AS p FROM u""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    # the number of groups follows the number of suppliers: about six each
    groups = s.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 6)).alias("groups"))
    s = s.crossJoin(F.broadcast(groups))  # one row
    v = (F.round(F.col("s_acctbal") * 100) * 1000000 + F.col("s_suppkey")).alias("value")
    long = s.select(F.lit("v").alias("column"), (F.col("s_suppkey") % F.col("groups")).cast("bigint").alias("g"), v)
    r = summary.rank_sums(long, "g", F.col("g") == 0, spread=True)
    p = summary.rank_sum_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie_term"))
    return r.select("g", "n1", "n2", "u", (F.round(p, 9) + 0.0).alias("p"))


@register(
    "natural_key_long",
    """SELECT s_suppkey, 'g~' || lpad(CAST(18 + length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR), 10, '0') || repeat('7', 18) || s_suppkey AS sort_key,
       row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier""",
)
def _(spark, sf):
    name = F.concat(F.lit("G" + "7" * 18), F.col("s_suppkey").cast("string"))
    keyed = table(spark, sf, "supplier").select("s_suppkey", text.natural_key(name).alias("sort_key"))
    return tables.with_row_number(keyed, ["sort_key"]).select("s_suppkey", "sort_key", (F.col("__rn") + 1).cast("bigint").alias("place"))


@register(
    "lineage_ancestors",
    """WITH RECURSIVE step AS (SELECT CAST(ceil(count(*) / 80.0) AS BIGINT) AS s FROM events),
       parents AS (SELECT e.event_id AS track_id, p.event_id AS parent FROM events e, step JOIN events p ON p.event_id = e.event_id - step.s),
       up AS (SELECT track_id, parent AS ancestor, 1 AS generations FROM parents
         UNION ALL SELECT up.track_id, parents.parent, up.generations + 1 FROM up JOIN parents ON parents.track_id = up.ancestor)
       SELECT track_id, ancestor, generations FROM up""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    step = events.agg(F.ceil(F.count(F.lit(1)) / 80.0).cast("bigint").alias("step"))
    older = events.crossJoin(F.broadcast(step)).select(F.col("event_id").alias("track_id"), (F.col("event_id") - F.col("step")).alias("wanted"))  # one row
    lines = older.join(events.select(F.col("event_id").alias("wanted")), "wanted").select("track_id", F.col("wanted").alias("parent_track_id"))
    return tracking.ancestors(lines, [])
