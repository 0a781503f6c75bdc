"""Registered queries over tiled images, tracking and acquisition metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import background, measure, tracking
from tessera.operators import pixels as px
from tessera.operators import segment as sg
from tessera.operators.tiles import tile_images
from tessera.plans.catalogue import LAB, OVERLAP, PIX, _rounded, label_images, r6, register, table


def tiles(spark, sf, size=8):
    """Every embedding as an 8 x 8 image of one float layer."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("series"), "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("v")
    )
    return tile_images(e, ["series", "vec_id"], {"v": "<f4"}, size, single=size >= 8)


def label_tiles(spark, sf, size=8):
    """The same images with the quadrant labels of ``label_images``."""

    def quadrants(b):
        y = (b.core_y + sg.np.arange(b.core_h))[:, None] // 4
        x = (b.core_x + sg.np.arange(b.core_w))[None, :] // 4
        return sg.np.where(b["v"] > 0, y * 2 + x + 1, 0)

    return sg.pointwise(tiles(spark, sf, size), ["v"], "l", sg.LABEL, quadrants)


MASK = PIX + ", m AS (SELECT vec_id, y, x, v, v > 0 AS on_ FROM pix)"
REACH = """reach(vec_id, p, q) AS (SELECT vec_id, y*8+x, y*8+x FROM m WHERE {state}
  UNION SELECT r.vec_id, r.p, b.y*8+b.x FROM reach r JOIN m b ON b.vec_id = r.vec_id AND {bstate}
    AND abs(b.y - r.q//8) + abs(b.x - r.q%8) = 1)"""


def _mask(spark, sf, size=8):
    return sg.pointwise(tiles(spark, sf, size), ["v"], "m", "u1", lambda b: b["v"] > 0)


def _pixels(t, layer, column):
    return t.pixels_table(layer, column).drop("series")


@register(
    "connected_components",
    f"""WITH RECURSIVE {MASK}, {REACH.format(state='on_', bstate='b.on_')},
      c AS (SELECT vec_id, p, min(q) AS root FROM reach GROUP BY ALL)
      SELECT vec_id, (p//8)::INT AS y, (p%8)::INT AS x, (dense_rank() OVER (PARTITION BY vec_id ORDER BY root))::BIGINT AS label FROM c""",
)
def _(spark, sf):
    t = sg.number(sg.components(_mask(spark, sf), "m", "c"), "c")
    return _pixels(t, "c", "label bigint").where("label > 0")


@register(
    "connected_components_across_tiles",
    f"""WITH RECURSIVE {MASK}, {REACH.format(state='on_', bstate='b.on_')},
      c AS (SELECT vec_id, p, min(q) AS root FROM reach GROUP BY ALL), n AS (SELECT vec_id, root, count(*) AS n FROM c GROUP BY ALL)
      SELECT vec_id, (root + 1)::BIGINT AS label, n FROM n""",
)
def _(spark, sf):
    t = sg.components(_mask(spark, sf, 4), "m", "c")
    return sg.label_sizes(t, "c").drop("series")


@register(
    "slice_offsets",
    f"""WITH RECURSIVE {MASK}, {REACH.format(state='on_', bstate='b.on_')},
      c AS (SELECT vec_id, p, min(q) AS root FROM reach GROUP BY ALL),
      l AS (SELECT vec_id, p, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label FROM c),
      s AS (SELECT vec_id, vec_id // 3 AS stack, vec_id % 3 AS z, coalesce(max(label), 0) AS n FROM (SELECT DISTINCT vec_id FROM m) LEFT JOIN l USING (vec_id) GROUP BY ALL),
      o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stack ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM s)
      SELECT stack, z::INT AS z, (label + shift)::BIGINT AS label, count(*) AS n_px FROM o JOIN l USING (vec_id) GROUP BY ALL""",
)
def _(spark, sf):
    # three images are the slices of one stack, and each slice has four tiles
    e = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 3").alias("stack"), (F.col("vec_id") % 3).cast("int").alias("z"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("v")
    )
    t = sg.pointwise(tile_images(e, ["stack", "z"], {"v": "<f4"}, 4, single=False), ["v"], "m", "u1", lambda b: b["v"] > 0)
    t = sg.number(sg.components(t, "m", "c"), "c").cut()
    every = t.df.select("stack", "z").distinct()
    counts = every.join(sg.label_sizes(t, "c").groupBy("stack", "z").agg(F.max("label").alias("n")), ["stack", "z"], "left").na.fill(0, ["n"])
    return sg.label_sizes(sg.offset_slices(t, ["c"], "z", counts), "c").select("stack", "z", "label", F.col("n").alias("n_px"))


@register(
    "fill_holes",
    f"""WITH RECURSIVE {MASK}, {REACH.format(state='not on_', bstate='not b.on_')},
      o AS (SELECT vec_id, count(*) AS open_px FROM (SELECT vec_id, p FROM reach GROUP BY ALL HAVING bool_or(q//8 IN (0,7) OR q%8 IN (0,7))) GROUP BY vec_id)
      SELECT i.vec_id, 64 - coalesce(open_px, 0) AS filled_px FROM (SELECT DISTINCT vec_id FROM m) i LEFT JOIN o USING (vec_id)""",
)
def _(spark, sf):
    t = sg.fill_holes(_mask(spark, sf), "m")
    return _pixels(t, "m", "v int").groupBy("vec_id").agg(F.sum("v").alias("filled_px"))


@register(
    "remove_small_objects",
    f"""WITH RECURSIVE {MASK}, {REACH.format(state='on_', bstate='b.on_')},
      s AS (SELECT vec_id, p, count(*) AS n FROM reach GROUP BY ALL)
      SELECT i.vec_id, coalesce(k, 0) AS kept_px FROM (SELECT DISTINCT vec_id FROM m) i
        LEFT JOIN (SELECT vec_id, count(*) AS k FROM s WHERE n >= 6 GROUP BY vec_id) USING (vec_id)""",
)
def _(spark, sf):
    t = sg.remove_small_objects(_mask(spark, sf), "m", 6)
    return _pixels(t, "m", "v int").groupBy("vec_id").agg(F.sum("v").alias("kept_px"))


@register(
    "distance_transform",
    f"""WITH {MASK} SELECT a.vec_id, a.y, a.x, round(sqrt(min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))),6)+0.0 AS distance
      FROM m a JOIN m b ON a.vec_id=b.vec_id AND a.on_ AND NOT b.on_ GROUP BY ALL""",
)
def _(spark, sf):
    t = sg.distance(_mask(spark, sf), "m", "d")
    return _pixels(t, "d", "distance double").where("distance > 0").withColumn("distance", r6("distance"))


GAUSS = "w AS (SELECT k, exp(-0.5*k*k)/(SELECT sum(exp(-0.5*j*j)) FROM (SELECT unnest(range(-4,5)) AS j)) AS w FROM (SELECT unnest(range(-4,5)) AS k))"


@register(
    "gaussian_smooth",
    f"""WITH {PIX}, {GAUSS} SELECT p.vec_id, p.y, p.x, round(sum(a.w*b.w*n.v::DOUBLE),6)+0.0 AS v FROM pix p, w a, w b, pix n
      WHERE n.vec_id = p.vec_id AND n.y = greatest(0,least(7,p.y+a.k)) AND n.x = greatest(0,least(7,p.x+b.k)) GROUP BY ALL""",
)
def _(spark, sf):
    t = sg.smooth(tiles(spark, sf), "v", "s", 1.0)
    return _rounded(_pixels(t, "s", "v double"))


@register(
    "gradient_surface",
    f"""WITH {PIX}, k AS (SELECT unnest([-1,0,1]) AS k), g AS (
        SELECT p.vec_id, p.y, p.x, sum(a.k*(2-abs(b.k))*n.v::DOUBLE) AS gy, sum(b.k*(2-abs(a.k))*n.v::DOUBLE) AS gx FROM pix p, k a, k b, pix n
        WHERE n.vec_id=p.vec_id AND n.y=greatest(0,least(7,p.y+a.k)) AND n.x=greatest(0,least(7,p.x+b.k)) GROUP BY ALL),
      e AS (SELECT vec_id, y, x, sqrt(gy*gy+gx*gx) AS g FROM g),
      u AS (SELECT a.vec_id, a.y, a.x, max(b.g) AS g FROM e a JOIN e b ON a.vec_id=b.vec_id AND abs(a.y-b.y)<=3 AND abs(a.x-b.x)<=3 GROUP BY ALL)
      SELECT a.vec_id, a.y, a.x, round(min(b.g),6)+0.0 AS v FROM u a JOIN u b ON a.vec_id=b.vec_id AND abs(a.y-b.y)<=3 AND abs(a.x-b.x)<=3 GROUP BY ALL""",
)
def _(spark, sf):
    t = sg.gradient_surface(tiles(spark, sf), "v", "s", 0.5)
    return _rounded(_pixels(t, "s", "v double"))


@register(
    "binary_closing",
    f"""WITH {MASK}, up AS (SELECT a.vec_id, a.y, a.x, bool_or(b.on_) AS on_ FROM m a JOIN m b ON a.vec_id=b.vec_id AND (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 4 GROUP BY ALL)
      SELECT a.vec_id, a.y, a.x FROM up a JOIN up b ON a.vec_id=b.vec_id AND (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 4
      GROUP BY ALL HAVING bool_and(b.on_) AND count(*) = 13""",
)
def _(spark, sf):
    t = sg.closing(_mask(spark, sf), "m", "m", sg.k.disk_offsets(2))
    return _pixels(t, "m", "v int").where("v > 0").drop("v")


@register(
    "peak_local_max",
    f"""WITH {PIX}, c AS (SELECT a.vec_id, a.y, a.x FROM pix a JOIN pix b ON a.vec_id=b.vec_id AND abs(a.y-b.y)<=2 AND abs(a.x-b.x)<=2
        WHERE a.v > 0 AND a.y BETWEEN 2 AND 5 AND a.x BETWEEN 2 AND 5 GROUP BY a.vec_id, a.y, a.x, a.v HAVING a.v >= max(b.v))
      SELECT vec_id, y, x, (row_number() OVER (PARTITION BY vec_id ORDER BY y, x))::BIGINT AS label FROM c""",
)
def _(spark, sf):
    t = sg.pointwise(tiles(spark, sf), ["v"], "m", "u1", lambda b: sg.np.ones(b["v"].shape))
    return _pixels(sg.peaks(t, "v", "m", "p", 2), "p", "label bigint").where("label > 0")


def _beside(values: str, eight: bool = False) -> str:
    """The neighbours' values of pixel i (1 to 64) in a list of 8 x 8 values, NULL beyond the edge."""
    steps = [(0, -1), (0, 1), (-1, 0), (1, 0)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if eight else [])
    inside = {-1: "(i-1)%8 > 0", 1: "(i-1)%8 < 7", 0: "true"}
    return ", ".join(f"CASE WHEN {inside[x]} AND i+({8 * y}) BETWEEN 1 AND 64 THEN {values}[i+({8 * y + x})] END" for y, x in steps)


#: Levels, steps and labels of a flood of -v from the local maxima, each as a list of 64 pixels that is relaxed until nothing can change.
FLOOD = f"""seeds AS (SELECT a.vec_id, a.y, a.x, a.v FROM pix a JOIN pix b ON a.vec_id=b.vec_id AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1
    WHERE a.v > 0 AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL HAVING a.v >= max(b.v)),
  named AS (SELECT vec_id, y, x, row_number() OVER (PARTITION BY vec_id ORDER BY y, x) AS label FROM seeds),
  start AS (SELECT p.vec_id, list(-p.v::DOUBLE ORDER BY p.y, p.x) AS h, list(coalesce(label, 0) ORDER BY p.y, p.x) AS m FROM pix p LEFT JOIN named n USING (vec_id, y, x) GROUP BY p.vec_id),
  lv AS (SELECT vec_id, 0 AS n, h, m, [CASE WHEN m[i] > 0 THEN h[i] ELSE 1e9 END for i in range(1, 65)] AS l FROM start
    UNION ALL SELECT vec_id, n + 1, h, m, [least(l[i], greatest(h[i], least({_beside("l")}))) for i in range(1, 65)] FROM lv WHERE n < 64),
  st AS (SELECT vec_id, 0 AS n, h, m, l, [CASE WHEN m[i] > 0 THEN 0 ELSE 1000 END for i in range(1, 65)] AS s FROM lv WHERE n = 64
    UNION ALL SELECT vec_id, n + 1, h, m, l, [CASE WHEN m[i] > 0 THEN 0 ELSE least(s[i],
      list_min([CASE WHEN greatest(q[1], h[i]) <> l[i] THEN 1000 WHEN q[1] >= h[i] THEN q[2] + 1 ELSE 0 END for q in list_zip([{_beside("l")}], [{_beside("s")}]) if q[1] IS NOT NULL])) END for i in range(1, 65)]
      FROM st WHERE n < 64),
  lb AS (SELECT vec_id, 0 AS n, m, l, s, m AS w FROM st WHERE n = 64
    UNION ALL SELECT vec_id, n + 1, m, l, s, [CASE WHEN m[i] > 0 THEN m[i] ELSE coalesce(list_min([q[3] for q in list_zip([{_beside("l")}], [{_beside("s")}], [{_beside("w")}])
      if q[3] > 0 AND (q[1], q[2]) = list_min([(r[1], r[2]) for r in list_zip([{_beside("l")}], [{_beside("s")}]) if r[1] IS NOT NULL])]), w[i]) END for i in range(1, 65)]
      FROM lb WHERE n < 64)"""
FLOODED = f"""WITH RECURSIVE {PIX}, {FLOOD} SELECT vec_id, label::BIGINT AS label, count(*) AS area_px FROM (SELECT vec_id, unnest(w) AS label FROM lb WHERE n = 64) WHERE label > 0 GROUP BY ALL
  UNION ALL SELECT vec_id, 0, 64 FROM start WHERE list_max(m) = 0"""


def _flooded(spark, sf, size):
    t = sg.pointwise(tiles(spark, sf, size), ["v"], "m", "u1", lambda b: sg.np.ones(b["v"].shape))
    t = sg.peaks(t, "v", "m", "p", 1)
    t = sg.pointwise(t, ["v"], "h", "f8", lambda b: -b["v"].astype(float))
    return _pixels(sg.watershed(t, "h", "p", "w"), "w", "label bigint").groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("area_px"))


@register("watershed_cells", FLOODED)
def _(spark, sf):
    return _flooded(spark, sf, 8)


@register("watershed_across_tiles", FLOODED)
def _(spark, sf):
    return _flooded(spark, sf, 4)


#: A minimum is deep if no way to a lower pixel stays below its value plus the depth.
DEEP = f"""WITH RECURSIVE {PIX}, d AS (SELECT vec_id, 0.3 * (quantile_cont(v::DOUBLE, 0.99) - quantile_cont(v::DOUBLE, 0.01)) AS depth FROM pix GROUP BY vec_id),
  way(vec_id, p, q, v, depth) AS (SELECT vec_id, y*8+x, y*8+x, v::DOUBLE, depth FROM pix JOIN d USING (vec_id)
    UNION SELECT w.vec_id, w.p, b.y*8+b.x, w.v, w.depth FROM way w JOIN pix b ON b.vec_id = w.vec_id AND abs(b.y - w.q//8) <= 1 AND abs(b.x - w.q%8) <= 1 AND b.v::DOUBLE < w.v + w.depth),
  low AS (SELECT w.vec_id, w.p, w.v, min(b.v::DOUBLE) AS least FROM way w JOIN pix b ON b.vec_id = w.vec_id AND b.y*8+b.x = w.q GROUP BY ALL)
  SELECT vec_id, (p//8)::INT AS y, (p%8)::INT AS x FROM low WHERE least >= v"""


def _deep(spark, sf, size):
    t = tiles(spark, sf, size)
    span = sg.image_percentiles(t, "v", {"lo": 0.01, "hi": 0.99})
    t = sg.deep_minima(t, "v", "o", span.select("series", "vec_id", (0.3 * (F.col("hi") - F.col("lo"))).alias("depth")))
    return _pixels(t, "o", "v int").where("v > 0").drop("v")


@register("deep_minima", DEEP)
def _(spark, sf):
    return _deep(spark, sf, 8)


@register("deep_minima_across_tiles", DEEP)
def _(spark, sf):
    return _deep(spark, sf, 4)


@register(
    "tile_otsu_threshold",
    f"""WITH {PIX}, e AS (SELECT vec_id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM pix GROUP BY ALL),
      h AS (SELECT vec_id, lo, hi, least(floor((v-lo)/(hi-lo)*256),255)::INT AS bin, count(*) AS n FROM pix JOIN e USING (vec_id) GROUP BY ALL),
      c AS (SELECT *, lo+(bin+0.5)*(hi-lo)/256 AS c FROM h),
      w AS (SELECT vec_id, bin, c, sum(n) OVER (PARTITION BY vec_id ORDER BY bin) AS w1, sum(n*c) OVER (PARTITION BY vec_id ORDER BY bin) AS s1,
        sum(n) OVER (PARTITION BY vec_id) AS w, sum(n*c) OVER (PARTITION BY vec_id) AS s FROM c),
      v AS (SELECT vec_id, bin, c, coalesce(round(w1*(w-w1)*pow(s1/w1-(s-s1)/nullif(w-w1,0),2),9),0) AS v FROM w)
      SELECT vec_id, round(arg_max(c, (v, -bin)),6)+0.0 AS threshold FROM v GROUP BY vec_id""",
)
def _(spark, sf):
    return _rounded(sg.otsu(tiles(spark, sf), "v").drop("series"))


@register(
    "tile_contacts",
    f"""WITH {LAB}, s AS (SELECT a.vec_id, a.l AS l1, b.l AS l2, (a.v::DOUBLE+b.v)/2 AS e FROM lab a JOIN lab b ON a.vec_id=b.vec_id
        AND ((a.y=b.y AND b.x=a.x+1) OR (a.x=b.x AND b.y=a.y+1)) WHERE a.l>0 AND b.l>0 AND a.l<>b.l)
      SELECT vec_id, least(l1,l2)::BIGINT AS cell_id_a, greatest(l1,l2)::BIGINT AS cell_id_b, count(*) AS contact_px, round(avg(e),6)+0.0 AS junction_intensity
      FROM s GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(sg.contacts(label_tiles(spark, sf, 4), "l", "v").drop("series"))


@register(
    "tile_objects",
    f"""WITH {LAB}, g AS (SELECT vec_id, l, count(*) AS n, avg(y) AS cy, avg(x) AS cx,
        (max(y)-min(y)+1)*(max(x)-min(x)+1) AS box, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y,x) AS c FROM lab WHERE l>0 GROUP BY ALL)
      SELECT vec_id, l::BIGINT AS label, n AS area_px, round(cy,6)+0.0 AS centroid_y, round(cx,6)+0.0 AS centroid_x, round(n/box,6)+0.0 AS extent,
        round(4*sqrt((vy+vx)/2 + sqrt(pow((vy-vx)/2,2)+c*c)),4)+0.0 AS major_axis_px FROM g""",
)
def _(spark, sf):
    o = sg.objects(label_tiles(spark, sf), "l")
    return o.select("vec_id", "label", "area_px", r6("centroid_y").alias("centroid_y"), r6("centroid_x").alias("centroid_x"),
                    r6("extent").alias("extent"), (F.round("major_axis_px", 4) + 0.0).alias("major_axis_px"))


@register(
    "channel_stats",
    f"""WITH {LAB} SELECT vec_id, l::BIGINT AS label, count(*) AS n, round(avg(v::DOUBLE),6)+0.0 AS mean, round(median(v::DOUBLE),6)+0.0 AS median,
      round(stddev_pop(v::DOUBLE),6)+0.0 AS std, round(sum(v::DOUBLE),6)+0.0 AS sum FROM lab WHERE l>0 GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(measure.channel_stats(label_tiles(spark, sf), "l", {"v": "v"}).drop("series", "channel"))


@register(
    "boundary_band_two",
    f"""WITH {LAB}, r AS (SELECT a.* FROM lab a WHERE l > 0 AND (SELECT count(*) FROM lab b WHERE b.vec_id=a.vec_id AND b.l=a.l AND abs(b.y-a.y)+abs(b.x-a.x)<=2) < 13)
      SELECT vec_id, l::BIGINT AS label, round(avg(v::DOUBLE),6)+0.0 AS edge_mean, round(stddev_pop(v::DOUBLE),6)+0.0 AS edge_std FROM r GROUP BY ALL""",
)
def _(spark, sf):
    e = measure.boundary_stats(label_tiles(spark, sf), "l", {"v": "v"}, 2)
    return _rounded(e.select("vec_id", "label", "edge_mean", "edge_std"))


@register(
    "perimeter",
    f"""WITH {LAB}, e AS (SELECT a.vec_id, a.l, a.y, a.x FROM lab a WHERE l > 0 AND (SELECT count(*) FROM lab b WHERE b.vec_id=a.vec_id AND b.l=a.l AND abs(b.y-a.y)+abs(b.x-a.x)=1) < 4),
      c AS (SELECT a.vec_id, a.l, a.y, a.x, 1 + 2*count_if(abs(b.y-a.y)+abs(b.x-a.x)=1) + 10*count_if(abs(b.y-a.y)=1 AND abs(b.x-a.x)=1) AS code
        FROM e a LEFT JOIN e b ON b.vec_id=a.vec_id AND b.l=a.l GROUP BY ALL)
      SELECT vec_id, l::BIGINT AS label, round(sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1 WHEN code IN (21,33) THEN sqrt(2)
        WHEN code IN (13,23) THEN (1+sqrt(2))/2 ELSE 0 END),6)+0.0 AS perimeter_px FROM c GROUP BY ALL""",
)
def _(spark, sf):
    return _rounded(measure.perimeters(label_tiles(spark, sf), "l").drop("series"))


@register("solidity")
def _(spark, sf):
    return measure.solidity(label_tiles(spark, sf), "l").drop("series")


@register("ruggedness")
def _(spark, sf):
    return _rounded(measure.ruggedness(label_tiles(spark, sf), "l").drop("series"))


@register(
    "nucleus_rings",
    f"""WITH {LAB}, d AS (SELECT a.vec_id, a.y, a.x, min((sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)), b.l)) AS k
        FROM lab a JOIN lab b ON a.vec_id=b.vec_id AND b.l > 0 WHERE a.l = 0 GROUP BY ALL)
      SELECT vec_id, k[2]::BIGINT AS label, count(*) AS ring_px FROM d WHERE k[1] > 1.0 AND k[1] <= 2.5 GROUP BY ALL""",
)
def _(spark, sf):
    t = measure.rings(label_tiles(spark, sf), "l", "r", 1.0, 1.5)
    return sg.label_sizes(t, "r").select("vec_id", "label", F.col("n").alias("ring_px"))


@register(
    "pooled_background_field",
    f"""WITH {PIX}, c AS (SELECT vec_id, y//2 AS y, x//2 AS x, avg(v::DOUBLE) AS v FROM pix GROUP BY ALL), f AS (SELECT y, x, avg(v) AS f FROM c GROUP BY ALL)
      SELECT y::INT AS y, x::INT AS x, round(f,6)+0.0 AS field FROM f""",
)
def _(spark, sf):
    f = background.field_images(tiles(spark, sf), "v", [], 2, 0.0)
    return _rounded(background.field_tile_images(f, [], 8).pixels_table("field", "field double"))


@register(
    "tile_flatfield_correction",
    f"""WITH {PIX}, f AS (SELECT y, x, avg(abs(v::DOUBLE)) AS f FROM pix GROUP BY ALL), m AS (SELECT avg(f) AS m FROM f)
      SELECT vec_id, round(avg((abs(v::DOUBLE)/greatest(f/m,1e-3))::FLOAT::DOUBLE),5)+0.0 AS mean FROM pix JOIN f USING (y,x), m GROUP BY vec_id""",
)
def _(spark, sf):
    t = sg.pointwise(tiles(spark, sf), ["v"], "v", "f8", lambda b: sg.np.abs(b["v"]))
    fields = background.as_fields(background.field_images(t, "v", [], 1, 0.0))
    out = _pixels(background.correct(t, "v", fields), "v", "v double")
    return out.groupBy("vec_id").agg((F.round(F.avg("v"), 5) + 0.0).alias("mean"))


@register("segment_nuclei")
def _(spark, sf):
    t, _ = sg.segment_nuclei(tiles(spark, sf), "v", 0.5, 4, 1)
    return sg.label_sizes(t, "nuclei").drop("series")


@register("multinuclei_merge")
def _(spark, sf):
    t = label_tiles(spark, sf)
    t = sg.pointwise(t, ["l"], "m", "u1", lambda b: b["l"] > 0)
    t = sg.pointwise(t, ["l"], "n", sg.LABEL, lambda b: b["l"])
    _, taken, _ = sg.merge_multinucleated(t, "l", "n", "v", "m", 8.0, 0.5, 2, 0, 2)
    return _rounded(taken.drop("series"))


@register("junction_merge")
def _(spark, sf):
    t = label_tiles(spark, sf)
    t = sg.pointwise(t, ["l"], "s", sg.LABEL, lambda b: b["l"])
    _, taken = sg.merge_without_junction(t, "l", "v", "s", 0.6, 40, 0, 2)
    return _rounded(taken.drop("series"))


# ---------------------------------------------------------------- tracking


@register(
    "tile_frame_overlaps",
    f"""WITH {LAB}, {OVERLAP} SELECT series::BIGINT AS series, t, t_prev, a::BIGINT AS a, b::BIGINT AS b, shared, area_a, area_b, round(iou,6)+0.0 AS iou,
      round(shared/area_b,6)+0.0 AS share_b FROM iou""",
)
def _(spark, sf):
    t = label_tiles(spark, sf)
    t = tracking.Tiles(t.df.withColumnRenamed("vec_id", "t"), ("series", "t"), t.size, t.layers, True)
    return _rounded(tracking.tile_overlaps(t, "l", "t").drop("level"))


SHIFTED = """sh AS (SELECT vec_id, series, y, x, CASE WHEN v <= 0 THEN 0 ELSE ((y + vec_id%2)//3)*3 + (x + vec_id%3)//3 + 1 END AS l FROM pix)"""


@register(
    "best_assignment_total",
    f"""WITH RECURSIVE {PIX}, {SHIFTED}, fr AS (SELECT DISTINCT series, vec_id FROM sh), pr AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY series ORDER BY vec_id) AS p FROM fr),
      ar AS (SELECT vec_id, l, count(*) AS n FROM sh WHERE l>0 GROUP BY ALL),
      ov AS (SELECT c.vec_id AS t, o.l AS a, c.l AS b, count(*) AS s FROM sh c JOIN pr ON pr.vec_id=c.vec_id JOIN sh o ON o.vec_id=pr.p AND o.y=c.y AND o.x=c.x AND o.l>0 WHERE c.l>0 GROUP BY ALL),
      e AS (SELECT t, a, b, s/(aa.n+ab.n-s) AS iou FROM ov JOIN pr ON pr.vec_id=t JOIN ar aa ON aa.vec_id=p AND aa.l=a JOIN ar ab ON ab.vec_id=t AND ab.l=b WHERE s/(aa.n+ab.n-s) >= 0.1),
      pick(t, last, used, total) AS (SELECT DISTINCT t, 0::BIGINT, 0::BIGINT, 0::DOUBLE FROM e
        UNION ALL SELECT p.t, e.a::BIGINT, p.used | (1::BIGINT << e.b::INT), p.total + e.iou FROM pick p JOIN e ON e.t = p.t AND e.a > p.last AND (p.used & (1::BIGINT << e.b::INT)) = 0)
      SELECT t, round(max(total),6)+0.0 AS total FROM pick GROUP BY t""",
)
def _(spark, sf):
    lab = F.when(F.col("v") <= 0, 0).otherwise(
        F.floor((F.col("y") + F.col("t") % 2) / 3) * 3 + F.floor((F.col("x") + F.col("t") % 3) / 3) + 1
    )
    p = px.explode_image(table(spark, sf, "embeddings"), ["vec_id", "label"], "embedding", 8).withColumnsRenamed({"label": "series", "vec_id": "t"})
    p = p.withColumn("label", lab)
    o = px.frame_overlaps(p, ["series"], "t", px.frame_pairs(p, ["series"], "t")).where("iou >= 0.1")
    best = tracking.assign(o.select("series", "t", "a", "b", "iou"), ["series", "t"])
    return best.groupBy("t").agg(r6(F.sum("iou")).alias("total"))


TRACKS = f"""{LAB}, fr AS (SELECT series, vec_id, row_number() OVER (PARTITION BY series ORDER BY vec_id) AS t FROM (SELECT DISTINCT series, vec_id FROM lab)),
  px_ AS (SELECT lab.series, t, y, x, l FROM lab JOIN fr USING (series, vec_id) WHERE l > 0),
  c AS (SELECT series, t, l, count(*) AS n FROM px_ GROUP BY ALL),
  o AS (SELECT b.series, b.t, b.l, b.t - a.t AS d, count(*) AS s FROM px_ b JOIN px_ a ON a.series=b.series AND a.l=b.l AND a.y=b.y AND a.x=b.x AND a.t BETWEEN b.t-2 AND b.t-1 GROUP BY ALL),
  i AS (SELECT o.*, s/(x.n+y.n-s) AS iou, s/y.n AS share FROM o JOIN c x ON x.series=o.series AND x.l=o.l AND x.t=o.t-d JOIN c y ON y.series=o.series AND y.l=o.l AND y.t=o.t),
  l0 AS (SELECT series, t, l, iou FROM i WHERE d = 1 AND iou >= 0.25),
  l1 AS (SELECT i.series, i.t, i.l, i.iou FROM i WHERE d = 2 AND iou >= 0.25 AND NOT EXISTS (SELECT 1 FROM l0 WHERE l0.series=i.series AND l0.l=i.l AND l0.t IN (i.t, i.t-1))),
  k AS (SELECT c.series, c.t, c.l, CASE WHEN l0.t IS NOT NULL THEN 1 WHEN l1.t IS NOT NULL THEN 2 END AS back, coalesce(l0.iou, l1.iou) AS iou
    FROM c LEFT JOIN l0 USING (series,t,l) LEFT JOIN l1 USING (series,t,l)),
  s AS (SELECT series, t, l, (row_number() OVER (PARTITION BY series ORDER BY t, l))::BIGINT AS id FROM k WHERE back IS NULL),
  tr(series, t, l, id) AS (SELECT series, t, l, id FROM s UNION ALL SELECT k.series, k.t, k.l, tr.id FROM tr JOIN k ON k.series=tr.series AND k.l=tr.l AND k.t=tr.t+k.back),
  full_ AS (SELECT tr.series, fr.vec_id AS timepoint, tr.l AS cell_id, tr.id AS track_id, p.id AS parent_track_id, k.iou, k.back - 1 AS bridged FROM tr JOIN k USING (series,t,l) JOIN fr ON fr.series=tr.series AND fr.t=tr.t
    LEFT JOIN i ON k.back IS NULL AND i.series=tr.series AND i.t=tr.t AND i.l=tr.l AND i.d=1 AND i.share >= 0.5
    LEFT JOIN tr p ON p.series=i.series AND p.t=i.t-1 AND p.l=i.l)"""


def _tracks(spark, sf):
    lab = label_images(spark, sf).withColumnRenamed("vec_id", "timepoint").withColumn("label", F.col("label").cast("bigint"))
    w = px.Window.partitionBy("series").orderBy("timepoint")
    frames = lab.select("series", "timepoint").distinct().withColumn("frame_index", F.row_number().over(w).cast("bigint"))
    found = lab.where("label > 0").select("series", "timepoint", "label").distinct()
    o = px.frame_overlaps(lab, ["series"], "timepoint", px.frame_pairs(lab, ["series"], "timepoint", 2))
    return tracking.link(found, o, ["series"], "timepoint", frames=frames)


@register(
    "track_scenes",
    f"""WITH RECURSIVE {TRACKS} SELECT series, timepoint, cell_id::BIGINT AS cell_id, track_id, parent_track_id::DOUBLE AS parent_track_id,
      round(iou,6)+0.0 AS iou_previous, coalesce(bridged,0)::BIGINT AS frames_bridged FROM full_""",
)
def _(spark, sf):
    t = _tracks(spark, sf)
    return _rounded(t.withColumn("parent_track_id", F.col("parent_track_id").cast("double")).withColumn("frames_bridged", F.col("frames_bridged").cast("bigint")))


@register(
    "track_summary_of_scenes",
    f"""WITH RECURSIVE {TRACKS}, d AS (SELECT series, parent_track_id AS track_id, count(*) AS n FROM full_ WHERE parent_track_id IS NOT NULL GROUP BY ALL),
      n AS (SELECT series, count(DISTINCT timepoint) AS n FROM full_ GROUP BY ALL)
      SELECT series, track_id, min(timepoint) AS first_timepoint, max(timepoint) AS last_timepoint, count(*) AS n_frames,
        max(parent_track_id)::DOUBLE AS parent_track_id, coalesce(any_value(d.n),0) AS n_daughters, count(*) = any_value(n.n) AS whole_series
      FROM full_ LEFT JOIN d USING (series, track_id) JOIN n USING (series) GROUP BY series, track_id""",
)
def _(spark, sf):
    s = tracking.track_summary(_tracks(spark, sf), ["series"])
    return s.withColumn("parent_track_id", F.col("parent_track_id").cast("double"))


EV = """e AS (SELECT event_type AS scene, user_id AS track_id, ts::DATE AS timepoint, CASE WHEN event_id % 50 = 0 THEN user_id % 20 END AS parent_track_id FROM events)"""


@register(
    "track_summary_whole_series",
    f"""WITH {EV}, d AS (SELECT scene, parent_track_id AS track_id, count(*) AS n FROM e WHERE parent_track_id IS NOT NULL GROUP BY ALL),
      n AS (SELECT scene, count(DISTINCT timepoint) AS n FROM e GROUP BY ALL)
      SELECT e.scene, e.track_id, min(timepoint)::VARCHAR AS first_timepoint, max(timepoint)::VARCHAR AS last_timepoint, count(*) AS n_frames,
        max(parent_track_id)::DOUBLE AS parent_track_id, coalesce(any_value(d.n),0) AS n_daughters, count(*) = any_value(n.n) AS whole_series
      FROM e LEFT JOIN d ON d.scene=e.scene AND d.track_id=e.track_id JOIN n ON n.scene=e.scene GROUP BY e.scene, e.track_id""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("scene"), F.col("user_id").alias("track_id"), F.to_date("ts").alias("timepoint"),
        F.when(F.col("event_id") % 50 == 0, F.col("user_id") % 20).alias("parent_track_id"),
    )
    s = tracking.track_summary(e, ["scene"])
    return s.withColumns({c: F.col(c).cast("string") for c in ("first_timepoint", "last_timepoint")}).withColumn(
        "parent_track_id", F.col("parent_track_id").cast("double")
    )


@register(
    "track_displacement",
    """WITH m AS (SELECT user_id, ts::DATE AS d, avg(value) AS cy, avg(event_id % 97) AS cx FROM events GROUP BY ALL),
      k AS (SELECT user_id, d, sqrt(pow(cy - lag(cy) OVER w, 2) + pow(cx - lag(cx) OVER w, 2)) AS s FROM m WINDOW w AS (PARTITION BY user_id ORDER BY d))
      SELECT user_id, d::VARCHAR AS day, round(s,6)+0.0 AS displacement_px FROM k""",
)
def _(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("centroid_y"), F.avg(F.col("event_id") % 97).alias("centroid_x")
    )
    d = tracking.displacement(m, ["user_id"], "day")
    return d.select("user_id", F.col("day").cast("string").alias("day"), r6("displacement_px").alias("displacement_px"))


# ---------------------------------------------------------------- acquisition


@register(
    "acquisition_check",
    """WITH r AS (SELECT p_size AS mag, p_retailprice/1000 AS ps FROM part ORDER BY p_partkey LIMIT 1),
      n AS (SELECT p_partkey, r.mag AS rm, p_size AS im, r.ps AS rp, p_retailprice/1000 AS ip FROM part, r),
      l AS (SELECT p_partkey, 'error' AS level, 'objective magnification' AS what FROM n WHERE abs(rm-im) > 0.01
        UNION ALL SELECT p_partkey, 'error', 'pixel size' FROM n WHERE abs(rp-ip)/ip > 0.02
        UNION ALL SELECT p_partkey, 'error', 'field of view' FROM n WHERE abs(1000*rp-1000*ip)/(1000*ip) > 0.02)
      SELECT level, what, count(*) AS n FROM l GROUP BY ALL""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("mag"), (F.col("p_retailprice") / 1000).alias("ps"))
    ref = p.orderBy("p_partkey").limit(1).select(F.col("mag").alias("rm"), F.col("ps").alias("rp"))

    def side(mag, ps):
        return {"magnification": F.col(mag), "na": F.lit(0.8), "objective": F.lit("P"), "pixel_size": F.col(ps), "height": F.lit(1000),
                "width": F.lit(1000), "channel_names": F.array(F.lit("a"))}

    notes = background.acquisition_messages(side("rm", "rp"), side("mag", "ps"))
    m = p.crossJoin(F.broadcast(ref)).select(F.explode(notes).alias("m"))
    what = F.regexp_extract("m.message", "^(objective magnification|pixel size|field of view)", 1)
    return m.groupBy(F.col("m.level").alias("level"), what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
