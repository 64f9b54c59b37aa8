"""Catalogue queries on rejection rules, shapes, colours, surfaces, codecs and names."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crownlake.functions import scalar as S
from crownlake.operators import density, filters, height, instances, joins, metrics, polygons, raster, tables, vectors
from crownlake.plans import chains
from crownlake.plans.catalogue import load, query
from crownlake.plans.geometry import _BOX, _PIXELS, _SECOND, _SHARE, H, W_, boxes, pixels, second
from crownlake.sources import codecs, readers, writers

#: A dense surface, and the same with nothing in its first rows, deep pits and an exact-zero fill.
_SURFACE = f"(SELECT y::INTEGER AS y, x::INTEGER AS x, ((y * 7 + x * 3) % 50)::DOUBLE AS value FROM (SELECT unnest(range({H})) AS y), (SELECT unnest(range({W_})) AS x))"


def surface(spark):
    s = spark.range(H * W_).selectExpr(f"CAST(id DIV {W_} AS INT) AS y", f"CAST(id % {W_} AS INT) AS x")
    return s.withColumn("value", ((F.col("y") * 7 + F.col("x") * 3) % 50).cast("double"))


# filters ---------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(r, 6) AS ratio FROM (SELECT p_partkey, least(p_size, p_partkey % 50) / nullif(greatest(p_size, p_partkey % 50), 0) AS r, greatest(p_size, p_partkey % 50) AS side FROM part) WHERE coalesce(r, 0) >= 0.3 AND side >= 16""")
def axis_ratio_filter(spark, d):
    t = load(spark, d, "part").withColumn("w", F.col("p_partkey") % 50).withColumn("ratio", S.aspect_ratio(F.col("p_size"), F.col("w")))
    return t.where((F.coalesce("ratio", F.lit(0.0)) >= 0.3) & (F.greatest("p_size", "w") >= 16)).select("p_partkey", F.round("ratio", 6).alias("ratio"))


@query(f"""SELECT id, x1 <= 900 AND y1 <= 700 AS closed, x1 < 900 AND y1 < 700 AS open FROM (SELECT {_BOX} FROM part) WHERE x0 >= 0 AND y0 >= 0""")
def crop_inside(spark, d):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return boxes(spark, d).select("id", tables.inside(*box, 900, 700).alias("closed"), tables.inside(*box, 900, 700, closed=False).alias("open"))


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 7) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL AND NOT isnan(c_acctbal::DOUBLE)""")
def membership(spark, d):
    t = load(spark, d, "customer").where(F.col("c_nationkey").isin(1, 5, 7) & ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return t.where(F.col("c_acctbal").isNotNull() & ~F.isnan(F.col("c_acctbal").cast("double"))).select("c_custkey")


@query("""SELECT l_linenumber AS tile, round(avg((l_orderkey % 3 = 0 AND l_partkey % 2 = 0 AND l_suppkey % 2 = 0)::INT), 8) AS black FROM lineitem GROUP BY 1 HAVING avg((l_orderkey % 3 = 0 AND l_partkey % 2 = 0 AND l_suppkey % 2 = 0)::INT) <= 0.085""")
def black_margin(spark, d):
    t = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("tile"), (F.col("l_orderkey") % 3).alias("r"), (F.col("l_partkey") % 2).alias("g"), (F.col("l_suppkey") % 2).alias("b"))
    return filters.bright_enough(t, ["tile"], 0.085).withColumn("black", F.round("black", 8))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) BETWEEN 8 AND 12""")
def crowd_size(spark, d):
    return filters.crowd_between(load(spark, d, "orders"), ["o_custkey"], 8, 12)


@query("""SELECT p_partkey, p_size >= 5 AND p_partkey % 50 >= 5 AND p_partkey % 50 >= 0.4 * p_size AS seen, CASE WHEN p_size % 3 = 0 THEN p_retailprice >= 1000 ELSE p_retailprice >= 1000 AND p_size % 3 >= 2 END AS textured,
CASE WHEN p_size % 2 = 1 THEN 'width 1921' WHEN p_size % 4 = 2 THEN 'aspect 1.875' END AS warning FROM part""")
def visibility_rules(spark, d):
    size = F.col("p_size")
    relief = F.when(size % 3 != 0, (size % 3).cast("double"))
    warning = filters.camera_warning(F.lit(1920) + size % 2, F.when(size % 4 == 2, 1024).otherwise(1080))
    seen = filters.visible_enough(size, F.col("p_partkey") % 50, 5, 0.4)
    return load(spark, d, "part").select("p_partkey", seen.alias("seen"), filters.textured(F.col("p_retailprice"), relief, 1000, 2).alias("textured"), warning.alias("warning"))


_HEIGHTS = f"(SELECT y, x, CASE WHEN value < 3 THEN 0 WHEN value < 6 THEN -5 ELSE value * 2 END AS value FROM {_SURFACE})"


@query(f"""WITH s AS (SELECT * FROM {_HEIGHTS}) SELECT y, x, CASE WHEN value > -3 AND value < 90 AND NOT EXISTS (SELECT 1 FROM s z WHERE z.value = 0 AND abs(z.y - s.y) <= 1 AND abs(z.x - s.x) <= 1) THEN least(60, greatest(0, value)) END AS value FROM s""")
def valid_heights(spark, d):
    s = surface(spark).withColumn("value", F.when(F.col("value") < 3, 0.0).when(F.col("value") < 6, -5.0).otherwise(F.col("value") * 2))
    return filters.valid_heights(s).select("y", "x", "value")


_SLOPE = f"""s AS (SELECT * FROM {_SURFACE}), g AS (SELECT a.y, a.x, a.value, CASE WHEN u.value IS NULL THEN w.value - a.value WHEN w.value IS NULL THEN a.value - u.value ELSE (w.value - u.value) / 2 END AS gy,
CASE WHEN l.value IS NULL THEN r.value - a.value WHEN r.value IS NULL THEN a.value - l.value ELSE (r.value - l.value) / 2 END AS gx, u.value AS up, w.value AS down, l.value AS le, r.value AS ri FROM s a LEFT JOIN s u ON u.x = a.x AND u.y = a.y - 1
LEFT JOIN s w ON w.x = a.x AND w.y = a.y + 1 LEFT JOIN s l ON l.y = a.y AND l.x = a.x - 1 LEFT JOIN s r ON r.y = a.y AND r.x = a.x + 1)"""


@query(f"""WITH {_SLOPE}, t AS (SELECT y, x FROM g WHERE sqrt(gx * gx + gy * gy) / 2 > 8) SELECT y, x, value FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE abs(t.y - s.y) <= 1 AND abs(t.x - s.x) <= 1)""")
def steady_points(spark, d):
    return filters.steady(surface(spark), 2.0).select("y", "x", "value")


@query(f"""SELECT id, (x0 % 256 = 0 AND x0 - x0 % 256 > 0) OR (y0 % 256 = 0 AND y0 - y0 % 256 > 0) OR (x0 % 256 + x1 - x0 = 256 AND x0 - x0 % 256 + 256 < 1100) OR (y0 % 256 + y1 - y0 = 256 AND y0 - y0 % 256 + 256 < 900) AS cut FROM (SELECT {_BOX} FROM part)""")
def cut_edges(spark, d):
    b = boxes(spark, d).withColumn("tx", F.col("x0") - F.col("x0") % 256).withColumn("ty", F.col("y0") - F.col("y0") % 256)
    own = [F.col(c) - F.col(t) for c, t in (("x0", "tx"), ("y0", "ty"), ("x1", "tx"), ("y1", "ty"))]
    return b.select("id", raster.touches_inner_edge(*own, (F.col("tx"), F.col("ty"), F.col("tx") + 256, F.col("ty") + 256), 1100, 900).alias("cut"))


# statistics ------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.98), 4) AS p98 FROM (SELECT l_returnflag, CASE WHEN l_quantity <= 40 THEN l_quantity::DOUBLE END AS v FROM lineitem) GROUP BY 1""")
def percentiles_of_valid(spark, d):
    t = load(spark, d, "lineitem").withColumn("v", F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("double")))
    return tables.percentiles(t, ["l_returnflag"], "v", [5, 50, 98])


@query("""SELECT o_custkey, o_orderkey, sum((o_totalprice > 100000)::INT) OVER w AS splits, count(*) OVER w AS seen FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def running_totals(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum((F.col("o_totalprice") > 100000).cast("int")).over(w).alias("splits"), F.count("*").over(w).alias("seen"))


@query("""SELECT c_mktsegment, round(m, 4) AS mean, row_number() OVER (ORDER BY m DESC, c_mktsegment)::INTEGER AS place FROM (SELECT c_mktsegment, avg(c_acctbal::DOUBLE) AS m FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)""")
def metric_ranking(spark, d):
    means = tables.keyed(load(spark, d, "customer"), ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.avg(F.col("c_acctbal").cast("double")).alias("m"))
    ranked = tables.top_rows(means, [], [F.desc("m"), F.col("c_mktsegment")], 1000)
    return ranked.select("c_mktsegment", F.round("m", 4).alias("mean"), F.col("rank").alias("place"))


@query("""SELECT source, key FROM (SELECT 'customer' AS source, c_custkey AS key, row_number() OVER (ORDER BY md5(c_custkey || ':0'), c_custkey) AS rn FROM customer UNION ALL SELECT 'supplier', s_suppkey, row_number() OVER (ORDER BY md5(s_suppkey || ':0'), s_suppkey) FROM supplier) WHERE rn <= 9""")
def equal_quota(spark, d):
    parts = [load(spark, d, t).select(F.lit(t).alias("source"), F.col(f"{t[0]}_{k}").alias("key")) for t, k in (("customer", "custkey"), ("supplier", "suppkey"))]
    return tables.equal_quota(parts, 9, "key")


@query("""SELECT vec_id, round((v - m) / s, 5) AS first FROM (SELECT vec_id, embedding[1]::DOUBLE AS v, avg(embedding[1]::DOUBLE) OVER () AS m, stddev_samp(embedding[1]::DOUBLE) OVER () AS s FROM embeddings)""")
def standardised_first(spark, d):
    t = load(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    return vectors.standardised(t, t, "embedding").select("vec_id", F.round(F.col("embedding")[0], 5).alias("first"))


@query("""SELECT count(*) AS n, round(sum(v), 3) AS variance, true AS falling, true AS apart FROM (SELECT i, count(*) AS n, var_samp(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1)""")
def pca_variance(spark, d):
    """All principal components together hold the whole variance, in falling order, and do not covary."""
    t = load(spark, d, "embeddings")
    k = len(t.first().embedding)
    out = vectors.reduced(t, k, "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    var = out.groupBy("i").agg(F.var_samp("x").alias("v"))
    both = out.alias("a").join(out.alias("b"), (F.col("a.vec_id") == F.col("b.vec_id")) & (F.col("b.i") == F.col("a.i") + 1))
    cov = both.groupBy("a.i").agg(F.covar_samp("a.x", "b.x").alias("c")).agg((F.max(F.abs("c")) < 1e-6).alias("apart"))
    falls = F.aggregate(F.array_sort(F.collect_list(F.struct("i", "v"))), F.struct(F.lit(True).alias("ok"), F.lit(float("inf")).alias("last")), lambda s, x: F.struct((s["ok"] & (x["v"] <= s["last"] + 1e-9)).alias("ok"), x["v"].alias("last")))["ok"]
    return var.agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("variance"), falls.alias("falling")).crossJoin(cov)


@query("""SELECT count(*) AS n, 8::BIGINT AS clusters, 0::BIGINT AS stray FROM embeddings""")
def kmeans_settled(spark, d):
    """Rows, clusters, and rows that lie nearer to another cluster's mean than to their own by more than the runs' tolerance."""
    t = vectors.clustered(vectors.normalised(load(spark, d, "embeddings"), "embedding"), 8, features="embedding", tries=3, rounds=100, tolerance=0.0)
    means = vectors.group_means(t, ["cluster"], "embedding").select(F.col("cluster").alias("other"), "mean")
    far = F.aggregate(F.zip_with("embedding", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = t.crossJoin(F.broadcast(means)).groupBy("vec_id", "cluster").agg(F.min(far).alias("least"), F.min(F.when(F.col("other") == F.col("cluster"), far)).alias("own"))
    return best.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("own") > F.col("least") + 1e-6).alias("stray"))


# shapes, colours, points -----------------------------------------------------------------------


def _ring():
    corner = [F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    return F.array(*corner)


@query(f"""SELECT id, ((x1 - x0) * (y1 - y0))::DOUBLE AS area, (2 * (x1 - x0 + y1 - y0))::DOUBLE AS length, round(4 * pi() * (x1 - x0) * (y1 - y0) / (2 * (x1 - x0 + y1 - y0)) ** 2, 6) AS compactness, (2000 - y1)::DOUBLE AS turned_y0, x0::DOUBLE AS turned_x0,
round((x0 - 100) / 0.5, 6) AS px, round((200 - y0) / 0.5, 6) AS py FROM (SELECT {_BOX} FROM part)""")
def ring_measures(spark, d):
    b = boxes(spark, d).withColumn("ring", _ring())
    turned = S.ring_box(S.ring_turned(F.col("ring"), 3, 2000.0))
    px, py = S.to_pixel(F.col("x0"), F.col("y0"), (0.5, 0.0, 100.0, 0.0, -0.5, 200.0))
    t = b.select("id", S.ring_area(F.col("ring")).alias("area"), S.ring_length(F.col("ring")).alias("length"), turned.alias("t"), F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))
    return t.select("id", "area", "length", F.round(S.compactness(F.col("area"), F.col("length")), 6).alias("compactness"), F.col("t.x0").alias("turned_y0"), F.col("t.y0").alias("turned_x0"), "px", "py")


@query(f"""SELECT id, ((least(x1, 600) - least(x0, 600)) * (least(y1, 500) - least(y0, 500)))::BIGINT AS pixels FROM (SELECT {_BOX} FROM part) WHERE x0 < 600 AND y0 < 500""")
def polygon_fill(spark, d):
    runs = polygons.filled(boxes(spark, d).select("id", _ring().alias("ring")), ["id"], 500, 600)
    return runs.groupBy("id").agg(F.sum((F.col("x_end") - F.col("x_start")).cast("long")).alias("pixels"))


@query(f"""SELECT id, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM (SELECT {_BOX} FROM part)""")
def wkb_areas(spark, d):
    """Boxes as WKB polygons of alternating byte order, read back as rings."""

    @F.pandas_udf("binary")
    def packed(rings: pd.Series, ids: pd.Series) -> pd.Series:
        def one(ring, i):
            order = "<" if i % 2 else ">"
            points = [c for p in [*ring, ring[0]] for c in (p["x"], p["y"])]
            return struct.pack(f"{order}BIII{len(points)}d", i % 2, 3, 1, len(points) // 2, *points)

        return pd.Series([one(r, i) for r, i in zip(rings, ids, strict=True)])

    t = readers.wkb(boxes(spark, d).select("id", packed(_ring(), F.col("id")).alias("wkb")), "wkb")
    return t.select("id", S.ring_area(F.col("rings")[0]).alias("area"))


@query("""SELECT p_partkey, greatest(1, least(65535, round_even(p_retailprice::DOUBLE * 100, 0)))::INTEGER AS cm, round_even((p_retailprice::DOUBLE - 900) / 0.25, 0)::INTEGER AS q FROM part""")
def fixed_point(spark, d):
    price = F.col("p_retailprice").cast("double")
    return load(spark, d, "part").select("p_partkey", S.centimetres(price).alias("cm"), S.quantised(price, 900.0, 0.25).alias("q"))


def _srgb(c):
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _cube(v):
    return f"CASE WHEN {v} > 216.0::DOUBLE / 24389 THEN cbrt({v}) ELSE (24389.0::DOUBLE / 27 * {v} + 16) / 116 END"


@query(f"""WITH c AS (SELECT y, x, label, y * 5 AS r, x * 3 AS g, (y + x) * 2 AS b FROM {_PIXELS}), l AS (SELECT label, {_srgb("r")} AS r, {_srgb("g")} AS g, {_srgb("b")} AS b FROM c),
m AS (SELECT label, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM l),
f AS (SELECT label, {_cube("x")} AS x, {_cube("y")} AS y, {_cube("z")} AS z FROM m) SELECT label, round(median(116 * y - 16), 4) AS l, round(median(500 * (x - y)), 4) AS ca, round(median(200 * (y - z)), 4) AS cb FROM f GROUP BY 1""")
def median_colour(spark, d):
    colours = surface(spark).select("y", "x", (F.col("y") * 5).alias("r"), (F.col("x") * 3).alias("g"), ((F.col("y") + F.col("x")) * 2).alias("b"))
    return raster.median_colour(pixels(spark, d), colours).select("label", *[F.round(c, 4).alias(c) for c in ("l", "ca", "cb")])


@query("""SELECT p_partkey, m > 0 AND h > 0 AS known, CASE WHEN m > 0 AND h > 0 THEN round(0.917::DOUBLE / 0.945 * h / m, 6) END AS k, CASE WHEN m > 0 AND h > 0 THEN round(2 * degrees(atan(0.5 / (0.917::DOUBLE / 0.945 * h / m))), 5) END AS fov
FROM (SELECT p_partkey, p_size % 4 * 20.0::DOUBLE AS h, p_retailprice::DOUBLE / 10 AS m FROM part)""")
def field_of_view(spark, d):
    t = load(spark, d, "part").withColumn("altitude_known", F.col("p_size") % 4 * F.lit(20.0))
    t = height.calibrated(t.withColumn("inv_p95", F.col("p_retailprice").cast("double") / 10))
    return t.select("p_partkey", (F.col("altitude_known") > 0).alias("known"), F.round("k_est", 6).alias("k"), F.round("fov_est", 5).alias("fov"))


# rasters ---------------------------------------------------------------------------------------


@query(f"""WITH {_SLOPE} SELECT y, x, abs(coalesce(up, down, value) + coalesce(down, up, value) + coalesce(le, ri, value) + coalesce(ri, le, value) - 4 * value) AS texture FROM g""")
def laplacian(spark, d):
    return raster.laplacian(surface(spark)).select("y", "x", "texture")


@query(f"""WITH {_SLOPE}, a AS (SELECT y, x, pi() / 2 - atan(sqrt((gx * 40) ** 2 + (gy * 40) ** 2)) AS slope, atan2(-gx, gy) AS aspect FROM g)
SELECT y, x, round(least(1, greatest(0, (sin(radians(45)) * sin(slope) + cos(radians(45)) * cos(slope) * cos(radians(135) - aspect) + 1) / 2)), 6) AS shade FROM a""")
def hillshade(spark, d):
    return raster.hillshade(surface(spark)).select("y", "x", F.round("shade", 6).alias("shade"))


@query(f"""WITH p AS (SELECT * FROM {_PIXELS} WHERE x % 16 < 12), s AS (SELECT * FROM {_SURFACE}), ring AS (SELECT DISTINCT p.label, s.y, s.x, s.value FROM p JOIN s ON abs(s.y - p.y) <= 4 AND abs(s.x - p.x) <= 4 WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.y = s.y AND q.x = s.x)),
o AS (SELECT label, avg(value) AS m FROM p JOIN s USING (y, x) GROUP BY 1), r AS (SELECT label, avg(value) AS m, count(*) AS n FROM ring GROUP BY 1) SELECT o.label, round(CASE WHEN r.n > 20 THEN o.m - r.m ELSE 0 END, 6) AS contrast FROM o LEFT JOIN r USING (label)""")
def ring_contrast(spark, d):
    return raster.ring_contrast(pixels(spark, d).where("x % 16 < 12"), surface(spark)).withColumn("contrast", F.round("contrast", 6))


@query(f"""WITH p AS (SELECT * FROM {_PIXELS}), s AS (SELECT * FROM {_SURFACE}), k AS (SELECT label, max(value) AS peak FROM p JOIN s USING (y, x) GROUP BY 1),
n AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, max(s.value) AS saddle FROM p a JOIN s USING (y, x), (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) o(dy, dx)), p b WHERE b.y = a.y + dy AND b.x = a.x + dx AND a.label <> b.label GROUP BY 1, 2)
SELECT a, b, round((least(i.peak, j.peak) - saddle) / 50, 6) AS prominence, (least(i.peak, j.peak) - saddle) / 50 < 0.06 AS suspicious FROM n JOIN k i ON i.label = a JOIN k j ON j.label = b""")
def suspicious_splits(spark, d):
    p = pixels(spark, d).join(surface(spark), ["y", "x"])
    return raster.prominences(p, span=50.0).select("a", "b", F.round("prominence", 6).alias("prominence"), "suspicious")


@query(f"""WITH z AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM {_PIXELS} GROUP BY 1), p AS (SELECT y::INTEGER AS y, x::INTEGER AS x, coalesce(label, 0) AS label FROM (SELECT * FROM (SELECT unnest(range({H})) AS y), (SELECT unnest(range({W_})) AS x)) LEFT JOIN {_PIXELS} USING (y, x)),
e AS (SELECT a.y, a.x, (min(b.label) <> max(b.label))::INTEGER AS border FROM p a, p b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.label > 0 GROUP BY 1, 2)
SELECT y, x, label, border, 1 - border AS interior, round(exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * (0.25 * 2 * sqrt(n / pi())) ** 2)), 6) AS centre FROM e JOIN {_PIXELS} USING (y, x) JOIN z USING (label)""")
def target_maps(spark, d):
    return raster.target_maps(pixels(spark, d), H, W_).withColumn("centre", F.round("centre", 6))


@query(f"""SELECT y // 4 AS y, x // 4 AS x, round(avg(v), 6) AS value, count(v) / 16.0::DOUBLE AS weight FROM (SELECT y, x, CASE WHEN (y * 7 + x * 3) % 50 <> 17 THEN value END AS v FROM {_SURFACE}) GROUP BY 1, 2 HAVING count(v) / 16.0 >= 0.9""")
def masked_resample(spark, d):
    s = surface(spark).withColumn("value", F.when(F.col("value") != 17, F.col("value")))
    return raster.masked_resample(s, 4, least=0.9).select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("value", 6).alias("value"), "weight")


@query(f"""SELECT v::INTEGER AS v, u::INTEGER AS u, value FROM (SELECT unnest(range(20)) AS v), (SELECT unnest(range(20)) AS u), {_SURFACE} s WHERE s.y = abs(v - 7) AND s.x = CASE WHEN u + 50 > {W_ - 1} THEN 2 * {W_ - 1} - u - 50 ELSE u + 50 END""")
def mirrored_crop(spark, d):
    return raster.crop(surface(spark), 60, 3, 20, H, W_)


@query("""SELECT o_custkey % 20 AS y, o_orderkey % 20 AS x, round(avg(o_totalprice::DOUBLE / (o_orderkey % 5)), 2) AS value, count(*) AS pairs FROM orders WHERE o_orderkey % 5 >= 2 AND o_custkey % 10 / 10.0 >= 0.5 GROUP BY 1, 2""")
def pooled_parallax(spark, d):
    t = load(spark, d, "orders").select((F.col("o_custkey") % 20).alias("y"), (F.col("o_orderkey") % 20).alias("x"), (F.col("o_orderkey") % 5).alias("shift"), (F.col("o_custkey") % 10 / 10).alias("overlap"), F.col("o_totalprice").cast("double").alias("value"))
    return raster.pooled_parallax(t, 2, 0.5, []).withColumn("value", F.round("value", 2))


@query(f"""SELECT a.label IS NOT NULL AND b.label IS NOT NULL AS both, a.label IS NOT NULL AND b.label IS NULL AS first, b.label IS NOT NULL AND a.label IS NULL AS second, count(*) AS n FROM (SELECT * FROM {_PIXELS} WHERE y % 8 < 6) a FULL JOIN (SELECT * FROM {_SECOND} WHERE x % 16 < 12) b USING (y, x) GROUP BY 1, 2, 3""")
def mask_algebra(spark, d):
    a, b = pixels(spark, d).where("y % 8 < 6").withColumn("a", F.lit(True)), second(spark, d).where("x % 16 < 12").withColumn("b", F.lit(True))
    t = a.select("y", "x", "a").join(b.select("y", "x", "b"), ["y", "x"], "full").fillna(False, ["a", "b"])
    return t.groupBy((F.col("a") & F.col("b")).alias("both"), (F.col("a") & ~F.col("b")).alias("first"), (F.col("b") & ~F.col("a")).alias("second")).agg(F.count("*").alias("n"))


_TWO = f"(SELECT id * 2 AS id, x0, y0, x1, y1, frame, score FROM (SELECT {_BOX}, p_brand AS frame, p_retailprice::DOUBLE AS score FROM part) UNION ALL SELECT id * 2 + 1, x0 + id % 7, y0, x1 + id % 7, y1, frame, score * 0.9 FROM (SELECT {_BOX}, p_brand AS frame, p_retailprice::DOUBLE AS score FROM part))"


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY frame) AS n FROM {_TWO}),
k AS (SELECT frame, 1::BIGINT AS rn, [{{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM r WHERE rn = 1 UNION ALL
SELECT r.frame, r.rn, CASE WHEN len(list_filter(kept, lambda q: {_SHARE.format(a='q', b='r')} >= 0.5)) = 0 THEN list_append(kept, {{'id': r.id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) ELSE kept END
FROM k JOIN r ON r.frame = k.frame AND r.rn = k.rn + 1) SELECT frame, q.id AS id FROM (SELECT k.frame, unnest(kept) AS q FROM k JOIN (SELECT DISTINCT frame, n FROM r) m ON m.frame = k.frame AND m.n = k.rn)""")
def two_models_suppressed(spark, d):
    b = boxes(spark, d).withColumn("score", F.col("score").cast("double"))
    first = b.selectExpr("id * 2 AS id", "x0", "y0", "x1", "y1", "frame", "score")
    other = b.selectExpr("id * 2 + 1 AS id", "x0 + id % 7 AS x0", "y0", "x1 + id % 7 AS x1", "y1", "frame", "score * 0.9 AS score")
    return instances.suppressed(tables.union_all([first, other]), ["frame"], 0.5).select("frame", "id")


_CHOICE = "SELECT p_brand AS seed, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY {} DESC, p_partkey) AS rn FROM (SELECT *, p_partkey % 97 + 1 AS area FROM part)"


@query(f"""SELECT seed, b.id AS basin, s.id AS score, a.id AS area FROM ({_CHOICE.format("p_size")}) b JOIN ({_CHOICE.format("p_retailprice")}) s USING (seed) JOIN ({_CHOICE.format("-abs(ln(area / 41))")}) a USING (seed) WHERE b.rn = 1 AND s.rn = 1 AND a.rn = 1""")
def candidate_choice(spark, d):
    t = load(spark, d, "part").select(F.col("p_brand").alias("seed"), F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("basin_iou"), F.col("p_retailprice").alias("score"), (F.col("p_partkey") % 97 + 1).alias("area"), F.lit(41).alias("expected"))
    out = None
    for way in ("basin", "score", "area"):
        one = instances.candidate_per_seed(t, [], way).select("seed", F.col("id").alias(way))
        out = one if out is None else out.join(one, "seed")
    return out


@query(f"""WITH RECURSIVE a AS (SELECT * FROM {_PIXELS} WHERE y % 12 < 9), b AS (SELECT * FROM {_PIXELS} WHERE x % 16 < 13), n AS (SELECT a.label AS p, b.label AS t, count(*) AS n FROM a JOIN b USING (y, x) GROUP BY 1, 2),
i AS (SELECT p, t, n / (pa + ta - n) AS iou FROM n JOIN (SELECT label AS p, count(*) AS pa FROM a GROUP BY 1) USING (p) JOIN (SELECT label AS t, count(*) AS ta FROM b GROUP BY 1) USING (t)),
c AS (SELECT p, list({{'iou': iou, 't': t}} ORDER BY iou, t) AS c FROM i WHERE iou >= 0.5 GROUP BY 1), r AS (SELECT label AS p, coalesce(c.c, []) AS c, row_number() OVER (ORDER BY label) AS rn FROM (SELECT DISTINCT label FROM a) LEFT JOIN c ON c.p = label),
m AS (SELECT p, rn, c[-1] AS best, list_filter([c[-1].t], lambda x: x IS NOT NULL) AS taken FROM r WHERE rn = 1 UNION ALL SELECT r.p, r.rn, list_filter(r.c, lambda q: NOT list_contains(m.taken, q.t))[-1],
list_concat(m.taken, list_filter([list_filter(r.c, lambda q: NOT list_contains(m.taken, q.t))[-1].t], lambda x: x IS NOT NULL)) FROM m JOIN r ON r.rn = m.rn + 1)
SELECT 'north' AS area, count(*) AS pred, (SELECT count(DISTINCT label) FROM b) AS gt, count(best.t) AS hits, round(coalesce(sum(best.iou) / nullif(count(best.t), 0), 0), 6) AS mean_iou, round(count(best.t) / count(*), 6) AS precision FROM m""")
def label_map_evaluation(spark, d):
    px = pixels(spark, d).withColumn("stem", F.lit("north_01"))
    out = chains.label_map_metrics(raster.runs(px.where("y % 12 < 9"), ["stem"]), raster.runs(px.where("x % 16 < 13"), ["stem"]))
    return out.select("area", "pred", "gt", "hits", F.round("mean_iou", 6).alias("mean_iou"), F.round("precision", 6).alias("precision"))


@query(f"""WITH h AS (SELECT t.frame, t.id, EXISTS (SELECT 1 FROM (SELECT {_BOX}, p_brand AS frame FROM part) f WHERE f.id % 2 = 0 AND f.frame = t.frame AND f.x0 < t.x1 AND t.x0 < f.x1 AND f.y0 < t.y1 AND t.y0 < f.y1) AS hit FROM (SELECT {_BOX}, p_brand AS frame FROM part) t WHERE id % 2 = 1),
n AS (SELECT frame, count(*) AS gt, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) // 2 AS extra FROM h GROUP BY 1), p AS (SELECT *, (hits + extra) / greatest(1, hits + 10 + extra) AS p, (hits + extra) / greatest(1, gt) AS r FROM n)
SELECT frame, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1e-9, p + r), 6) AS f1 FROM p""")
def ceiling_bounds(spark, d):
    """What half of the missed boxes would add: bounds of precision, recall and f1 of each frame."""
    b = boxes(spark, d)
    truth, found = b.where("id % 2 = 1"), b.where("id % 2 = 0")
    gone = joins.hit_by_any(truth, found, ["frame"], "id", 64, missed=True).groupBy("frame").agg(F.count("*").alias("gone"))
    n = truth.groupBy("frame").agg(F.count("*").alias("gt")).join(gone, "frame", "left").fillna(0, ["gone"])
    n = n.withColumn("hits", F.col("gt") - F.col("gone")).withColumn("extra", F.floor(F.col("gone") / 2))
    bounds = metrics.ceiling(F.col("hits"), F.col("extra"), F.col("hits") + 10, F.col("gt"))
    return n.select("frame", *[F.round(c, 6).alias(name) for c, name in zip(bounds, ("precision", "recall", "f1"), strict=True)])


@query(f"""SELECT id, coalesce(label, 0)::INTEGER AS label, label IS NOT NULL AS covered FROM (SELECT id, y0 % {H} AS y, x0 % {W_} AS x FROM (SELECT {_BOX} FROM part)) LEFT JOIN (SELECT * FROM {_PIXELS} WHERE x % 16 < 12) USING (y, x)""")
def point_lookup(spark, d):
    """Peaks against a label raster: which label lies under each, and whether any does."""
    peaks = boxes(spark, d).select("id", (F.col("y0") % H).alias("y"), (F.col("x0") % W_).alias("x"))
    under = joins.dimension(peaks, pixels(spark, d).where("x % 16 < 12"), ["y", "x"], "left")
    return under.select("id", F.coalesce("label", F.lit(0)).cast("int").alias("label"), F.col("label").isNotNull().alias("covered"))


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, sum(CASE WHEN o_totalprice > 150000 THEN round(ln(o_totalprice::DOUBLE), 6) END) IS NULL AS none FROM orders GROUP BY 1""")
def lists_by_key(spark, d):
    price = F.col("o_totalprice").cast("double")
    t = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"), F.sum(F.when(price > 150000, F.round(F.ln(price), 6))).isNull().alias("none"))
    return t.select("o_custkey", F.array_join(F.col("l").cast("array<string>"), ",").alias("orders"), "none")


@query("""SELECT l_linenumber AS route, l_tax::DOUBLE AS p, round(m, 6) AS mae_m, n FROM (SELECT l_linenumber, l_tax, avg(l_extendedprice::DOUBLE) AS m, count(*) AS n, row_number() OVER (PARTITION BY l_linenumber ORDER BY avg(l_extendedprice::DOUBLE), l_tax) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def best_route(spark, d):
    t = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("route"), F.col("l_tax").cast("double").alias("p"), F.col("l_extendedprice").cast("double").alias("mae_m"))
    return height.best_route(t, ["p"]).select("route", "p", F.round("mae_m", 6).alias("mae_m"), "n")


@query(f"""SELECT id, round((x0 - 500) / (1000 - y0 * 0.001::DOUBLE) * 800, 5) AS u, round((y0 - 400) / (1000 - y0 * 0.001::DOUBLE) * 800, 5) AS v, round(1000 - y0 * 0.001::DOUBLE, 6) AS depth FROM (SELECT {_BOX} FROM part)""")
def camera_above(spark, d):
    """Points seen by a camera that looks straight down; its right is x, its up is y."""
    u, v, depth = height.look_at((500.0, 400.0, 1000.0), (500.0, 400.0, 0.0), F.col("x0").cast("double"), F.col("y0").cast("double"), F.col("y0") * 0.001, 800.0)
    return boxes(spark, d).select("id", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), F.round(depth, 6).alias("depth"))


# files in memory -------------------------------------------------------------------------------


def _decoded(files, decode, schema):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([row for c in pdf["content"] for row in decode(bytes(c))], columns=[c.split()[0] for c in schema.split(", ")])

    return files.mapInPandas(run, schema)


@query(f"""SELECT y, x, label FROM {_PIXELS}""")
def label_png(spark, d):
    """The label raster as a 16-bit PNG and back."""
    runs = raster.runs(pixels(spark, d)).withColumn("folder", F.lit("f")).withColumn("stem", F.lit("s"))
    files = writers.label_pngs(runs, spark.createDataFrame([("f", "s", H, W_)], "folder string, stem string, height int, width int"))

    def decode(content):
        a = codecs.png_decode(content)
        return [(y, x, int(a[y, x])) for y, x in zip(*(i.tolist() for i in a.nonzero()), strict=True)]

    return _decoded(files, decode, "y int, x int, label int")


@query(f"""SELECT y, x, value::FLOAT AS value FROM {_SURFACE}""")
def surface_npy(spark, d):
    """The surface as an NPY file and back."""
    flat = surface(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col("value").cast("float").alias("v")))), lambda s: s["v"]).alias("values"))
    files = writers.npy_files(flat.select(F.lit("f").alias("folder"), F.lit("s").alias("stem"), F.lit(H).alias("height"), F.lit(W_).alias("width"), "values"))

    def decode(content):
        a = codecs.npy_decode(content)
        return [(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]

    return _decoded(files, decode, "y int, x int, value float")


@query(f"""SELECT y, x, value, value * 2 - 40 AS other FROM {_SURFACE}""")
def surface_tiff(spark, d):
    """Two bands in tiles of a deflated GeoTIFF and back."""

    def encode(pdf):
        a = pdf.sort_values(["y", "x"])["value"].to_numpy(float).reshape(H, W_, 1)
        bands = np.concatenate((a, a * 2 - 40), axis=2).astype(np.float32)
        return pd.DataFrame([("s.tif", codecs.tiff_encode(bands, tile=16, deflate=True))], columns=["name", "content"])

    def decode(content):
        a, _ = codecs.tiff_decode(content)
        return [(y, x, float(a[y, x, 0]), float(a[y, x, 1])) for y in range(a.shape[0]) for x in range(a.shape[1])]

    files = surface(spark).groupBy().applyInPandas(encode, writers.FILE)
    return _decoded(files, decode, "y int, x int, value double, other double")


@query()
def density_labels(spark, d):
    """Rows of each density cluster of the embeddings; tests hold the operator against plain definitions."""
    out = density.density_clusters(vectors.normalised(load(spark, d, "embeddings"), "embedding"), "vec_id", "embedding", least=5)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


# names -----------------------------------------------------------------------------------------


@query("""SELECT p_partkey, upper(substring(trim(f), 1, 1)) = upper(substring(trim(p_name), 1, 1)) AND (len(w) = 1 OR w[-1] IN ('A.Dietr.', 'L.') OR w[-1] = v[-1]) AS same FROM (SELECT p_partkey, p_name, f, string_split_regex(trim(p_name), '\\s+') AS w, string_split_regex(trim(f), '\\s+') AS v
FROM (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN substring(p_name, 1, 1) || '. ' || p_partkey WHEN 1 THEN upper(p_name) ELSE p_name || ' x' END AS f FROM part))""")
def species_matched(spark, d):
    t = load(spark, d, "part")
    found = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring("p_name", 1, 1), F.lit(". "), F.col("p_partkey"))).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    return t.select("p_partkey", S.species_match(found, F.col("p_name")).alias("same"))


@query("""SELECT p_partkey, p_brand AS folder, p_name || '__' || p_type AS stem, regexp_replace(p_name || '_labels', '_labels$', '') AS name FROM part""")
def name_parts(spark, d):
    folder, stem = S.key_parts(F.concat_ws("__", "p_brand", "p_name", "p_type"))
    return load(spark, d, "part").select("p_partkey", folder.alias("folder"), stem.alias("stem"), S.strip_suffix(F.concat("p_name", F.lit("_labels")), "_labels").alias("name"))

