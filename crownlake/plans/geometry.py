"""Catalogue queries on boxes, tiles and rasters made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.operators import instances, joins, raster
from crownlake.plans.catalogue import load, query

H, W_, K = 48, 64, 12
#: Boxes of parts: position and size follow from keys.
_BOX = "p_partkey AS id, p_partkey * 37 % 1000 AS x0, p_partkey * 91 % 800 AS y0, p_partkey * 37 % 1000 + 5 + p_size AS x1, p_partkey * 91 % 800 + 5 + p_partkey % 40 AS y1"
_RASTER = f"(SELECT CAST(l_orderkey % {H} AS INTEGER) AS y, CAST(l_partkey % {W_} AS INTEGER) AS x, CAST(max(l_suppkey % {K}) AS INTEGER) AS label FROM lineitem GROUP BY 1, 2)"
_SECOND = f"(SELECT CAST(l_partkey % {H} AS INTEGER) AS y, CAST(l_orderkey % {W_} AS INTEGER) AS x, CAST(max(l_linenumber) AS INTEGER) AS label FROM lineitem GROUP BY 1, 2)"
_PIXELS = f"(SELECT * FROM {_RASTER} WHERE label > 0)"


def boxes(spark, d) -> DataFrame:
    return load(spark, d, "part").selectExpr(*[c.strip() for c in _BOX.split(",")], "p_brand AS frame", "p_retailprice AS score", "p_type AS kind")


def pixels(spark, d) -> DataFrame:
    t = load(spark, d, "lineitem").groupBy((F.col("l_orderkey") % H).cast("int").alias("y"), (F.col("l_partkey") % W_).cast("int").alias("x"))
    return t.agg(F.max(F.col("l_suppkey") % K).cast("int").alias("label")).where("label > 0")


def second(spark, d) -> DataFrame:
    t = load(spark, d, "lineitem").groupBy((F.col("l_partkey") % H).cast("int").alias("y"), (F.col("l_orderkey") % W_).cast("int").alias("x"))
    return t.agg(F.max("l_linenumber").cast("int").alias("label"))


_TILES = "(SELECT tx * 192 AS tx0, ty * 192 AS ty0, tx * 192 + 256 AS tx1, ty * 192 + 256 AS ty1 FROM (SELECT unnest(range(6)) AS tx), (SELECT unnest(range(5)) AS ty))"


def tiles(spark) -> DataFrame:
    t = spark.range(6).withColumnRenamed("id", "tx").crossJoin(spark.range(5).withColumnRenamed("id", "ty"))
    return t.selectExpr("tx * 192 AS tx0", "ty * 192 AS ty0", "tx * 192 + 256 AS tx1", "ty * 192 + 256 AS ty1")


@query(f"""SELECT id, tx0, ty0 FROM (SELECT {_BOX} FROM part) b, {_TILES} t WHERE x0 >= tx0 AND y0 >= ty0 AND x1 < tx1 AND y1 < ty1""")
def tile_containment(spark, d):
    return joins.contained(boxes(spark, d), tiles(spark), 192).select("id", "tx0", "ty0")


@query(f"""SELECT id, tx0, ty0 FROM (SELECT {_BOX} FROM part) b, {_TILES} t WHERE x0 < tx1 AND tx0 < x1 AND y0 < ty1 AND ty0 < y1""")
def tile_intersection(spark, d):
    t = tiles(spark).selectExpr("tx0", "ty0", "tx0 AS u0", "ty0 AS v0", "tx1 AS u1", "ty1 AS v1")
    return joins.intersecting(boxes(spark, d), t, 192).select("id", "tx0", "ty0")


@query(f"""SELECT id, wx, wy FROM (SELECT *, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy FROM (SELECT {_BOX} FROM part)), (SELECT * FROM (VALUES {", ".join(map(str, raster.window_cores(1100, 512, 128)))}) v(wx, ax, bx)),
(SELECT * FROM (VALUES {", ".join(map(str, raster.window_cores(900, 512, 128)))}) v(wy, ay, by_)) WHERE cx >= ax AND cx < bx AND cy >= ay AND cy < by_""")
def tile_core_assign(spark, d):
    b = boxes(spark, d)
    return raster.core_owner(b, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, 1100, 900, 512, 128).select("id", "wx", "wy")


@query(f"""SELECT a.id AS p, b.id AS t, round(w * h / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h), 6) AS iou FROM (SELECT {_BOX} FROM part) a, (SELECT {_BOX} FROM part) b,
LATERAL (SELECT least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h) WHERE a.id % 2 = 0 AND b.id % 2 = 1 AND w > 0 AND h > 0""")
def iou_pairs(spark, d):
    b = boxes(spark, d)
    return instances.iou_pairs(b.where("id % 2 = 0"), b.where("id % 2 = 1"), cell=64).withColumn("iou", F.round("iou", 6))


_HIT = "EXISTS (SELECT 1 FROM (SELECT " + _BOX + ", p_brand AS frame FROM part) f WHERE f.id % 2 = 0 AND f.frame = t.frame AND f.x0 < t.x1 AND t.x0 < f.x1 AND f.y0 < t.y1 AND t.y0 < f.y1)"


def _hit(spark, d, missed):
    b = boxes(spark, d)
    return joins.hit_by_any(b.where("id % 2 = 1"), b.where("id % 2 = 0"), ["frame"], "id", 64, missed).select("frame", "id")


@query(f"SELECT frame, id FROM (SELECT {_BOX}, p_brand AS frame FROM part) t WHERE id % 2 = 1 AND {_HIT}")
def exists_hit(spark, d):
    return _hit(spark, d, False)


@query(f"SELECT frame, id FROM (SELECT {_BOX}, p_brand AS frame FROM part) t WHERE id % 2 = 1 AND NOT {_HIT}")
def missed(spark, d):
    return _hit(spark, d, True)


# rasters ----------------------------------------------------------------------------------------


@query(f"""SELECT label, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM {_PIXELS} GROUP BY 1""")
def zonal_stats(spark, d):
    return raster.zonal(pixels(spark, d)).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query(f"""SELECT label, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM {_PIXELS} GROUP BY 1""")
def zonal_from_runs(spark, d):
    out = raster.zonal_runs(raster.runs(pixels(spark, d)))
    return out.select("label", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"""SELECT label, round(2 * sqrt(count(*) / pi()), 6) AS diameter, round(4 * sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)), 6) AS major FROM (SELECT label, x, y,
var_pop(x) OVER (PARTITION BY label) + 1 / 12 AS a, var_pop(y) OVER (PARTITION BY label) + 1 / 12 AS b, covar_pop(x, y) OVER (PARTITION BY label) AS c FROM {_PIXELS}) GROUP BY label, a, b, c""")
def region_properties(spark, d):
    return raster.region_properties(pixels(spark, d)).select("label", F.round("diameter", 6).alias("diameter"), F.round("major", 6).alias("major"))


@query(f"""WITH n AS (SELECT a.label AS p, b.label AS t, count(*) AS n FROM {_PIXELS} a JOIN {_SECOND} b USING (y, x) GROUP BY 1, 2) SELECT p, t, n, round(n / (pa + ta - n), 6) AS iou FROM n
JOIN (SELECT label AS p, count(*) AS pa FROM {_PIXELS} GROUP BY 1) USING (p) JOIN (SELECT label AS t, count(*) AS ta FROM {_SECOND} GROUP BY 1) USING (t)""")
def pixel_overlay(spark, d):
    return raster.overlap(pixels(spark, d), second(spark, d)).withColumn("iou", F.round("iou", 6))


@query(f"""WITH n AS (SELECT a.label AS p, b.label AS t, count(*) AS n FROM {_PIXELS} a JOIN {_SECOND} b USING (y, x) GROUP BY 1, 2) SELECT p, t, n, round(n / (pa + ta - n), 6) AS iou FROM n
JOIN (SELECT label AS p, count(*) AS pa FROM {_PIXELS} GROUP BY 1) USING (p) JOIN (SELECT label AS t, count(*) AS ta FROM {_SECOND} GROUP BY 1) USING (t)""")
def run_overlay(spark, d):
    return raster.run_overlap(raster.runs(pixels(spark, d)), raster.runs(second(spark, d))).withColumn("iou", F.round("iou", 6))


@query(f"""WITH c AS (SELECT a.label, b.label AS class_id, count(*) AS n FROM {_PIXELS} a JOIN {_SECOND} b USING (y, x) GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY label) AS t,
row_number() OVER (PARTITION BY label ORDER BY n DESC, class_id) AS rn FROM c) SELECT label, area, class_id, round(coalesce(t / area, 0), 6) AS coverage, round(coalesce(n / t, 0), 6) AS purity,
coalesce(t / area, 0) >= 0.5 AND coalesce(n / t, 0) >= 0.2 AS usable FROM (SELECT label, count(*) AS area FROM {_PIXELS} GROUP BY 1) LEFT JOIN (SELECT * FROM s WHERE rn = 1) USING (label)""")
def majority_label(spark, d):
    out = raster.majority(pixels(spark, d), second(spark, d), least_purity=0.2)
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("purity", F.round("purity", 6))


_OFFSETS = "(SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) o(dy, dx))"


@query(f"""SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, max((a.y * 7 + a.x * 3) % 50) AS saddle FROM {_PIXELS} a, {_OFFSETS}, {_PIXELS} b
WHERE b.y = a.y + dy AND b.x = a.x + dx AND a.label <> b.label GROUP BY 1, 2""")
def adjacency_saddles(spark, d):
    return raster.saddles(pixels(spark, d).withColumn("value", (F.col("y") * 7 + F.col("x") * 3) % 50))


@query(f"""SELECT y + dy AS y, x + dx AS x, max(label) AS label FROM {_PIXELS}, (SELECT unnest([-1, 0, 1])::INTEGER AS dy), (SELECT unnest([-1, 0, 1])::INTEGER AS dx) WHERE y + dy BETWEEN 0 AND {H - 1} AND x + dx BETWEEN 0 AND {W_ - 1} GROUP BY 1, 2""")
def dilate(spark, d):
    return raster.dilated(pixels(spark, d), 1, (), H, W_)


@query(f"""WITH p AS (SELECT y::INTEGER AS y, x::INTEGER AS x, coalesce(label, 0) AS label FROM (SELECT * FROM (SELECT unnest(range({H})) AS y), (SELECT unnest(range({W_})) AS x)) LEFT JOIN {_PIXELS} USING (y, x))
SELECT a.y, a.x, a.label FROM p a, p b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.label > 0 GROUP BY 1, 2, 3 HAVING min(b.label) <> max(b.label)""")
def dilate_boundary(spark, d):
    return raster.boundary(pixels(spark, d), H, W_)


@query(f"""SELECT y, x, max(rn)::INTEGER AS label FROM (SELECT *, dense_rank() OVER (ORDER BY score, id) AS rn FROM (SELECT p_partkey AS id, p_retailprice AS score, p_partkey * 7 % 60 AS x0, p_partkey * 11 % 40 AS y0, p_size % 9 + 1 AS s
FROM part)), LATERAL (SELECT y0 + unnest(range(s)) AS y), LATERAL (SELECT x0 + unnest(range(s)) AS x) GROUP BY 1, 2""")
def label_map_from_instances(spark, d):
    t = load(spark, d, "part").selectExpr("p_partkey AS inst_id", "p_retailprice AS score", "p_partkey * 7 % 60 AS x0", "p_partkey * 11 % 40 AS y0", "p_size % 9 + 1 AS s")
    t = raster.labelled(t).withColumn("y", F.explode(F.expr("sequence(y0, y0 + s - 1)"))).withColumn("x", F.explode(F.expr("sequence(x0, x0 + s - 1)")))
    return raster.topmost(t)


@query(f"""WITH v AS (SELECT l_linenumber AS frame, CAST(l_orderkey % {H} AS INTEGER) AS y, CAST(l_partkey % {W_} AS INTEGER) AS x, CASE WHEN l_quantity > 30 THEN l_quantity END AS value FROM lineitem),
g AS (SELECT y, x, avg(value) AS m FROM v GROUP BY 1, 2) SELECT y, x, round(coalesce(m, (SELECT sum(value) / count(value) FROM v)), 6) AS value FROM g""")
def masked_pixel_mean(spark, d):
    t = load(spark, d, "lineitem").select((F.col("l_orderkey") % H).cast("int").alias("y"), (F.col("l_partkey") % W_).cast("int").alias("x"), F.when(F.col("l_quantity") > 30, F.col("l_quantity")).alias("value"))
    return raster.filled_mean(t).withColumn("value", F.round("value", 6))


@query(f"""SELECT round(count(*) / {H * W_}, 8) AS coverage FROM {_PIXELS}""")
def coverage(spark, d):
    return raster.coverage(pixels(spark, d), F.lit(H * W_)).withColumn("coverage", F.round("coverage", 8))


@query(f"""SELECT y2::INTEGER AS y, x2::INTEGER AS x, label FROM (SELECT unnest(range(20)) AS y2), (SELECT unnest(range(100)) AS x2), {_PIXELS} WHERE y = y2 * {H} // 20 AND x = x2 * {W_} // 100""")
def nearest_resize(spark, d):
    return raster.nearest(pixels(spark, d), (H, W_), (20, 100))


# greedy operators: order decides, no SQL form ------------------------------------------------------


_IOU = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
_SHARE = f"(({_IOU}) / (({{a}}.x1 - {{a}}.x0) * ({{a}}.y1 - {{a}}.y0) + ({{b}}.x1 - {{b}}.x0) * ({{b}}.y1 - {{b}}.y0) - ({_IOU})))"


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY frame) AS n FROM (SELECT {_BOX}, p_brand AS frame, p_retailprice AS score FROM part)),
k AS (SELECT frame, 1::BIGINT AS rn, [{{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score}}] AS kept FROM r WHERE rn = 1 UNION ALL
SELECT r.frame, r.rn, CASE WHEN len(list_filter(kept, lambda q: {_SHARE.format(a='q', b='r')} >= 0.1)) = 0 THEN list_append(kept, {{'id': r.id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'score': r.score}}) ELSE kept END
FROM k JOIN r ON r.frame = k.frame AND r.rn = k.rn + 1) SELECT frame, q.id AS id, q.score AS score FROM (SELECT k.frame, unnest(kept) AS q FROM k JOIN (SELECT DISTINCT frame, n FROM r) m ON m.frame = k.frame AND m.n = k.rn)""")
def nms_greedy(spark, d):
    return instances.suppressed(boxes(spark, d).select("frame", "id", "x0", "y0", "x1", "y1", "score"), ["frame"], 0.1)


def _frame_sides(spark, d):
    b = boxes(spark, d).selectExpr("frame", "id", "x0 % 200 AS x0", "y0 % 200 AS y0", "x0 % 200 + x1 - x0 AS x1", "y0 % 200 + y1 - y0 AS y1", "score")
    return b.where("id % 2 = 0"), b.where("id % 2 = 1")


_FRAME = "b AS (SELECT frame, id, x0 % 200 AS x0, y0 % 200 AS y0, x0 % 200 + x1 - x0 AS x1, y0 % 200 + y1 - y0 AS y1, score FROM (SELECT " + _BOX + ", p_brand AS frame, p_retailprice AS score FROM part))"
_PAIRS = f"{_FRAME}, pairs AS (SELECT p.frame, p.id AS p, t.id AS t, {_SHARE.format(a='p', b='t')} AS iou FROM b p JOIN b t ON p.frame = t.frame AND p.id % 2 = 0 AND t.id % 2 = 1 WHERE {_IOU.format(a='p', b='t')} > 0)"
_MATCH = f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT frame, p, list({{'iou': iou, 't': t}} ORDER BY iou, t) AS c FROM pairs WHERE iou >= 0.1 GROUP BY 1, 2),
r AS (SELECT b.frame, b.id AS p, b.score, coalesce(c.c, []) AS c, row_number() OVER (PARTITION BY b.frame ORDER BY b.score DESC, b.id) AS rn FROM b LEFT JOIN c ON c.frame = b.frame AND c.p = b.id WHERE b.id % 2 = 0),
m AS (SELECT frame, p, score, rn, c[-1] AS best, list_filter([c[-1].t], lambda x: x IS NOT NULL) AS taken FROM r WHERE rn = 1 UNION ALL
SELECT r.frame, r.p, r.score, r.rn, list_filter(r.c, lambda q: NOT list_contains(m.taken, q.t))[-1], list_concat(m.taken, list_filter([list_filter(r.c, lambda q: NOT list_contains(m.taken, q.t))[-1].t], lambda x: x IS NOT NULL))
FROM m JOIN r ON r.frame = m.frame AND r.rn = m.rn + 1) """


@query(_MATCH + "SELECT frame, p, score, coalesce(best.t, -1) AS t, round(best.iou, 6) AS iou FROM m")
def match_greedy(spark, d):
    return instances.matched_boxes(*_frame_sides(spark, d), ["frame"], 0.1).withColumn("iou", F.round("iou", 6)).fillna(-1, ["t"])


@query(f"""WITH RECURSIVE {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY iou DESC, p, t) AS rn FROM pairs WHERE iou >= 0.1),
m AS (SELECT frame, rn, p, t, iou, true AS good, [p] AS ps, [t] AS ts FROM r WHERE rn = 1 UNION ALL
SELECT r.frame, r.rn, r.p, r.t, r.iou, NOT list_contains(ps, r.p) AND NOT list_contains(ts, r.t), CASE WHEN NOT list_contains(ps, r.p) AND NOT list_contains(ts, r.t) THEN list_append(ps, r.p) ELSE ps END,
CASE WHEN NOT list_contains(ps, r.p) AND NOT list_contains(ts, r.t) THEN list_append(ts, r.t) ELSE ts END FROM m JOIN r ON r.frame = m.frame AND r.rn = m.rn + 1) SELECT frame, p, t, round(iou, 6) AS iou FROM m WHERE good""")
def match_by_iou(spark, d):
    return instances.matched_boxes(*_frame_sides(spark, d), ["frame"], 0.1, "iou").withColumn("iou", F.round("iou", 6))


@query(_MATCH + """SELECT substring(frame, 1, 7) AS area, coalesce(sum(n_pred), 0)::BIGINT AS pred, coalesce(sum(n_true), 0)::BIGINT AS gt, coalesce(sum(hits), 0)::BIGINT AS hits, round(coalesce(sum(s) / nullif(sum(hits), 0), 0), 6) AS mean_iou,
round(coalesce(sum(hits), 0) / greatest(1, coalesce(sum(n_pred), 0)), 6) AS precision, round(coalesce(sum(hits), 0) / greatest(1, coalesce(sum(n_true), 0)), 6) AS recall
FROM (SELECT frame, count(*) AS n_pred, count(best.t) AS hits, coalesce(sum(best.iou), 0) AS s FROM m GROUP BY 1) e FULL JOIN (SELECT frame, count(*) AS n_true FROM b WHERE id % 2 = 1 GROUP BY 1) t USING (frame) GROUP BY 1""")
def tile_evaluation(spark, d):
    from crownlake.operators import metrics

    own, truth = _frame_sides(spark, d)
    found = instances.matched_boxes(own, truth, ["frame"], 0.1)
    truths = truth.groupBy("frame").agg(F.count("*").cast("int").alias("n_true"))
    out = metrics.micro(instances.evaluated(found, truths, ["frame"]).withColumn("area", F.substring("frame", 1, 7)), ["area"], iou_sum="iou_sum")
    return out.select("area", "pred", "gt", "hits", *[F.round(c, 6).alias(c) for c in ("mean_iou", "precision", "recall")])


@query("""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY frame) AS n FROM (SELECT frame, id, score, list_transform(range(49), lambda k: (y0 % 60 + k // 7) * 1000 + x0 % 60 + k % 7) AS px
FROM (SELECT """ + _BOX + """, p_brand AS frame, p_retailprice AS score FROM part))),
k AS (SELECT frame, rn, id, true AS good, px AS claimed FROM r WHERE rn = 1 UNION ALL SELECT r.frame, r.rn, r.id, len(list_filter(r.px, lambda q: list_contains(claimed, q))) / 49 <= 0.3,
CASE WHEN len(list_filter(r.px, lambda q: list_contains(claimed, q))) / 49 <= 0.3 THEN list_concat(claimed, r.px) ELSE claimed END FROM k JOIN r ON r.frame = k.frame AND r.rn = k.rn + 1) SELECT frame, id, 49::BIGINT AS area FROM k WHERE good""")
def occupied_union(spark, d):
    b = boxes(spark, d).selectExpr("frame", "id", "score", "explode(sequence(y0 % 60, y0 % 60 + 6)) AS y", "x0 % 60 AS x0")
    return instances.unclaimed(b.selectExpr("frame", "id", "score", "y", "explode(sequence(x0, x0 + 6)) AS x"), ["frame"]).groupBy("frame", "id").agg(F.count("*").alias("area"))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT frame, p AS a, t AS b FROM pairs UNION SELECT frame, t, p FROM pairs), c AS (SELECT frame, a, b FROM e UNION SELECT c.frame, c.a, e.b FROM c JOIN e ON e.frame = c.frame AND e.a = c.b)
SELECT frame, a AS node, least(a, min(b)) AS root FROM c GROUP BY frame, a""")
def components(spark, d):
    return instances.box_components(*_frame_sides(spark, d), ["frame"])


@query()
def merge_round(spark, d):
    p = pixels(spark, d).withColumn("value", ((F.col("y") * 7 + F.col("x") * 3) % 50).cast("double")).withColumn("frame", F.lit(1))
    edges = raster.saddles(p, ["frame"]).withColumn("span", F.lit(50.0))
    regions = p.groupBy("frame", "label").agg(F.max("value").alias("peak"), F.count("*").cast("double").alias("area"), F.avg("x").alias("l"), F.avg("y").alias("ca"), F.lit(0.0).alias("cb"))
    return instances.merged(edges, regions, ["frame"], most_area=900.0)


@query(f"""SELECT top::BIGINT AS top, "left"::BIGINT AS "left", n FROM (SELECT t.top, t."left", count(DISTINCT label) AS n FROM {_PIXELS}, (SELECT a * 4 AS top, b * 4 AS "left" FROM (SELECT unnest(range({H // 4})) AS a), (SELECT unnest(range({W_ // 4})) AS b)) t
WHERE y >= t.top AND y < t.top + 16 AND x >= t."left" AND x < t."left" + 16 GROUP BY 1, 2) ORDER BY n DESC, top, "left" LIMIT 1""")
def densest_window(spark, d):
    from crownlake.operators import rank

    return rank.densest_window(pixels(spark, d), 16)


@query(f"""WITH s AS (SELECT y::INTEGER AS y, x::INTEGER AS x, ((y * 7 + x * 3) % 50)::DOUBLE AS v FROM (SELECT unnest(range({H})) AS y), (SELECT unnest(range({W_})) AS x))
SELECT a.y, a.x, CASE WHEN u.v IS NULL THEN w.v - a.v WHEN w.v IS NULL THEN a.v - u.v ELSE (w.v - u.v) / 2 END AS gy FROM s a LEFT JOIN s u ON u.x = a.x AND u.y = a.y - 1 LEFT JOIN s w ON w.x = a.x AND w.y = a.y + 1""")
def surface_gradient(spark, d):
    s = spark.range(H * W_).selectExpr(f"CAST(id DIV {W_} AS INT) AS y", f"CAST(id % {W_} AS INT) AS x")
    return raster.gradient(s.withColumn("value", ((F.col("y") * 7 + F.col("x") * 3) % 50).cast("double"))).select("y", "x", "gy")
