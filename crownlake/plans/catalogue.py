"""The query catalogue: table queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.functions import scalar as S
from crownlake.operators import joins, metrics, rank, tables, vectors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    from crownlake.plans import files, geometry, rules  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# summaries -------------------------------------------------------------------------------------


@query("""SELECT l_returnflag AS folder, count(*) AS n, round(median(l_extendedprice), 4) AS med_diameter, round(median(l_quantity), 4) AS med_compactness,
round(avg(l_discount), 4) AS mean_coverage FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def folder_summary(spark, d):
    t = load(spark, d, "lineitem").withColumnRenamed("l_returnflag", "folder")
    return tables.group_summary(t, ["folder"], medians={"med_diameter": "l_extendedprice", "med_compactness": "l_quantity"}, means={"mean_coverage": "l_discount"}, digits=4)


@query("""SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS units, round(count(*) / count(DISTINCT o_custkey), 1) AS per_unit FROM orders GROUP BY 1""")
def per_frame_ratio(spark, d):
    return tables.per_distinct(load(spark, d, "orders"), "o_orderstatus", "o_custkey")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (value > 50) AS n_high
FROM events GROUP BY 1""")
def source_counts(spark, d):
    c = F.col("event_type")
    return tables.condition_counts(load(spark, d, "events"), ["user_id"], {"n_click": c == "click", "n_view": c == "view", "n_high": F.col("value") > 50})


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    return tables.pivot_counts(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority", _PRIORITIES)


@query("""SELECT l_linenumber, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS mean_f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS mean_o,
min(l_orderkey) FILTER (l_linestatus = 'F') AS first_f, min(l_orderkey) FILTER (l_linestatus = 'O') AS first_o FROM lineitem GROUP BY 1""")
def pivot_first_mean(spark, d):
    t = load(spark, d, "lineitem")
    mean = tables.pivot_value(t, "l_linenumber", "l_linestatus", ["F", "O"], F.round(F.avg("l_quantity"), 4)).toDF("l_linenumber", "mean_f", "mean_o")
    first = tables.pivot_value(t, "l_linenumber", "l_linestatus", ["F", "O"], F.min("l_orderkey")).toDF("l_linenumber", "first_f", "first_o")
    return mean.join(first, "l_linenumber")


@query("""SELECT nation, max(bal) FILTER (seg = 'AUTOMOBILE') AS automobile, max(bal) FILTER (seg = 'BUILDING') AS building FROM
(SELECT c_nationkey AS nation, c_mktsegment AS seg, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1, 2) GROUP BY 1""")
def strict_pivot(spark, d):
    t = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg")).agg(F.round(F.sum("c_acctbal"), 2).alias("bal"))
    return tables.strict_pivot(t, "nation", "seg", ["AUTOMOBILE", "BUILDING"], "bal").toDF("nation", "automobile", "building")


@query("""SELECT lang, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)""")
def value_counts_share(spark, d):
    return tables.value_counts(load(spark, d, "documents"), "lang").withColumn("share", F.round("share", 6))


@query("""SELECT source, n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) ORDER BY n DESC, source LIMIT 5""")
def value_counts_head(spark, d):
    return tables.value_counts(load(spark, d, "documents"), "source", 5).drop("share")


@query("""SELECT p_brand, p_type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank
FROM part GROUP BY 1, 2) WHERE rank <= 3""")
def top3_per_group(spark, d):
    return tables.top_values(load(spark, d, "part"), "p_brand", "p_type", 3)


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def size_two_keys(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT bin, count(*) AS n, round(avg(l_discount), 4) AS mean FROM (SELECT l_discount, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '0-10' WHEN l_quantity > 10 AND l_quantity <= 40
THEN '10-40' WHEN l_quantity > 40 AND l_quantity <= 200 THEN '40-200' END AS bin FROM lineitem) WHERE bin IS NOT NULL GROUP BY 1""")
def score_histogram(spark, d):
    return tables.histogram(load(spark, d, "lineitem"), "l_quantity", [0, 10, 40, 200], "l_discount")


@query("""SELECT event_type, count(*) AS groups, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1""")
def site_mean_of_means(spark, d):
    return tables.mean_of_means(load(spark, d, "events"), "event_type", "user_id", "value")


@query("""SELECT o_orderpriority, count(*) AS n, arg_min(o_custkey, o_orderkey) AS first, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std,
round(max(o_totalprice) - min(o_totalprice), 4) AS range, CASE WHEN round(max(o_totalprice) - min(o_totalprice), 4) < 5 THEN 'good' WHEN round(max(o_totalprice) - min(o_totalprice), 4) < 12
THEN 'fair' ELSE 'poor' END AS verdict FROM orders GROUP BY 1""")
def calibration_spread(spark, d):
    return tables.spread(load(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_custkey", [F.col("o_orderkey")])


@query("""SELECT p_brand, p_size, price FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY price, p_size) AS rn FROM
(SELECT p_brand, p_size, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2)) WHERE rn = 1""")
def argmin_setting(spark, d):
    means = load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("price"))
    return tables.first_row(means, ["p_brand"], [F.col("price"), F.col("p_size")])


@query("""SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 0), 8) AS mean FROM lineitem GROUP BY 1, 2""")
def weighted_mean(spark, d):
    t = load(spark, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(tables.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("mean"))


@query("""SELECT round(user_mod, 4) AS user_mod, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p02, 4) AS p02, round(p98, 4) AS p98 FROM (SELECT l_linenumber AS user_mod,
quantile_cont(l_extendedprice, 0.02) AS p02, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.98) AS p98 FROM lineitem GROUP BY 1)""")
def percentile_profile(spark, d):
    t = load(spark, d, "lineitem").withColumn("user_mod", F.col("l_linenumber"))
    return tables.percentiles(t, ["user_mod"], "l_extendedprice", [2, 50, 95, 98])


@query("""SELECT l_returnflag, count(*) AS n, round(min(unit), 6) AS low, round(max(unit), 6) AS high, round(avg(unit), 6) AS mean FROM (SELECT l.l_returnflag,
least(1, greatest(0, coalesce((l_quantity - a) / nullif(b - a, 0), 0))) AS unit FROM lineitem l JOIN (SELECT l_returnflag, quantile_cont(l_quantity, 0.02) AS a, quantile_cont(l_quantity, 0.98) AS b
FROM lineitem GROUP BY 1) p ON l.l_returnflag = p.l_returnflag) GROUP BY 1""")
def robust_normalise(spark, d):
    t = tables.robust_unit(load(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return t.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.min("unit"), 6).alias("low"), F.round(F.max("unit"), 6).alias("high"), F.round(F.avg("unit"), 6).alias("mean"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) >= 290) GROUP BY 1""")
def frequent_classes(spark, d):
    return tables.keep_frequent(load(spark, d, "customer"), "c_mktsegment", 290).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, n, round((SELECT count(DISTINCT c_mktsegment) FROM customer) / n / (SELECT sum(1 / n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)), 8) AS weight
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def class_weights(spark, d):
    return metrics.class_weights(load(spark, d, "customer"), "c_mktsegment").withColumn("weight", F.round("weight", 8))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_first(spark, d):
    return tables.dedupe_first(load(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("""SELECT 'event' AS kind, event_id AS id, value, NULL AS role FROM events UNION ALL SELECT 'turn', conv_id * 1000 + turn, NULL, role FROM conversations""")
def union_by_name(spark, d):
    a = load(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "value")
    b = load(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return tables.union_all([a, b])


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 7 = 0""")
def upsert_rows(spark, d):
    t = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return tables.upsert(t, t.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("""SELECT p_partkey, p_size FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)""")
def skip_done(spark, d):
    return tables.to_do(load(spark, d, "part").select("p_partkey", "p_size"), load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("""SELECT p_brand, count(*) AS n FROM (SELECT p_brand, p_size * 40.0 AS area, p_retailprice / 150 AS c FROM part) WHERE area BETWEEN 0.12 * pi() * 400 AND 5.0 * pi() * 400 AND c >= 0.4 GROUP BY 1""")
def shape_filter(spark, d):
    t = load(spark, d, "part").select("p_brand", (F.col("p_size") * 40.0).alias("area_px"), (F.col("p_retailprice") / 150).alias("compactness"))
    return tables.shape_filter(t, 40, compact=0.4).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""SELECT event_type, user_id, event_id, value >= 20 AND user_id >= 10 AND event_id >= 10 AND row_number() OVER (PARTITION BY event_type, value >= 20 AND user_id >= 10 AND event_id >= 10
ORDER BY value DESC, event_id) <= 40 AS kept FROM events""")
def rank_flag(spark, d):
    t = load(spark, d, "events").select("event_type", "event_id", "user_id", F.col("value").alias("score"), F.col("user_id").alias("box_w"), F.col("event_id").alias("box_h"))
    flagged = tables.detection_flags(t, 20, 10, 40, ["event_type"], ["event_id"])
    return flagged.select("event_type", "user_id", "event_id", "kept")


# ranks and sequences ------------------------------------------------------------------------------


@query("""SELECT lang, n, n_first FROM (SELECT lang, count(*) AS n, min(doc_id) AS n_first FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn,
count(*) OVER (PARTITION BY lang) AS c FROM documents) WHERE rn % greatest(1, c // 20) = 0 AND rn // greatest(1, c // 20) < 20 GROUP BY 1)""")
def even_sample(spark, d):
    t = rank.even_sample(load(spark, d, "documents"), ["lang"], ["doc_id"], 20)
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("n_first"))


@query("""SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3""")
def stratified_head(spark, d):
    return rank.head(load(spark, d, "documents"), ["source"], ["doc_id"], 3).select("source", "doc_id")


@query("""SELECT user_id, ordinal, CASE ordinal % 9 WHEN 0 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS ordinal
FROM (SELECT DISTINCT user_id FROM events))""")
def mod_split(spark, d):
    return rank.modulo_split(load(spark, d, "events"), "user_id")


@query("""SELECT nation, c_custkey, CASE WHEN bal > 0 THEN dense_rank() OVER (PARTITION BY nation, bal > 0 ORDER BY bal) ELSE 0 END AS id FROM
(SELECT c_nationkey AS nation, c_custkey, greatest(0, CAST(floor(c_acctbal / 100) AS INTEGER)) AS bal FROM customer)""")
def dense_renumber(spark, d):
    t = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100).cast("int")).alias("label"))
    return rank.renumbered(t, ["nation"]).select("nation", "c_custkey", F.col("id").cast("long").alias("id"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT day, n, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS c FROM d),
p AS (SELECT a.day, a.n, (SELECT b.n FROM w b WHERE b.rn = least(greatest(a.rn + o, 1), a.c)) AS v FROM w a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o))
SELECT CAST(day AS VARCHAR) AS day, n, median(v)::BIGINT AS running_median FROM p GROUP BY 1, 2""")
def running_median(spark, d):
    daily = load(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return rank.running_median(daily, ["one"], "day", "n", 5).drop("one")


@query("""SELECT user_id, event_id AS item, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS partner FROM events QUALIFY partner IS NOT NULL""")
def stride_pairs(spark, d):
    return joins.stride_pairs(load(spark, d, "events"), ["user_id"], ["event_id"], "event_id", 2)


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT a.user_id, a.event_id AS item, b.event_id AS partner, CAST(o AS INTEGER) AS "offset" FROM r a, (SELECT unnest([-8, -4, -2, 2, 4, 8]) AS o), r b WHERE b.user_id = a.user_id AND b.rn = a.rn + o""")
def ordinal_partners(spark, d):
    return joins.ordinal_partners(load(spark, d, "events"), ["user_id"], ["event_id"], "event_id")


@query("""SELECT a.c_nationkey AS nation, a.c_mktsegment AS seg, a.c_custkey AS item, b.c_custkey AS partner FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
AND a.c_custkey <> b.c_custkey""")
def frame_pairs(spark, d):
    t = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), "c_custkey")
    return joins.pairs_in_group(t, ["nation"], "c_custkey", ["seg"], most=20_000)


@query("""WITH r AS (SELECT o_orderstatus, o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2 AS rx,
rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2 AS ry FROM orders) SELECT o_orderstatus, count(*) AS n,
round(corr(rx, ry), 6) AS r FROM r GROUP BY 1""")
def spearman(spark, d):
    t = load(spark, d, "orders")
    ranked = t.withColumn("rx", rank.average_rank("o_totalprice", ["o_orderstatus"])).withColumn("ry", rank.average_rank("o_custkey", ["o_orderstatus"]))
    return metrics.correlation(ranked, ["o_orderstatus"], "rx", "ry").withColumn("r", F.round("r", 6))


# vectors and probabilities ----------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:14], lambda x: exp(x::DOUBLE - list_max(embedding[1:14])::DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), u AS (SELECT vec_id, p, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rn FROM u)
SELECT vec_id, max(i) FILTER (rn = 1)::INTEGER AS top1, max(i) FILTER (rn = 2)::INTEGER AS top2, max(i) FILTER (rn = 3)::INTEGER AS top3, round(max(v) FILTER (rn = 1), 6) AS p1,
round(-sum(v * ln(v + 1e-12)), 6) AS entropy FROM r GROUP BY 1""")
def topk_probs(spark, d):
    t = load(spark, d, "embeddings").select("vec_id", S.softmax(F.slice("embedding", 1, 14)).alias("p"))
    top = t.withColumn("t", S.top_classes(F.col("p"), 3))
    return top.select("vec_id", *[F.col("t")[k]["i"].alias(f"top{k + 1}") for k in range(3)], F.round(F.col("t")[0]["p"], 6).alias("p1"), F.round(S.entropy(F.col("p")), 6).alias("entropy"))


@query("""SELECT vec_id, pos, round(v - avg(v) OVER (PARTITION BY label, pos), 5) + 0.0::DOUBLE AS v FROM (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)""")
def center_per_group(spark, d):
    t = vectors.centred(load(spark, d, "embeddings"), ["label"], "embedding")
    return t.select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("""SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm, round(e[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(1e-9,
sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))) AS e FROM embeddings)""")
def l2_normalise(spark, d):
    t = vectors.normalised(load(spark, d, "embeddings"), "embedding")
    return t.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.col("embedding")[0], 6).alias("first"))


# evaluation ------------------------------------------------------------------------------------


@query("""SELECT sum(toxic)::BIGINT AS pred, sum(quality)::BIGINT AS gt, sum(quality * toxic)::BIGINT AS hits, round(sum(quality * toxic) / greatest(1, sum(toxic)), 8) AS precision,
round(sum(quality * toxic) / greatest(1, sum(quality)), 8) AS recall, round(2 * (sum(quality * toxic) / greatest(1, sum(toxic))) * (sum(quality * toxic) / greatest(1, sum(quality)))
/ greatest(1e-9, sum(quality * toxic) / greatest(1, sum(toxic)) + sum(quality * toxic) / greatest(1, sum(quality))), 8) AS f1 FROM labels""")
def micro_prf(spark, d):
    t = load(spark, d, "labels").withColumn("hit", F.col("quality") * F.col("toxic"))
    out = metrics.micro(t, [], "toxic", "quality", "hit")
    return out.select("pred", "gt", "hits", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn, sum((user_id % 3 = 0)::INT) OVER (PARTITION BY event_type ORDER BY value DESC, event_id
ROWS UNBOUNDED PRECEDING) AS tp FROM events), t AS (SELECT event_type, count(*) FILTER (user_id % 3 = 0) + 5 AS n_true FROM events GROUP BY 1),
e AS (SELECT r.event_type, rn, tp / n_true AS rec, max(tp / rn) OVER (PARTITION BY r.event_type ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r JOIN t USING (event_type)),
g AS (SELECT event_type, k / 100 AS x FROM t, (SELECT unnest(range(101)) AS k)),
lo AS (SELECT g.event_type, g.x, max(e.rec) AS r1, arg_max(e.env, e.rn) AS p1 FROM g JOIN e ON e.event_type = g.event_type AND e.rec <= g.x + 1e-12 GROUP BY 1, 2),
hi AS (SELECT g.event_type, g.x, min(e.rec) AS r2, arg_min(e.env, e.rn) AS p2 FROM g JOIN e ON e.event_type = g.event_type AND e.rec > g.x + 1e-12 GROUP BY 1, 2),
f AS (SELECT event_type, arg_min(env, rn) AS p0 FROM e GROUP BY 1)
SELECT event_type, round(avg(CASE WHEN r1 IS NULL THEN p0 WHEN r2 IS NULL THEN CASE WHEN abs(x - r1) < 1e-9 THEN p1 ELSE 0 END ELSE p1 + (p2 - p1) * (x - r1) / (r2 - r1) END), 6) AS ap
FROM g LEFT JOIN lo USING (event_type, x) LEFT JOIN hi USING (event_type, x) LEFT JOIN f USING (event_type) GROUP BY 1""")
def pooled_ap(spark, d):
    t = load(spark, d, "events").withColumn("hit", (F.col("user_id") % 3 == 0).cast("int"))
    truths = t.groupBy("event_type").agg((F.sum("hit") + 5).alias("n_true"))
    return metrics.ap_linear101(t, truths, ["event_type"], "value", "hit", ["event_id"]).withColumn("ap", F.round("ap", 6))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, sum(l_extendedprice) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT count(*) AS n,
round(avg(abs(s - o_totalprice) / o_totalprice), 6) AS absrel, round(avg(abs(s - o_totalprice)), 4) AS mae, round(sqrt(avg((s - o_totalprice) ** 2)), 4) AS rmse,
round(avg(s - o_totalprice), 4) AS bias, round(avg((greatest(s / o_totalprice, o_totalprice / s) < 1.25)::INT), 6) AS delta125, round(median(s) / median(o_totalprice), 6) AS scale_error FROM s""")
def error_metrics(spark, d):
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("pred"))
    t = load(spark, d, "orders").join(l, "o_orderkey").withColumnRenamed("o_totalprice", "truth")
    out = metrics.error_metrics(t, [])
    return out.select("n", F.round("absrel", 6).alias("absrel"), *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")], *[F.round(c, 6).alias(c) for c in ("delta125", "scale_error")])


@query("""SELECT l_linenumber, count(*) AS n, round(CASE WHEN stddev_pop(l_quantity) * stddev_pop(c) = 0 THEN NULL ELSE covar_pop(l_quantity, c) / (stddev_pop(l_quantity) * stddev_pop(c)) END, 6) AS r
FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 5.0 ELSE l_extendedprice END AS c FROM lineitem) GROUP BY 1""")
def corr_guarded(spark, d):
    t = load(spark, d, "lineitem").withColumn("c", F.when(F.col("l_linenumber") == 1, 5.0).otherwise(F.col("l_extendedprice")))
    return metrics.correlation(t, ["l_linenumber"], "l_quantity", "c").withColumn("r", F.round("r", 6))


_CONTINGENCY = """WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), s AS (SELECT sum(n) AS t FROM t), a AS (SELECT a, sum(n) AS na, max(n) AS top FROM t GROUP BY 1),
b AS (SELECT b, sum(n) AS nb FROM t GROUP BY 1), m AS (SELECT sum(n / s.t * ln(n * s.t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS cab FROM t JOIN a USING (a) JOIN b USING (b), s),
ha AS (SELECT sum(-na / s.t * ln(na / s.t)) AS h, sum(na * (na - 1) / 2) AS c, sum(top) AS top FROM a, s), hb AS (SELECT sum(-nb / s.t * ln(nb / s.t)) AS h, sum(nb * (nb - 1) / 2) AS c FROM b, s) """


@query(_CONTINGENCY + """SELECT round(ha.top / s.t, 6) AS purity, round(mi / sqrt(ha.h * hb.h), 6) AS nmi_geometric, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi_arithmetic FROM m, ha, hb, s""")
def nmi_purity(spark, d):
    out = metrics.cluster_scores(metrics.contingency(load(spark, d, "labels"), "quality", "toxic"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("purity", "nmi_geometric", "nmi_arithmetic")])


@query(_CONTINGENCY + """SELECT round((cab - ha.c * hb.c / (s.t * (s.t - 1) / 2)) / ((ha.c + hb.c) / 2 - ha.c * hb.c / (s.t * (s.t - 1) / 2)), 6) AS ari FROM m, ha, hb, s""")
def ari(spark, d):
    return metrics.cluster_scores(metrics.contingency(load(spark, d, "labels"), "quality", "toxic")).select(F.round("ari", 6).alias("ari"))


@query("""WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2) SELECT a AS truth, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (a = b), 0)::BIGINT AS hits,
round(coalesce(sum(n) FILTER (a = b), 0) / sum(n), 8) AS recall, arg_max(b, n * 10 - b) AS most_frequent FROM t GROUP BY 1""")
def confusion_recall(spark, d):
    return metrics.class_recall(load(spark, d, "labels"), "quality", "toxic").withColumn("recall", F.round("recall", 8)).withColumn("most_frequent", F.col("most_frequent").cast("int"))


@query("""SELECT round(avg((quality = toxic)::INT), 8) AS accuracy, round((SELECT avg(r) FROM (SELECT avg((quality = toxic)::INT) AS r FROM labels GROUP BY quality)), 8) AS balanced_accuracy, count(*) AS n FROM labels""")
def balanced_accuracy(spark, d):
    out = metrics.accuracy(load(spark, d, "labels"), "quality", "toxic")
    return out.select(F.round("accuracy", 8).alias("accuracy"), F.round("balanced_accuracy", 8).alias("balanced_accuracy"), "n")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS rn,
sum(n) OVER (PARTITION BY l_suppkey) AS t FROM c) SELECT l_suppkey, l_returnflag AS majority, round(n / t, 6) AS purity FROM r WHERE rn = 1""")
def majority_purity(spark, d):
    top = tables.top_values(load(spark, d, "lineitem"), "l_suppkey", "l_returnflag", 1)
    total = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("t"))
    return top.join(total, "l_suppkey").select("l_suppkey", F.col("l_returnflag").alias("majority"), F.round(F.col("n") / F.col("t"), 6).alias("purity"))


# look-ups and strings ---------------------------------------------------------------------------


@query("""SELECT p_partkey, coalesce(nullif(try_cast(CASE WHEN p_size = 7 THEN 99 END AS DOUBLE), 0), nullif(try_cast(nullif(regexp_extract(p_brand, '(\\d{2})$', 1), '') AS DOUBLE), 0), 50.0) AS altitude,
CASE WHEN p_size = 7 THEN 'override' WHEN regexp_extract(p_brand, '(\\d{2})$', 1) <> '' THEN 'parsed' ELSE 'default' END AS source FROM part""")
def priority_lookup(spark, d):
    t = load(spark, d, "part")
    digits = F.regexp_extract("p_brand", r"(\d{2})$", 1)
    value, source = joins.prioritised([("override", F.when(F.col("p_size") == 7, 99.0)), ("parsed", S.altitude(digits)), ("default", F.lit(50.0))])
    return t.select("p_partkey", value.alias("altitude"), source.alias("source"))


@query("""SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)""")
def first_match_join(spark, d):
    return joins.first_match(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unmatched(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS has_orders, b.k IS NOT NULL AS has_events FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k""")
def variant_full_outer(spark, d):
    return joins.full_variants({"orders": load(spark, d, "orders").select(F.col("o_custkey").alias("k")), "events": load(spark, d, "events").select(F.col("user_id").alias("k"))}, ["k"])


@query("""SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def dimension_lookup(spark, d):
    dim = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return joins.dimension(load(spark, d, "customer"), dim, ["c_nationkey"], "inner").groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_annotations(spark, d):
    t = load(spark, d, "events")
    packed = t.groupBy("event_type").agg(F.to_json(F.collect_list(F.from_json("props", "k string"))).alias("j"))
    back = packed.select("event_type", F.explode(F.from_json("j", "array<struct<k:string>>")).alias("r"))
    return back.groupBy("event_type", F.col("r.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN len(w) > 1 AND regexp_matches(substring(p_name, 1, 1), '[A-Z]') THEN substring(w[1], 1, 1) || '. ' || w[2] ELSE w[1] END AS short,
w[len(w)] AS last FROM (SELECT p_partkey, p_name, string_split_regex(trim(p_name), '\\s+') AS w FROM part)""")
def short_name(spark, d):
    return load(spark, d, "part").select("p_partkey", S.short_name(F.col("p_name")).alias("short"), S.last_word(F.col("p_name")).alias("last"))


@query("""SELECT p_partkey, round(2 * h * tan(radians(73.7) / 2) / 1920, 8) AS gsd, greatest(16, round_even(9.728 / (2 * h * tan(radians(73.7) / 2) / 1920), 0)::INT) AS crop,
round((p_size - 959.5) * h / 1280, 6) AS x, round(-(p_size - 539.5) * h / 1280, 6) AS y, round(100 - h, 6) AS z FROM (SELECT *, p_retailprice / 20 AS h FROM part)""")
def gsd_backproject(spark, d):
    t = load(spark, d, "part").withColumn("h", F.col("p_retailprice") / 20)
    g = S.gsd(F.col("h"), 73.7, 1920.0)
    x, y, z = S.back_project(F.col("p_size"), F.col("p_size"), F.col("h"), 1920, 1080, 1280.0, 100.0)
    return t.select("p_partkey", F.round(g, 8).alias("gsd"), S.crop_px(9.728, g).alias("crop"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 4""")
def top_rows(spark, d):
    return tables.top_rows(load(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 4).select("c_mktsegment", "c_custkey")


@query("""SELECT n_nationkey AS id, n_name AS name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS "index" FROM nation WHERE n_nationkey NOT IN (2, 3, 10)""")
def class_list(spark, d):
    return tables.class_list(load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':0'), c_custkey) AS rn FROM customer) WHERE rn <= 6""")
def hashed_sample(spark, d):
    return tables.hashed_sample(load(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 6).select("c_mktsegment", "c_custkey")


@query("""WITH g AS (SELECT s_nationkey, row_number() OVER (ORDER BY md5(s_nationkey || ':0'), s_nationkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT s_nationkey FROM supplier))
SELECT s_suppkey, s_nationkey, rn <= greatest(1, floor(n * 0.25)) AS held_out FROM supplier JOIN g USING (s_nationkey)""")
def group_split(spark, d):
    return tables.group_split(load(spark, d, "supplier"), "s_nationkey").select("s_suppkey", "s_nationkey", "held_out")


@query("""SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER AS class_id FROM customer""")
def encode_classes(spark, d):
    return tables.encoded(load(spark, d, "customer"), "c_mktsegment", 1).select("c_custkey", "class_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 - 2 AS i FROM events) WHERE i >= 0 AND i % 3 = 0 AND i < 12""")
def frame_selection(spark, d):
    return rank.strided(load(spark, d, "events"), ["user_id"], ["event_id"], 2, 3, 4).select("user_id", "event_id")


@query("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def best_setting(spark, d):
    t = rank.best_setting(load(spark, d, "part"), ["p_brand"], F.col("p_size") * F.col("p_retailprice"), ["p_partkey"])
    return t.select("p_brand", "p_partkey")


@query("""SELECT user_id, event_id AS epoch, value, epochs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS epochs FROM events) WHERE rn = 1""")
def early_best(spark, d):
    t = rank.early_best(load(spark, d, "events"), ["user_id"], "event_id", "value")
    return t.select("user_id", F.col("event_id").alias("epoch"), "value", "epochs")


@query("""WITH g AS (SELECT s_nationkey, row_number() OVER (ORDER BY md5(s_nationkey || ':0'), s_nationkey) - 1 AS g FROM (SELECT DISTINCT s_nationkey FROM supplier)),
i AS (SELECT s_nationkey, s_suppkey, g, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey || ':0'), s_suppkey) - 1 AS i FROM supplier JOIN g USING (s_nationkey))
SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (ORDER BY g // 3, i // 2, i % 2, g) - 1 AS INTEGER) AS place FROM i""")
def interleaved_plan(spark, d):
    return rank.interleaved(load(spark, d, "supplier"), "s_nationkey", "s_suppkey", 3, 2).select("s_nationkey", "s_suppkey", "place")


@query("""SELECT l_linestatus, count(*) AS n, round(avg((l_discount > 0.05)::INT), 6) AS share FROM lineitem GROUP BY 1""")
def condition_share(spark, d):
    return tables.binned_share(load(spark, d, "lineitem"), ["l_linestatus"], F.col("l_discount") > 0.05)


@query("""SELECT c.c_mktsegment, m.model, count(*) AS n, round(avg(c.c_acctbal * m.f), 4) AS mean FROM customer c, (SELECT unnest(['a', 'b', 'c']) AS model, unnest([0.5, 1.0, 2.0]) AS f) m GROUP BY 1, 2""")
def parameter_grid(spark, d):
    grid = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 2.0)], "model string, f double")
    t = load(spark, d, "customer").crossJoin(F.broadcast(grid))
    return t.groupBy("c_mktsegment", "model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("c_acctbal") * F.col("f")), 4).alias("mean"))


@query("""WITH x AS (SELECT o_orderpriority AS site, o_custkey AS crop, o_totalprice / 1000 AS d, o_totalprice / 900 AS g FROM orders), m AS (SELECT site, crop % 7 AS crop, avg(abs(d - g) / g) AS a, avg(abs(d - g)) AS b FROM x GROUP BY 1, 2),
s AS (SELECT site, avg(a) AS a, avg(b) AS b FROM m GROUP BY 1) SELECT count(*) AS sites, round(avg(a), 6) AS absrel, round(avg(b), 6) AS mae FROM s""")
def depth_evaluation(spark, d):
    from crownlake.operators import height

    t = load(spark, d, "orders").select(F.col("o_orderpriority").alias("site"), (F.col("o_custkey") % 7).alias("crop"), F.lit(80.0).alias("altitude_m"), (F.col("o_totalprice") / 1000).alias("d_pred"), (F.col("o_totalprice") / 900).alias("d_gt"))
    overall, _ = height.depth_report(t, {"raw": "d_pred"})
    return overall.select("sites", F.round("absrel", 6).alias("absrel"), F.round("mae", 6).alias("mae"))


@query("""SELECT l_linenumber AS crop, round(avg(l_quantity * 100 / p), 6) AS mean FROM lineitem JOIN (SELECT l_linenumber, quantile_cont(l_quantity, 0.95) AS p FROM lineitem GROUP BY 1) USING (l_linenumber) GROUP BY 1""")
def height_anchor(spark, d):
    from crownlake.operators import height

    t = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("crop"), F.col("l_quantity").alias("d_pred"), F.lit(100.0).alias("altitude_m"))
    return height.anchored(t, ["crop"]).groupBy("crop").agg(F.round(F.avg("d_anchor"), 6).alias("mean"))
