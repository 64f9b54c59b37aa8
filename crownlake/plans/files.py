"""Catalogue queries that write the driver's rows as files and read them back by the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from crownlake.functions import scalar as S
from crownlake.operators import raster
from crownlake.plans.catalogue import load, query
from crownlake.plans.geometry import _BOX, _PIXELS, H, W_, boxes, pixels
from crownlake.plans.rules import _ring
from crownlake.sources import readers, writers


def folder(spark, name: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir; on one machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(df, name: str) -> str:
    """One text file of one row `value`."""
    path = folder(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


_FLAT = "array(x0, y0, x1, y0, x1, y1, x0, y1)"


def _coco(spark, d):
    """Boxes as COCO: a picture for each brand; every third annotation has a second polygon."""
    b = boxes(spark, d).selectExpr("frame", "id", "cast(x0 AS double) x0", "cast(y0 AS double) y0", "cast(x1 AS double) x1", "cast(y1 AS double) y1")
    notes = b.selectExpr("frame", "id", f"CASE WHEN id % 3 = 0 THEN array({_FLAT}, transform({_FLAT}, v -> v + 1000)) ELSE array({_FLAT}) END AS segmentation")
    images = b.select("frame").distinct().select(F.crc32("frame").alias("id"), F.concat(F.lit("set/"), "frame", F.lit(".jpg")).alias("file_name"))
    notes = notes.select("id", F.crc32("frame").alias("image_id"), "segmentation")
    whole = images.agg(F.collect_list(F.struct("id", "file_name")).alias("images")).crossJoin(notes.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "image_id", "segmentation"))), lambda a: F.struct(a["image_id"].alias("image_id"), a["segmentation"].alias("segmentation"))).alias("annotations")))
    return _written(whole.select(F.to_json(F.struct("images", "annotations")).alias("value")), "coco")


@query(f"""SELECT frame AS stem, row_number() OVER (ORDER BY id)::INTEGER - 1 AS ring_no, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM (SELECT {_BOX}, p_brand AS frame FROM part)""")
def coco_first_polygons(spark, d):
    return readers.coco(spark, _coco(spark, d)).select("stem", "ring_no", S.ring_area(F.col("ring")).alias("area"))


@query(f"""SELECT stem, count(*) AS n, sum(area) AS area FROM (SELECT frame AS stem, ((x1 - x0) * (y1 - y0))::DOUBLE AS area, unnest(range(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END)) FROM (SELECT {_BOX}, p_brand AS frame FROM part)) GROUP BY 1""")
def coco_all_polygons(spark, d):
    rings = readers.coco(spark, _coco(spark, d), all_parts=True)
    return rings.groupBy("stem").agg(F.count("*").alias("n"), F.sum(S.ring_area(F.col("ring"))).alias("area"))


@query(f"""SELECT frame AS stem, row_number() OVER (PARTITION BY frame ORDER BY id)::INTEGER - 1 AS ring_no, (2 * (x1 - x0 + y1 - y0))::DOUBLE AS length FROM (SELECT {_BOX}, p_brand AS frame FROM part)""")
def annotation_index(spark, d):
    rings = boxes(spark, d).select(F.col("frame").alias("stem"), F.col("id").alias("ring_no"), _ring().alias("ring"))
    back = readers.annotation_index(spark, _written(writers.annotations_json(rings), "index"))
    return back.select("stem", "ring_no", S.ring_length(F.col("ring")).alias("length"))


@query("""SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, round(c_acctbal::DOUBLE, 2) AS balance FROM customer""")
def csv_round_trip(spark, d):
    path = folder(spark, "csv")
    writers.csv(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal").cast("double"), 2).alias("balance")), path)
    return readers.crown_csv(spark, path, "id long, name string, nation int, balance double").select("id", "name", "nation", "balance")


@query("""SELECT n_name AS name, n_nationkey AS id FROM nation""")
def category_file(spark, d):
    rows = load(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("categories"))).alias("value"))
    return readers.categories(spark, _written(rows, "categories")).select("name", "id")


@query("""SELECT s_name AS site, s_nationkey % 2 AS half, round(s_acctbal::DOUBLE, 2) AS gsd FROM supplier WHERE s_nationkey % 2 = 1""")
def site_report(spark, d):
    """A nested report keyed by site, read back as the site index of one split."""
    t = load(spark, d, "supplier").select(F.col("s_name").alias("site"), (F.col("s_nationkey") % 2).cast("string").alias("split"), F.round(F.col("s_acctbal").cast("double"), 2).alias("ortho_gsd_m"))
    back = readers.site_index(spark, _written(writers.report_json(t, "site"), "sites"), "1")
    return back.select("site", F.col("split").cast("int").alias("half"), F.col("ortho_gsd_m").alias("gsd"))


@query(f"""SELECT folder, 'tile_' || label AS stem, label, sum(1)::BIGINT AS area FROM (SELECT unnest(['a', 'b']) AS folder), {_PIXELS} GROUP BY 1, 2, 3""")
def label_folder(spark, d):
    """A PNG for each label in two folders, found again by folder and stem; files of other kinds don't come along."""
    runs = raster.runs(pixels(spark, d)).withColumn("stem", F.concat(F.lit("tile_"), "label")).withColumn("folder", F.explode(F.array(F.lit("a"), F.lit("b"))))
    sizes = runs.select("folder", "stem").distinct().withColumn("height", F.lit(H)).withColumn("width", F.lit(W_))
    path = tempfile.mkdtemp() if spark.sparkContext.master.split("[")[0] == "local" else folder(spark, "labels").removeprefix("file://")
    writers.export(writers.label_pngs(runs, sizes), path)
    writers.export(spark.createDataFrame([("a/notes.txt", bytearray(b"x")), ("a/frame.png", bytearray(b"no picture"))], writers.FILE), path)
    back = readers.label_runs(spark, "file://" + path)
    return back.groupBy("folder", "stem", "label").agg(F.sum((F.col("x_end") - F.col("x_start")).cast("long")).alias("area"))


@query("""SELECT DISTINCT 'f' || p_size % 5 AS folder, replace(p_brand, '#', '-') AS stem, '.JPG' AS first FROM part""")
def frames_found(spark, d):
    """Frames in sub-folders, any picture suffix in any case; of several files with one stem the first by path."""
    t = load(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_size") % 5).alias("folder"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("stem")).distinct()
    path = tempfile.mkdtemp() if spark.sparkContext.master.split("[")[0] == "local" else folder(spark, "frames").removeprefix("file://")
    names = t.withColumn("ext", F.explode(F.array(*[F.lit(x) for x in (".JPG", ".png", ".tiff", ".txt")])))
    writers.export(names.select(F.concat("folder", F.lit("/"), "stem", "ext").alias("name"), F.lit(b"x").alias("content")), path)
    found = readers.frames(spark, "file://" + path)
    return found.select("folder", "stem", F.regexp_extract("path", r"(\.[^.]*)$", 1).alias("first"))
