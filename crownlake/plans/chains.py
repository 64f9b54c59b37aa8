"""The three chains end to end: frames to species, label maps to metrics, polygons to labelled crowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.functions import scalar
from crownlake.operators import instances, joins, metrics, models, polygons, raster, tables
from crownlake.sources import readers


def species_table(runs: DataFrame, classifier: str, classes: DataFrame, *, least_area: int = 200, factor: float = 2.4, least_side: int = 32) -> DataFrame:
    """Label runs to one row a crown: place, crop size, three likeliest species, entropy, height.

    classes: (index, name). The crown's box decides the crop; the classifier is any registered model.
    """
    keys = ["folder", "stem", "label"]
    crowns = raster.zonal_runs(runs, ["folder", "stem"]).where(F.col("area") >= least_area)
    crowns = crowns.withColumn("crop_px", scalar.crop_by_box(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), factor, least_side))
    scored = models.apply(crowns.select(*keys, "crop_px"), classifier, keys)
    names = classes.agg(F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("int"), F.col("name")))).alias("names"))
    top = scored.withColumn("top", scalar.top_classes(F.col("probs"), 3)).crossJoin(F.broadcast(names))
    picked = [c for k in range(3) for c in (F.try_element_at("names", F.get("top", F.lit(k))["i"]).alias(f"species_top{k + 1}"), F.get("top", F.lit(k))["p"].cast("double").alias(f"prob_top{k + 1}"))]
    top = top.select(*keys, *picked, F.col("height").alias("height_m_pred"), scalar.entropy(F.col("probs"), 1e-9).alias("entropy"))
    return crowns.join(top, keys)


def species_summary(crowns: DataFrame) -> DataFrame:
    """Share of the three most frequent species of each folder, and their mean confidence."""
    total = crowns.groupBy("folder").agg(F.count("*").alias("crowns"), F.avg("prob_top1").alias("confidence"))
    top = tables.top_values(crowns, "folder", "species_top1", 3)
    return top.join(total, "folder").withColumn("share", F.col("n") / F.col("crowns"))


def label_map_metrics(found: DataFrame, truth: DataFrame, *, threshold: float = 0.5, least_area: int = 0) -> DataFrame:
    """Predicted and true run rows (stem, label, ...) to precision, recall, f1 and mean IoU of each area.

    The area is the first part of the stem. Label maps have no score, so all predictions count 1 and
    come by label; average precision would mean nothing.
    """
    def big(runs: DataFrame) -> DataFrame:
        n = runs.groupBy("stem", "label").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("area")).where(F.col("area") >= least_area)
        return runs.join(n.select("stem", "label"), ["stem", "label"], "left_semi")

    found, truth = big(found), big(truth)
    both = found.select("stem").distinct().join(truth.select("stem").distinct(), "stem")
    pairs = raster.run_overlap(found, truth, ["stem"])
    scores = found.select("stem", F.col("label").alias("p")).distinct().join(both, "stem").withColumn("score", F.lit(1.0))
    truths = truth.select("stem", "label").distinct().join(both, "stem").groupBy("stem").agg(F.count("*").cast("int").alias("n_true"))
    rows = instances.evaluated(instances.matched_by_score(pairs, scores, ["stem"], threshold), truths, ["stem"])
    rows = rows.withColumn("area", F.substring_index("stem", "_", 1))
    return metrics.micro(rows, ["area"], iou_sum="iou_sum")


def labelled_crowns(crown_runs: DataFrame, species_rings: DataFrame, by: Sequence[str], height: int, width: int, *, coverage: float = 0.5, purity: float = 0.7) -> DataFrame:
    """Crowns with the species that lies under them: the class raster of the polygons, then the majority.

    species_rings: (by, record, species, ring) in pixels. Class ids follow the sorted names, from 1.
    """
    names = species_rings.select("species").where("species is not null").distinct()
    ids = tables.union_all([names]).orderBy("species")
    ids = ids.withColumn("class_id", F.dense_rank().over(_over("species")))
    rings = joins.dimension(species_rings, ids, ["species"], "inner")
    runs = polygons.filled(rings, [*by, "record", "class_id"], height, width)
    classes = polygons.class_raster(runs, by, "record", "class_id")
    out = raster.majority(raster.pixels_of(crown_runs), classes, by, least_coverage=coverage, least_purity=purity)
    return joins.dimension(out, ids, ["class_id"], "left")


def _over(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def evaluate_folder(spark: SparkSession, label_path: str, truth_json: str, size: int, *, truth_size: int = 2048, least_area: int = 0, **options) -> DataFrame:
    """label_map_metrics() of a folder of size x size label PNGs against a prepared annotation index.

    Truth rings are in pixels of a truth_size x truth_size picture: they and, by the square, least_area are scaled to the maps.
    """
    scale = size / truth_size
    found = readers.label_runs(spark, label_path).drop("folder")
    rings = readers.annotation_index(spark, truth_json)
    scaled = F.transform("ring", lambda p: F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y")))
    truth = polygons.filled(rings.select("stem", (F.col("ring_no") + 1).alias("label"), scaled.alias("ring")), ["stem", "label"], size, size)
    return label_map_metrics(found, truth, least_area=int(least_area * scale**2), **options)
