"""Canonical schemas: one English name for each concept, nulls instead of NaN and sentinels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

RUN = "array<struct<y:int,xs:int,xe:int>>"
DDL = {
    "frames": "folder string, stem string, width int, height int, content binary",
    "label_runs": "folder string, stem string, label int, y int, x_start int, x_end int",
    "instances": f"folder string, stem string, inst_id int, x0 int, y0 int, x1 int, y1 int, runs {RUN}, area bigint, score float",
    "detections": "folder string, frame string, xmin double, ymin double, xmax double, ymax double, score double, box_w double, box_h double, kept boolean",
    "crowns_shape": "folder string, frame string, id int, cx double, cy double, xmin int, ymin int, xmax int, ymax int, area_px double, compactness double, solidity double, aspect_ratio double, diameter_px double, score double, coverage double, source string",
    "crowns_species": "folder string, frame string, id int, cx double, cy double, crop_px int, species_top1 string, prob_top1 double, species_top2 string, prob_top2 double, species_top3 string, prob_top3 double, height_m_pred double, entropy double",
    "overlay_labels": "folder string, stem string, inst_id int, class_id int, coverage double, purity double, usable boolean",
    "labelled_crops": "file string, site string, species string, class_id int, diameter_m double, coverage double, purity double",
    "clusters": "folder string, frame string, id int, cx double, cy double, diameter_px double, cluster int, model_class string, model_prob double, features array<float>",
    "annotations": "split string, stem string, ring_no int, ring array<struct<x:double,y:double>>",
    "gpkg_polygons": "shape binary, label string",
    "categories": "id int, name string",
    "surfaces": "model string, folder string, stem string, height int, width int, values array<float>",
    "site_index": "site string, split string, ortho_gsd_m double, ndsm_gsd_m double, width_px int, height_px int, valid_share double, zero_share double, h_p50_m double, h_p95_m double, h_max_m double",
    "depth_metrics": "variant string, crop int, site string, absrel double, mae_m double, rmse_m double, bias_m double, delta125 double, scale_error double",
    "tile_eval": "area string, n_pred int, n_true int, hits int, hit_flags array<boolean>, scores array<float>",
    "clouds": "key string, x float, y float, z float, r smallint, g smallint, b smallint",
}
#: Other names that inputs use for canonical columns.
ALIASES = {
    "ordner": "folder", "gebiet": "site", "instanz": "id", "label": "id", "flaeche_px": "area_px", "kompaktheit": "compactness", "durchmesser": "diameter_px",
    "art": "species_top1", "klasse": "class_id", "abdeckung": "coverage", "reinheit": "purity", "brauchbar": "usable", "quelle": "source", "hoehe": "height_m_pred",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def canonical(df: DataFrame, name: str) -> DataFrame:
    """df with aliases renamed, declared types and order, missing columns as nulls, NaN as null."""
    target = schema(name)
    wanted = set(target.names)
    for old, new in ALIASES.items():
        if old in df.columns and new in wanted and new not in df.columns and old not in wanted:
            df = df.withColumnRenamed(old, new)
    out = []
    for f in target.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, DoubleType | FloatType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)
