"""An addition to the batch operators: label maps that arrive one by one, measured as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.sources import codecs

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
ZONES = "folder string, stem string, label int, area bigint, cx double, cy double, x0 int, y0 int, x1 int, y1 int"


def arriving_zones(spark: SparkSession, path: str, suffix: str = "_labels.png", per_trigger: int = 100) -> DataFrame:
    """Streaming zonal statistics of each new label map below path: one file is one frame, so no state is kept."""
    import numpy as np
    import pandas as pd

    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    own = raw.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), suffix + "$", "").alias("stem"), "content")

    def zones(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = codecs.png_decode(r.content)
                y, x = np.nonzero(a)
                for label, g in pd.DataFrame({"l": a[y, x].astype(int), "y": y, "x": x}).groupby("l"):
                    rows.append((r.folder, r.stem, label, len(g), g.x.mean(), g.y.mean(), g.x.min(), g.y.min(), g.x.max() + 1, g.y.max() + 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ZONES.split(", ")])

    return own.mapInPandas(zones, ZONES)


def event_summary(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and means of a stream (ts, event_type, value) in windows of event time; later rows than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
