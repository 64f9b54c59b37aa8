"""The batch contract for detectors, segmenters, classifiers and depth models, and stub models for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crownlake.operators import metrics, vectors

Model = Callable[[pd.DataFrame], pd.DataFrame]
#: Output schemas by kind of model.
CONTRACTS = {
    "detector": "xmin double, ymin double, xmax double, ymax double, score double",
    "segmenter": "inst_id int, x0 int, y0 int, x1 int, y1 int, runs array<struct<y:int,xs:int,xe:int>>, area bigint, score float",
    "classifier": "probs array<float>, height double",
    "features": "features array<float>, probs array<float>",
    "depth": "height int, width int, values array<float>",
}
REGISTRY: dict[str, tuple[str, Callable[[], Model]]] = {}


def register(name: str, kind: str) -> Callable:
    """Decorator: a factory that loads a model once for each Python worker."""
    if kind not in CONTRACTS:
        raise ValueError(f"kind {kind!r} is none of {sorted(CONTRACTS)}")

    def put(factory: Callable[[], Model]) -> Callable[[], Model]:
        REGISTRY[name] = kind, factory
        return factory

    return put


def apply(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a registered model over df in Arrow batches: keys, then the contract's columns."""
    kind, factory = REGISTRY[name]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + CONTRACTS[kind]
    names = [*keys, *(c.split()[0] for c in CONTRACTS[kind].replace("<struct<y:int,xs:int,xe:int>>", "").split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            yield model(pdf)[names]

    return df.mapInPandas(run, schema)


@register("stub_classifier", "classifier")
def _stub_classifier() -> Model:
    """Probabilities by box size, so that chains can run without weights. Input: crop_px and the keys."""

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        share = (out["crop_px"] % 10 + 1) / 11
        out["probs"] = [[float(s), float((1 - s) * 0.7), float((1 - s) * 0.3)] for s in share]
        out["height"] = out["crop_px"] / 10.0
        return out

    return model


def trained_head(train: DataFrame, held_out: DataFrame, label: str, features: str = "features", penalties: tuple[float, ...] = (0.001, 0.01, 0.1)) -> tuple[DataFrame, float]:
    """A class layer on fixed features: held_out with `probs` (array, by class id) and `found`, and its balanced accuracy.

    label: class ids from 0. Features are standardised by train; rare classes weigh more (metrics.class_weights);
    of the penalties the one with the best mean recall over the classes present counts, the first of equals.
    Rows without a label are left out of training.
    """
    weights = metrics.class_weights(train, label).select(label, "weight")
    own = vectors.standardised(train.where(F.col(label).isNotNull()), train, features).join(F.broadcast(weights), label)
    own = own.withColumn("__v", array_to_vector(features)).withColumn("__y", F.col(label).cast("double"))
    asked = vectors.standardised(held_out, train, features).withColumn("__v", array_to_vector(features))
    best, out = -1.0, None
    for p in penalties:
        head = LogisticRegression(featuresCol="__v", labelCol="__y", weightCol="weight", regParam=p, family="multinomial", probabilityCol="__p", predictionCol="__found", rawPredictionCol="__raw").fit(own)
        found = head.transform(asked).withColumn("probs", vector_to_array("__p")).withColumn("found", F.col("__found").cast("int")).drop("__v", "__p", "__found", "__raw")
        recall = found.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg((F.col("found") == F.col(label)).cast("double")).alias("r")).agg(F.avg("r")).first()[0] or 0.0
        if recall > best:
            best, out = recall, found
    return out, best
