"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crownlake.llm.common import claim, steps, stored, utf8
from crownlake.llm.knlm import STEP, WHOLE, Model, Shards, build, count_grams, gathered, grams, symbols, with_sums

ORDER = 5
#: Labelled rows that the logistic calibration is fitted on, about so many, chosen by a hash of their doc_id.
CALIBRATION_ROWS = 20_000
#: Labelled ids up to which the labels go to the texts; beyond, both are dealt out by id.
BROADCAST_LABELS = 500_000
FEATURES = 9


def ratios(logp: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, toxic against ordinary, of each symbol."""
    return (logp[:, 1] - logp[:, 0]).astype(np.float64)


def _rows_of_ratios(logp: np.ndarray, kept: np.ndarray) -> list[np.ndarray]:
    return np.split(ratios(logp).astype(np.float32), kept[1:-1])


def evidence(model: Model, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """features() of texts by a whole model."""
    sym, place, kept = symbols(raw, off, model.order)
    return features(sym[place], kept, ratios(model.score(grams(sym, place, model.order))) if len(place) else np.zeros(0))


def features(own: np.ndarray, kept: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Features of each text from its symbols and their log-likelihood ratios (toxic against ordinary).

    The ratio a symbol over the whole text; of its words the highest ratio a symbol and the two
    highest sums; the sum of the words' sums above 2.5 nats, and above 4, as they are and a word;
    and the number of words. Sums and numbers as log(1 + x). A text without symbols has zeros.
    """
    n = len(kept) - 1
    out = np.zeros((n, FEATURES))
    if not len(own):
        return out
    size = np.diff(kept)
    full = np.flatnonzero(size)
    out[full, 0] = np.add.reduceat(ratio, kept[:-1][full]) / size[full]
    first = np.zeros(len(own), bool)  # a word ends with its boundary or its text
    first[1:] = own[:-1] == 0
    first[kept[:-1][full]] = True
    start = np.flatnonzero(first)
    total = np.add.reduceat(ratio, start)
    mean = total / np.diff(np.append(start, len(own)))
    doc = np.searchsorted(kept, start, "right") - 1
    by = np.lexsort((total, doc))
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    out[doc[last], 2] = total[by][last]
    many = last[last > 0]
    many = many[doc[many - 1] == doc[many]]
    out[doc[many], 3] = total[by][many - 1]
    np.maximum.at(out[:, 1], doc, mean)
    words = np.bincount(doc, minlength=n)
    for at, least in ((4, 2.5), (6, 4.0)):
        strong = np.bincount(doc, np.where(total > least, total, 0), n)
        out[:, at], out[:, at + 1] = np.log1p(strong), strong / (words + 10)
    out[:, 8] = np.log1p(words)
    return out


@dataclass
class Judge:
    model: Model | Shards | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))

    def evidence(self, b: pa.RecordBatch) -> np.ndarray:
        """Features of a batch's texts, by the model or from what passes over its shards have added up."""
        raw, off = utf8(b.column(b.schema.get_field_index("text")))
        at = b.schema.get_field_index("__sums")
        if at >= 0:
            sym, place, kept = symbols(raw, off, 1)
            return features(sym[place], kept, np.frombuffer(b"".join(b.column(at).to_pylist()), np.float32).astype(np.float64))
        return evidence(self.model, raw, off) if self.model else np.zeros((len(off) - 1, FEATURES))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + squashed((x - self.centre) / self.spread) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def without_rows(self) -> Judge:
        """What workers need of it: shards stay behind, their sums come with the texts."""
        return replace(self, model=None) if isinstance(self.model, Shards) else self


def squashed(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, intercept first, by Newton steps on the ridge-penalised likelihood."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)) / 100)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, rows: int = CALIBRATION_ROWS, whole: int = WHOLE) -> Judge:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    Counts cover all labelled texts and keep all grams; the lower orders of both classes share them,
    so an expression that either class has hardly seen decides nothing. A model of more than `whole`
    numbers is built and used in shards, with the same results. A doc_id with labels of both kinds
    counts as toxic; null labels, texts and ids are left out. The calibration is fitted on about
    `rows` texts of one half of the ids with a model of the other half. With a single class the score
    is its share. If the calibration texts are of a single class, the second feature of the ratios,
    the highest sum of a word, decides alone with the fixed weight 2 against -4.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.select(F.col("doc_id").alias("k"), "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("text"))
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    classed = texts.join(F.broadcast(known) if few else known, "k").select("text", (F.col("half") * 2 + F.col("y")).alias("class"))
    counts = stored(count_grams(classed, order), "grams")
    seen = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}
    rate = known.agg(F.avg("y")).first()[0]
    out = Judge()
    if len({c % 2 for c in seen}) < 2:
        out.weights[0] = np.log((rate or 1e-3) / max(1e-3, 1 - (rate or 0)))
        return out
    halves = {c for c in seen if c < 2} == {0, 1}
    if sum(seen.values()) * 2 <= whole:
        key, cls, n = gathered(counts)
        first = cls < 2
        other = Model(key[first], cls[first], n[first], 2, order, shared=True) if halves else None
        out.model = Model(key, cls % 2, n, 2, order, shared=True)
    else:
        other = build(counts.where(F.col("class") < 2), 2, order, True, whole=whole) if halves else None
        out.model = build(counts.withColumn("class", F.col("class") % 2), 2, order, True, whole=whole)
    judged = replace(out, model=other or out.model)
    sent = spark.sparkContext.broadcast(judged.without_rows())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("knlm")
        for batch in batches:
            for b in steps(batch, "text", STEP):
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")), pa.array(list(sent.value.evidence(b)), pa.list_(pa.float64()))], names=["y", "x"])

    pool = known.where("half = 1") if other else known
    share = int((1 << 40) * min(1.0, rows / max(1, pool.count())))
    sample = pool.where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 40)) < share).select("k", "y")
    few = sample.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    chosen = texts.join(F.broadcast(sample) if few else sample, "k").dropDuplicates(["k", "text"]).select("text", "y")
    seen = with_sums(chosen, judged.model, _rows_of_ratios).mapInArrow(measured, "y int, x array<double>").collect()
    x, y = np.array([r.x for r in seen]).reshape(-1, FEATURES), np.array([r.y for r in seen], float)
    if len(np.unique(y)) == 2:
        out.centre, out.spread = np.median(x, axis=0), x.std(axis=0) + 1e-9
        out.weights = logistic(squashed((x - out.centre) / out.spread), y)
    else:
        out.weights[0], out.weights[3] = -4.0, 2.0
    return out


def judge(docs: DataFrame, judged: Judge, *, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns of docs by default), score from 0 to 1 and predicted (1 if score >= 0.5).

    Only `text` is looked at; null and empty texts get the score of a text without words. Result
    columns replace columns of their names; an empty table gives no rows.
    """
    new = ["score", "predicted"]
    names = [c for c in (keep or docs.columns) if c not in new]
    base = docs.select(*dict.fromkeys([*names, "text"]))
    schema = StructType(base.select(*names).schema.fields + StructType.fromDDL("score double, predicted int").fields)
    sent = docs.sparkSession.sparkContext.broadcast(judged.without_rows())
    base = with_sums(base, judged.model, _rows_of_ratios)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("knlm")
        for batch in batches:
            for b in steps(batch, "text", STEP):
                s = sent.value.scores(sent.value.evidence(b))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, *new]
                )

    return base.mapInArrow(scored, schema)
