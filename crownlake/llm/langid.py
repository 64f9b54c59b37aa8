"""Language identification: a Kneser-Ney character model for each language, lowest cross-entropy wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crownlake.llm.common import claim, steps, stored, utf8
from crownlake.llm.knlm import STEP, WHOLE, Model, Shards, build, count_grams, gathered, grams, sampled, symbols, with_sums

ORDER = 4
#: Labelled texts that the sharpness is fitted on, about so many at most, chosen by a hash of their content.
CALIBRATION_ROWS = 4000
#: Limits come from a histogram of all texts' cross-entropy with so many bins a nat.
BINS = 1024
#: Texts with fewer symbols are never rejected.
REJECT_SYMBOLS = 40
UNKNOWN = "und"


@dataclass
class Identifier:
    model: Model | Shards | None
    languages: list[str]
    #: Bits of cross-entropy by which a language leads count this much in the score.
    sharpness: float
    #: Cross-entropy in nats a symbol above which a text is no text of its best language.
    limits: np.ndarray

    def measure(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol in each language [texts, languages], and symbols of each text."""
        sym, place, kept = symbols(raw, off, self.model.order if self.model else 1)
        total = np.zeros((len(off) - 1, len(self.languages)))
        if self.model:
            total = totals(self.model.score(grams(sym, place, self.model.order)), kept)
        return -total / np.maximum(np.diff(kept), 1)[:, None], np.diff(kept)

    def measured(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """measure() of a batch's texts, or what passes over the shards have added up of it."""
        raw, off = utf8(b.column(b.schema.get_field_index("text")))
        at = b.schema.get_field_index("__sums")
        if at < 0:
            return self.measure(raw, off)
        n = np.diff(symbols(raw, off, 1)[2])
        total = np.frombuffer(b"".join(b.column(at).to_pylist())).reshape(len(n), -1)
        return -total / np.maximum(n, 1)[:, None], n

    def without_rows(self) -> Identifier:
        """What workers need of it: shards stay behind, their sums come with the texts."""
        return replace(self, model=None) if isinstance(self.model, Shards) else self

    def decide(self, h: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (und without a letter or a model), score from 0 to 1, and whether the text is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
        best = h.argmin(axis=1)
        weight = np.exp(-self.sharpness * (h - h.min(axis=1, keepdims=True)))
        score = np.where(n > 0, 1 / weight.sum(axis=1), 0.0)
        over = h[np.arange(len(n)), best] > self.limits[best]
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
        return names, score, (n == 0) | over & (n >= REJECT_SYMBOLS)


def totals(logp: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Sums [texts, languages] of log probabilities over each text."""
    out = np.zeros((len(kept) - 1, logp.shape[1]))
    full = np.flatnonzero(np.diff(kept))
    if len(full):
        out[full] = np.add.reduceat(logp, kept[:-1][full], axis=0, dtype=np.float64)
    return out


def _rows_of_totals(logp: np.ndarray, kept: np.ndarray) -> list[np.ndarray]:
    return list(totals(logp, kept))


def fit(labelled: DataFrame, *, order: int = ORDER, rows: int = CALIBRATION_ROWS, whole: int = WHOLE) -> Identifier:
    """Learn from labelled (text, lang): counts cover all rows with a text and a lang.

    All grams stay; a model of more than `whole` numbers is built and used in shards, with the same
    results. Sharpness maximises the likelihood of the languages of about `rows` of them. A language's limit
    lies as far above the 99.9th percentile of the cross-entropy of all its texts (those of
    REJECT_SYMBOLS and more) as that lies above the median, half a nat at least, so that only texts
    unlike any of its own are rejected. A language without such a text rejects none.
    """
    spark = labelled.sparkSession
    known = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_language = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r.lang for r in per_language)
    if not languages:
        return Identifier(None, [], 1.0, np.zeros(0))
    dim = spark.createDataFrame(list(zip(languages, range(len(languages)), strict=True)), "lang string, class int")
    classed = known.join(F.broadcast(dim), "lang").select("text", "class")
    counts = stored(count_grams(classed, order), "grams")
    small = counts.count() * len(languages) <= whole
    model = Model(*gathered(counts), len(languages), order) if small else build(counts, len(languages), order, whole=whole)
    out = Identifier(model, languages, 10.0, np.full(len(languages), np.inf))
    sent = spark.sparkContext.broadcast(out.without_rows())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text", STEP):
                h, n = sent.value.measured(b)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("class")), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=["class", "h", "n"])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("knlm")
        for batch in batches:
            for b in steps(batch, "text", STEP):
                h, n = sent.value.measured(b)
                y = b.column(b.schema.get_field_index("class")).to_numpy()
                long = np.flatnonzero(n >= REJECT_SYMBOLS)
                own = np.stack([y[long].astype(np.int64), np.floor(h[long, y[long]] * BINS).astype(np.int64)])
                (c, k), many = np.unique(own, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k), pa.array(many.astype(np.int64))], names=["class", "bin", "n"])

    classed = with_sums(classed, model, _rows_of_totals)
    sample = sampled(classed, ["text", "class"], rows, sum(r.n for r in per_language))
    seen = sample.mapInArrow(measured, "class int, h array<double>, n long").where("n > 0").collect()
    if seen:
        h, y, n = np.array([r.h for r in seen]), np.array([r["class"] for r in seen]), np.array([r.n for r in seen])
        gap = h - h.min(axis=1, keepdims=True)

        def loss(s: float) -> float:
            return float(np.mean(s * gap[np.arange(len(y)), y] + np.log(np.exp(-s * gap).sum(axis=1))))

        out.sharpness = min((2.0**k for k in np.arange(-1, 8, 0.5)), key=loss)
    bins = classed.mapInArrow(binned, "class int, bin long, n long").groupBy("class", "bin").agg(F.sum("n").alias("n")).collect()
    for c in range(len(languages)):
        own = sorted((r.bin, r.n) for r in bins if r["class"] == c)
        if own:
            edge, upto = np.array([b for b, _ in own]), np.cumsum([n for _, n in own])
            last = upto[-1] - 1
            high = (edge[np.searchsorted(upto, np.ceil(0.999 * last), "right")] + 1) / BINS
            mid = edge[np.searchsorted(upto, last // 2, "right")] / BINS
            out.limits[c] = high + max(high - mid, 0.5)
    return out


def identify(docs: DataFrame, identifier: Identifier, *, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns of docs by default) and lang_pred, score, rejected.

    Only `text` is looked at. Null texts and texts without a letter are `und`, score 0, rejected.
    Ties go to the first language in order of names. Repeated rows are judged alike; result columns
    replace columns of their names; an empty table gives no rows.
    """
    new = ["lang_pred", "score", "rejected"]
    names = [c for c in (keep or docs.columns) if c not in new]
    base = docs.select(*dict.fromkeys([*names, "text"]))
    schema = StructType(base.select(*names).schema.fields + StructType.fromDDL("lang_pred string, score double, rejected boolean").fields)
    sent = docs.sparkSession.sparkContext.broadcast(identifier.without_rows())
    base = with_sums(base, identifier.model, _rows_of_totals)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("knlm")
        for batch in batches:
            for b in steps(batch, "text", STEP):
                lang, score, rejected = sent.value.decide(*sent.value.measured(b))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, *new]
                )

    return base.mapInArrow(named, schema)


def remainder(column: str, modulus: int):
    """crc32 of an id as text, by a modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
