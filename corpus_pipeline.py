"""A training corpus from documents: five stages, each an operator of crownlake.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and rereads it as the next stage's docs. All stages but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.llm import decontam, langid, minhash, packing, substring
from crownlake.llm.common import prepare, scratch, table, temporary


def _beside(docs: DataFrame, taken: set[str]) -> DataFrame:
    """docs with columns that an operator's results would replace under other names; see _restored."""
    return docs.select(*[F.col(f"`{c}`").alias(f"__own_{c}" if c in taken else c) for c in docs.columns])


def _restored(found: DataFrame, docs: DataFrame, taken: set[str]) -> DataFrame:
    """The columns of docs, by the names and in the order they had."""
    return found.select(*[F.col(f"`__own_{c}`").alias(c) if c in taken else F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: without a letter, or unlike any text of their best language.

    So null and empty texts go. Repeated rows are judged alike, and all of them stay or go; a null
    doc_id or lang does no harm. Other columns stay as they are, whatever their names. Without a
    labelled text there is no model, and all rows go; an empty table stays empty.
    """
    prepare(spark)
    taken = {"lang_pred", "score", "rejected"}
    found = langid.identify(_beside(docs, taken), langid.fit(docs))
    return _restored(found.where(~F.col("rejected")), docs, taken)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By rising doc_id a row goes if its text shares 0.8 or more of its five-word shingles with one that stays.

    Of rows with one doc_id and equal texts one stays; rows that share a doc_id only are separate
    documents, in order of a hash of their texts. Null, empty and wordless texts are equal to each
    other. A document without a doc_id stays: no other row can stand for it. Other columns stay as
    they are, those of one row of several equal ones; an empty table stays empty.
    """
    prepare(spark)
    taken = {"text_hash"}
    keyed = _beside(docs, taken).where("doc_id is not null").withColumn("text_hash", minhash.text_hash())
    kept = minhash.survivors(docs)
    one = keyed.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return _restored(one, docs, taken).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that also stand elsewhere go; a document that loses none keeps its text as it is.

    Null texts stay null. Repeated rows are each other's copies, so all their windows go. All rows
    stay, with their other columns, of which n_chars follows the text; an empty table stays empty.
    """
    prepare(spark)
    taken = {"kept_text", "n_words", "n_removed", "kept_sha256"}
    found = substring.drop_repeats(_beside(docs, taken))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _restored(out, docs, taken)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in windows of the benchmark go.

    Null, empty and wordless texts stay. Repeated rows are judged alike. Other columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    prepare(spark)
    taken = {"hits", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    found = decontam.report(_beside(docs, taken), table(spark, sf_dir, "benchmark"))
    return _restored(found.where(~F.col("contaminated")), docs, taken)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    A null or empty text is its end id alone. Repeated rows, and rows with one doc_id or none, are
    packed each. Columns but doc_id and text are left out; an empty table gives no pieces.
    """
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but the fourth can be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps for itself in the shared folder goes with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with temporary(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
