"""The pipeline's stages on rows that they must bear; each case has the result that its docstring states."""

from collections import Counter

import pytest

import corpus_pipeline as stages

NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, hits string, contaminated string, text_hash string, kept_text string, n_words string"


def _text(k, n=60):
    return " ".join(f"{chr(97 + k % 26)}{'aeiou'[(i * 7 + k) % 5]}{chr(97 + (i * i + k) % 26)}{chr(97 + i % 26)}" for i in range(n))


ALONE = " ".join(f"q{i}" for i in range(60))


@pytest.fixture
def bench(spark, tmp_path):
    spark.createDataFrame([(1, _text(3)), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture
def hard(spark):
    long = " ".join(_text(k, 40) for k in range(400))
    texts = [(1, _text(1)), (2, None), (3, ""), (4, " \t\n"), (5, "123 ?!"), (None, _text(1)), (None, None), (6, long), (7, _text(7)), (7, _text(7)), (8, ALONE), (8, _text(9)), (9, "kurz"), (10, _text(3) + " tail")]
    return spark.createDataFrame([(i, t, None if i == 1 else "en", "s", len(t or ""), 0.25, "mine", "h", "c", "th", "kt", "nw") for i, t in texts], NAMES)


def _seen(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("stage", [f for _, f in stages.STAGES[:-1]])
def test_stage_keeps_columns_and_empty_tables(spark, hard, bench, stage):
    out = stage(spark, hard, bench)
    assert out.columns == hard.columns and dict(out.dtypes) == dict(hard.dtypes)
    rows = out.collect()
    assert rows and {(r.source, r.score, r.rejected, r.hits, r.contaminated, r.text_hash, r.kept_text, r.n_words) for r in rows} == {("s", 0.25, "mine", "h", "c", "th", "kt", "nw")}
    none = stage(spark, hard.where("false"), bench)
    assert none.columns == hard.columns and none.count() == 0


def test_language_stage(spark, hard, bench):
    got = _seen(stages.identify_language(spark, hard, bench))
    want = Counter({(r.doc_id, r.text): n for (r, n) in Counter(hard.collect()).items() if any(c.isalpha() for c in r.text or "")})
    assert got == want
    assert stages.identify_language(spark, hard.withColumn("lang", stages.F.lit(None).cast("string")), bench).count() == 0


def test_near_duplicate_stage(spark, hard, bench):
    got = _seen(stages.drop_near_duplicates(spark, hard, bench))
    assert got == Counter({(1, _text(1)): 1, (2, None): 1, (5, "123 ?!"): 1, (None, _text(1)): 1, (None, None): 1, (6, hard.where("doc_id = 6").first().text): 1, (7, _text(7)): 1, (8, ALONE): 1, (8, _text(9)): 1, (9, "kurz"): 1, (10, _text(3) + " tail"): 1})


def test_passage_stage(spark, hard, bench):
    got = stages.drop_repeated_passages(spark, hard, bench).collect()
    assert len(got) == hard.count()
    by = Counter((r.doc_id, r.text, r.n_chars) for r in got)
    assert by[1, "", 0] == 1 and by[None, "", 0] == 1 and by[7, "", 0] == 2  # equal texts: all their windows go
    assert by[2, None, 0] == 1 and by[4, " \t\n", 3] == 1 and by[8, ALONE, len(ALONE)] == 1


def test_contamination_stage(spark, hard, bench):
    long = hard.where("doc_id = 6").first().text
    got = _seen(stages.drop_contaminated(spark, hard, bench))
    want = _seen(hard)
    del want[10, _text(3) + " tail"]
    assert long in {t for _, t in got} and got == want


def test_packing_stage(spark, hard, bench):
    out = stages.pack(spark, hard, bench)
    rows = out.collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole[2] == whole[3] == 1 and whole[7] % 2 == 0 and set(whole) == {r.doc_id for r in hard.collect()}
    assert sorted({r.sequence_id for r in rows}) == list(range(max(r.sequence_id for r in rows) + 1))
    assert stages.pack(spark, hard.where("false"), bench).count() == 0
