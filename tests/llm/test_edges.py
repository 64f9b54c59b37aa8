"""Every operator on nulls, empties, long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

from crownlake.llm import decontam, extract, langid, media, packing, records, simhash, substring, toxicity, urlrank


def test_records(docs, empty):
    r = records.token_records(docs, shard_bytes=2000).collect()
    assert len(r) == 10 and sorted(x.n_tokens for x in r if x.doc_id in (2, 3)) == [1, 1]
    r.sort(key=lambda x: x.start)
    assert [x.start for x in r] == np.concatenate(([0], np.cumsum([x.n_tokens for x in r])[:-1])).tolist()
    assert [x.doc_id for x in r] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert records.token_records(empty).count() == 0


def test_frames():
    for doc_id in (7, None):
        raw = records.frame(doc_id, np.array([1, 2, 60000], "<u2").tobytes(), 2) + b"\n"
        back, ids, end = records.unframe(raw)
        assert back == doc_id and ids.tolist() == [1, 2, 60000] and end == len(raw)
        for at in (0, 9, 20, len(raw) - 3):
            bad = bytearray(raw)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                records.unframe(bytes(bad))


def test_packing(docs, empty):
    r = packing.pack(docs, capacity=64, group=4, keep_ids=True).collect()
    seen = {}
    for x in r:
        assert len(x.ids) == 4 * x.length and zlib.crc32(x.ids) == x.ids_crc32
        seen.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(seen) == list(range(len(seen)))
    for v in seen.values():
        ends = [a + n for a, n in sorted(v)]
        assert [a for a, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.pack(empty).count() == 0


def test_differencing():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 1024, 300).tolist()
    k = -(-sum(sizes) // 1024)
    sets = packing.differencing(sizes, k)
    assert sorted(i for s in sets for i in s) == list(range(300))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) < 1024
    windows = packing.fill(sizes, 1024)
    assert len(windows) == k and sorted(sum(n for _, _, n in w) for w in windows)[1:] == [1024] * (k - 1)
    assert packing.fill([], 1024) == [] and packing.fill([2048], 1024) == [[(0, 0, 1024)], [(0, 1024, 1024)]]


def test_substring(docs, empty):
    out = substring.drop_repeats(docs, window=5, gram=4)
    assert out.columns[:2] == ["doc_id", "text"] and out.count() == 10
    r = {x.doc_id: x for x in out.collect()}
    assert r[2].n_words == r[3].n_words == r[6].n_words == 0 and r[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert r[4].n_removed == 30_000 and r[1].n_removed == 0
    assert substring.drop_repeats(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "Quick, brown FOX"), (2, None), (None, "lazy dog"), (1, "Quick, brown FOX")], "item_id long, text string")
    out = decontam.report(docs, items)
    assert out.columns == ["doc_id", "text", "lang", "score", "kept_text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    r = {x.doc_id: x for x in out.collect()}
    assert (r[1].n_hit, r[1].n_items, r[1].contaminated, r[2].n_words, r[2].contaminated) == (5, 2, True, 0, False)
    assert r[1].items_sha256 == hashlib.sha256(b",1").hexdigest()
    many = decontam.report(docs, items, block_bytes=8).collect()
    assert {(x.doc_id, x.n_hit, x.items_sha256) for x in many} == {(x.doc_id, x.n_hit, x.items_sha256) for x in out.collect()}
    assert decontam.report(docs, items.where("false")).where("contaminated").count() == 0
    assert decontam.report(empty, items).count() == 0
    text = "Ä, The QUICK--brown fox"
    assert [text[a:b] for a, b in decontam.spans(text, [(2, 3)])] == ["QUICK--brown fox"]
    found = decontam.find(spark.createDataFrame([(1, text + " (lazy) dog; quick brown fox")], "doc_id long, text string"), items).first()
    assert [(h.word, h.length, text_of, h["items"]) for h in found.hits for text_of in [(text + " (lazy) dog; quick brown fox")[h.begin : h.end]]] == [(2, 3, "QUICK--brown fox", ["1"]), (5, 2, "lazy) dog", [""]), (7, 3, "quick brown fox", ["1"])]


def test_media(docs, empty):
    r = {x.doc_id: x for x in media.text_media(docs).collect()}
    for i in (2, 3):
        assert (r[i].n_bytes, r[i].payload_bytes, r[i].tail_crc32) == (0, 64, zlib.crc32(b"\0" * 64))
    assert all(x.corrected and x.media_type == "audio/wav" and x.media_bytes == x.payload_bytes + 44 for x in r.values())
    assert media.text_media(empty).count() == 0


def test_hostile_bytes():
    """Many openings and no end: time grows with the bytes, not with their square."""
    import time

    from crownlake.llm import sniff

    page = b"OggS" + bytes(22) + b"\0"
    jpeg = b"\xff\xd8\xff\xda\0\2" + b"\xff\0" * 5
    for piece in (b"PK\x03\x04ab", b"PK\x03\x04PK\x05\x06" + bytes(18), b"%PDF-1", page, jpeg):
        start = time.perf_counter()
        assert sniff.carve(piece * 30_000) == []
        assert time.perf_counter() - start < 20, piece


def test_clashing_columns(spark):
    """Result columns replace columns of their names, others stay; ties and repeated rows are judged alike."""
    from crownlake.llm import sniff

    rows = [(1, "a tie", "own", 2.0, 7)] * 2 + [(2, "a tie", "own", 2.0, 7), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, media_type string, score double, predicted int")
    scored = toxicity.judge(d, toxicity.fit(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")))
    assert scored.columns == ["doc_id", "text", "media_type", "score", "predicted"] and scored.count() == 4
    assert len({(r.score, r.predicted) for r in scored.where("text = 'a tie'").collect()}) == 1
    near = simhash.near_duplicates(d.withColumnRenamed("score", "print").withColumnRenamed("predicted", "component_id"))
    assert near.columns == ["doc_id", "print", "component_id"] and sorted(r.component_id for r in near.collect()) == [1, 1, 1, 3]
    stored = media.text_media(d.withColumnRenamed("score", "media_bytes")).collect()
    assert len(stored) == 4 and len({(r.media_sha256, r.payload_sha256) for r in stored if r.doc_id != 3}) == 1
    kinds = sniff.sniff(d.withColumn("content", d.text.cast("binary")), declared="media_type")
    assert kinds.columns[-3:] == ["media_type", "corrected", "carved"] and kinds.count() == 4
    pages = spark.createDataFrame([(1, "<p>one two three four</p>", "t", 9)] * 2, "page_id int, html string, text string, n_chars int")
    assert extract.main_texts(pages).columns == ["page_id", "html", "text", "n_chars"] and len({tuple(r) for r in extract.main_texts(pages).collect()}) == 1


def test_simhash(docs, empty):
    r = simhash.near_duplicates(docs).collect()
    assert len(r) == 10
    by = {x.doc_id: x for x in r}
    assert by[2].print == by[3].print == by[6].print == 0 and by[6].component_id == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_language(docs, empty):
    model = langid.fit(docs)
    r = {x.doc_id: x for x in langid.identify(docs, model, keep=["doc_id"]).collect()}
    for i in (2, 3, 6, 7):
        assert (r[i].lang_pred, r[i].score, r[i].rejected) == ("und", 0.0, True)
    assert r[1].lang_pred == "en" and r[8].lang_pred == "de" and 0 <= r[1].score <= 1
    assert langid.identify(docs, model).columns == ["doc_id", "text", "lang", "hits", "kept_text", "lang_pred", "score", "rejected"]
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {x.lang_pred for x in langid.identify(docs, none).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for j in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.where("false")), toxicity.fit(empty, labels)):
        r = toxicity.judge(docs, j, keep=["doc_id"]).collect()
        assert len(r) == 10 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in r)
    assert toxicity.judge(empty, j).count() == 0


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "<article><p>A &amp; B</p><p>c\n d</p></article><footer>&copy; x</footer>", "t"), (2, None, None), (3, "", "")], "page_id int, html string, text string")
    r = {x.page_id: x for x in extract.main_texts(pages).collect()}
    assert (r[1].text, r[1].n_chars) == ("A & B\nc d", 9) and (r[2].text, r[3].n_chars) == ("", 0)
    assert extract.main_texts(pages.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, None, None), (2, "nope", ""), (3, "http://A.example.com/en/7?x", "<a href=//b.org/>"), (4, "https://b.org/es/1", ""), (5, "http://c.net/q", "<a href='http://b.org/z'>"), (5, "http://c.net/q", None), (6, "x://h", "")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 AS host")
    out = urlrank.judge(pages)
    r = {x.page_id: x for x in out.collect()}
    assert out.count() == 7 and out.columns[:3] == ["page_id", "url", "html"]
    assert (r[1].host, r[2].path, r[1].rule, r[1].verdict) == ("", "", None, "allow")
    assert (r[3].host, r[3].path, r[3].rule, r[3].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (r[4].rule, r[4].verdict, r[5].verdict, r[6].host, r[6].path) == ("org/es/", "block", "block", "h", "")
    assert urlrank.judge(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<p>a<!-- b <i>c", ["a"]), ("x < y <p>1 < 2", ["x < y ", "1 < 2"]), ("<p>q<b", ["q"]), ("<a " * 20_000, []), ("<div>" * 20_000 + "</x>" * 20_000, []),
        ("<li>a<li>b<ul><li>c</ul>d", ["a", "b", "c", "d"]), ("<p>a<p>b</p></p>c", ["a", "b", "c"]), ("<div hidden>a<p>b</div>c", ["c"]), ("<script>'</p>'<b>x</script>y<style>z", ["y"]),
    ],
)
def test_html_reader(source, texts):
    from crownlake.llm.dom import read

    assert [t for n, t in read(source).texts if n >= 0] == texts


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    from crownlake.llm.common import scratch, stored, temporary

    with temporary(spark):
        inner = stored(spark.range(3), "inner")
        gone = inner.inputFiles()
        kept = scratch(spark, "kept") + "-outside"
        inner.write.parquet(kept)
    assert spark.read.parquet(kept).count() == 3 and gone and not any(Path(p.split(":", 1)[1]).exists() for p in gone)
