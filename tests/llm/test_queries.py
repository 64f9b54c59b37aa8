"""Each registered query over a whole small table, against brute force in plain Python."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from crownlake.llm import langid, queries, substring
from crownlake.llm.bpe import WordEncoder, default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    def rows(name, key):
        return {r[key]: r for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()}

    return {"documents": rows("documents", "doc_id"), "pages": rows("pages", "page_id"), "benchmark": rows("benchmark", "item_id"), "labels": rows("labels", "doc_id")}


@pytest.fixture(scope="module")
def tokens(tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return {i: t.encode(r.text or "", add_special_tokens=False).ids for i, r in tables["documents"].items()}


def run(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder():
    e = WordEncoder(default_path())
    texts = ["a  b", " a", "a \n b", "", None, "<|endoftext|> x", "don't  we'll", "a\n\nb c\td", "é x ü", "a b ", "\n", " ", "1a 2,b!!  ", "x 's 't", "日本語 text 😀 z", "a\r\nb", "".join(map(chr, range(1, 400)))]
    texts += ["".join(chr(c) + "a " + chr(c) + " " + chr(c) * 2 + "1" for c in range(1, 256))]
    for t, x in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(x, e.dtype).tolist() == (e.tokenizer.encode(t, add_special_tokens=False).ids if t else [])


def test_op1(spark, sf_dir, tables):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

    def judged(url):
        if not url or "://" not in url:
            return "", "", None
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = low(host)
        fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1:] if fits else None

    seen = {i: judged(r.url) for i, r in tables["pages"].items()}
    acts = defaultdict(set)
    for h, _, m in seen.values():
        acts[h] |= {m[1]} if m else set()
    got = run(spark, sf_dir, "op1_url_rank")
    assert len(got) == len(seen)
    for r in got:
        h, p, m = seen[r.page_id]
        # these pages link to no other host, so ranks are the seeds' own
        assert (r.host, r.path, r.rule) == (h, p, m and m[0]) and r.verdict == (m[1] if m else "block" if acts[h] == {"block"} else "allow")


def test_op2(spark, sf_dir, tokens):
    start, got = 0, {r.doc_id: r for r in run(spark, sf_dir, "op2_token_records")}
    for i in sorted(tokens):
        r, ids = got[i], [*tokens[i], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op3(spark, sf_dir, tables):
    got = run(spark, sf_dir, "op3_language_id")
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.lang_pred == tables["documents"][r.doc_id].lang for r in held]
    assert len(got) == len(tables["documents"]) and np.mean(right) > 0.95 and not any(r.rejected for r in got if not r.held_out)


def test_op4(spark, sf_dir, tables):
    got = run(spark, sf_dir, "op4_toxicity")
    assert len(got) == len(tables["documents"]) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    known = [(r.score, tables["labels"][r.doc_id].toxic) for r in got if r.held_out and r.doc_id in tables["labels"]]
    pairs = [(a > b) + (a == b) / 2 for a, y in known if y for b, z in known if not z]
    assert np.mean(pairs) > 0.9


def removed(documents, size):
    own = {i: WORD.findall(r.text or "") for i, r in documents.items()}
    count = Counter(tuple(w[k : k + size]) for w in own.values() for k in range(len(w) - size + 1))
    out = {}
    for i, w in own.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_op5(spark, sf_dir, tables):
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in removed(tables["documents"], 35).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, sf_dir, "op5_substring_dedup")} == want
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ways = [{"hot": 2}, {"hot": 2, "broadcast_keys": 0}, {"bitmap_bytes": 1}, {"shard_words": 500}, {"hot": 2, "hot_keys": 1}, {"hot": 2, "hot_keys": 1, "broadcast_keys": 0}]
    for options in ways:
        got = substring.drop_repeats(docs, keep=["doc_id"], **options).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want, options


def test_op5_words_that_share_a_hash(spark):
    """Texts that differ in one word only: with hashes of a few bits other words take that word's place."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:20] + [f"x{k}"] + base[21:])) for k in range(60)] + [(100, " \t".join(base[:20] + ["x7"] + base[21:])), (101, "ddbbajat " + " ".join(base[:34])), (102, "bslexbek " + " ".join(base[:34]))]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in removed({i: type("R", (), {"text": t}) for i, t in rows}, 35).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bits, options in ((64, {}), (1, {}), (4, {"hot": 2}), (1, {"hot": 2, "broadcast_keys": 0}), (1, {"hot": 2, "hot_keys": 1}), (4, {"bitmap_bytes": 1})):
        got = substring.drop_repeats(docs, hash_bits=bits, **options).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want, (options, bits)


def test_fm_index():
    from crownlake.llm.fmindex import FMIndex

    r = np.random.default_rng(3)
    for window in (1, 2, 3, 5, 8, 35):
        seqs = [r.integers(0, 3, n).tolist() for n in r.integers(1, 60, 40)] + [[1] * 50, [1, 2] * 30]
        seqs = [list(s) for s in dict.fromkeys(map(tuple, seqs))]
        weights = r.integers(1, 4, len(seqs))
        count = Counter()
        for s, w in zip(seqs, weights.tolist(), strict=True):
            for k in range(len(s) - window + 1):
                count[tuple(s[k : k + window])] += w
        index = FMIndex(np.array(sum(seqs, [])), np.array([len(s) for s in seqs]), weights, window)
        seq, n = index.window_counts()
        want = [(j, count[tuple(s[k : k + window])]) for j, s in enumerate(seqs) for k in range(len(s) - window + 1)]
        assert list(zip(seq.tolist(), n.tolist(), strict=True)) == want


def contaminated(tables):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, r in tables["benchmark"].items():
        w = word.findall(low(r.text))
        for k in range(max(1, len(w) - 12)) if w else []:
            windows[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for i, r in tables["documents"].items():
        w = word.findall(low(r.text))
        hit, items = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit[k : k + n] = [1] * n
        out[i] = (len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def test_op6(spark, sf_dir, tables):
    got = run(spark, sf_dir, "op6_decontamination")
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == contaminated(tables)


def test_op7(spark, sf_dir, tables):
    def article(source):
        m = re.search(r"<article>(.*?)</article>", source, re.S)
        blocks = re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " ")) if m else []
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        return "\n".join(x for x in lines if x)

    for r in run(spark, sf_dir, "op7_html_extraction"):
        assert r.text == article(tables["pages"][r.page_id].html) and r.n_chars == len(r.text)


def test_op7_layouts():
    import random

    from crownlake.llm import extract
    from crownlake.llm.dom import read

    trees, r, same = extract.train(), random.Random(5), []
    for _ in range(150):
        source, mark = extract.training_page(r)
        page = read(source, mark)
        same.append(extract.extract(trees, [source])[0] == extract.main_text(page, [True, *page.marked[1:]]))
    assert np.mean(same) > 0.9


def test_op8(spark, sf_dir, tokens):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in run(spark, sf_dir, "op8_packing"):
        by[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(tokens) and sorted(seqs) == list(range(len(seqs)))
    for i, pieces in by.items():
        ids, at = [*tokens[i], 0], 0
        for start, n, c, total in sorted(pieces):
            assert (start, total, c) == (at, len(ids), crc(ids[at : at + n]))
            at += n
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(seqs) * 1024 < 1.01 * sum(len(x) + 1 for x in tokens.values()) + 4 * 1024


def prints(documents, words):
    out = {}
    for i, r in documents.items():
        w = WORD.findall(low(r.text))
        grams = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def components(fp, radius):
    ids = sorted(fp)
    near = np.bitwise_count(np.array([fp[i] for i in ids], np.uint64)[:, None] ^ np.array([fp[i] for i in ids], np.uint64)) <= radius
    label = np.arange(len(ids))
    while not np.array_equal(label, new := np.array([label[n].min() for n in near])):
        label = new
    return {i: ids[k] for i, k in zip(ids, label.tolist(), strict=True)}


def resembled(documents):
    """Documents that stay: by rising id, those that share less than 0.8 of their five-word shingles with each that stays."""
    kept = {}
    for i in sorted(documents):
        w = low(documents[i].text).split()
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if not any(own == s or len(own & s) >= 0.8 * len(own | s) for s in kept.values()):
            kept[i] = own
    return set(kept)


def test_op9(spark, sf_dir, tables):
    from crownlake.llm import simhash

    fp = prints(tables["documents"], 4)
    want = components(fp, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, sf_dir, "op9_simhash_bktree")} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for radius, blocks, tree in ((4, 6, 2), (4, 6, 12), (8, 10, 4)):
        got = simhash.near_duplicates(docs, radius=radius, blocks=blocks, tree=tree)
        assert {r.doc_id: r.component_id for r in got.collect()} == components(fp, radius), radius


def test_forest():
    from crownlake.llm.bktree import Forest

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 6))) for _ in range(400)], np.uint64)
    own = np.unique(base[r.integers(0, 6, 400)] ^ flips)
    bucket = np.sort(r.integers(0, 3, len(own)))
    got = Forest(own, bucket).components(4)
    near = (np.bitwise_count(own[:, None] ^ own) <= 4) & (bucket[:, None] == bucket)
    label = np.arange(len(own))
    while not np.array_equal(label, new := np.array([label[n].min() for n in near])):
        label = new
    assert np.array_equal(got, label)


def test_components(spark):
    from crownlake.llm.components import smallest_reachable

    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 140)}


def test_op10(spark, sf_dir, tables):
    got = run(spark, sf_dir, "op10_media_sniffing")
    assert len(got) == len(tables["documents"])
    for r in got:
        raw = (tables["documents"][r.doc_id].text or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_carving():
    import gzip

    from crownlake.llm.media import to_wav
    from crownlake.llm.sniff import carve
    from crownlake.sources.codecs import png_encode

    png, wav, gz = png_encode(np.arange(12).reshape(3, 4)), to_wav(b"abc"), gzip.compress(b"x" * 50)
    data = b"RIFF" + png + b"BM junk \x1f\x8b\x08" + wav + b"%PDF-" + gz
    assert [(k, data[a : a + n]) for k, a, n in carve(data)] == [("image/png", png), ("audio/wav", wav), ("application/gzip", gz)]
    assert carve(png[:-1]) == [] and carve(b"") == []


def test_pipeline(spark, sf_dir, tables, tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id: r for r in rows.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "language ID":
            assert set(before) - set(after) <= {i for i, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")}
        elif name == "near-duplicates":
            assert set(after) == resembled(before) and all(after[i] == before[i] for i in after)
        elif name == "repeated passages":
            want = removed(before, 35)
            assert all(r.text == (want[i][2] if want[i][1] else before[i].text) for i, r in after.items()) and set(after) == set(before)
        else:
            want = contaminated(tables | {"documents": before})
            assert set(after) == {i for i, w in want.items() if not w[4]}
        sizes.append(len(after))
        rows = spark.createDataFrame(out.collect(), docs.schema)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(after) and 0 < sizes[-1] < len(tables["documents"])
    assert langid.UNKNOWN == "und"
