"""Cases in which an operator once did less than the whole job."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from crownlake.llm.minhash import gram_set


def _kept(rows):
    """doc_ids that stay, by brute force: each row in order against all that stay."""
    out = []
    for i, text in sorted(rows):
        own = set(gram_set(text, 5).tolist())
        if not any(own == s or (own or s) and len(own & s) / len(own | s) >= 0.8 for _, s in out):
            out.append((i, own))
    return {i for i, _ in out}


def _page(name, n=200, changed=()):
    return " ".join(f"{name}{i}" if i not in changed else f"other{name}{i}" for i in range(n))


def test_near_duplicates_are_confirmed(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    # a chain: each shares 0.8 with the one before and less with the first; a pair that no SimHash radius of 8 is sure to join
    rows += [(10_000 + k, _page("chain", changed=range(5, 5 + 15 * k))) for k in range(8)]
    rows += [(20_000 + 2 * k + c, _page(f"pair{k}x", changed=range(50, 50 + 12 * c))) for k in range(40) for c in (0, 1)]
    # a family: one page with more and more words changed at random, in mixed order, so that many resemble the first, many nothing, and some each other
    r = np.random.default_rng(9)
    rows += [(30_000 + int(k), _page("family", changed=set(r.integers(0, 200, n).tolist()))) for k, n in zip(r.permutation(150), r.integers(0, 40, 150), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == _kept(rows)


def test_rows_that_share_an_id_only_stay(spark, sf_dir):
    rows = [(1, _page("a")), (2, _page("a")), (2, _page("b")), (2, _page("b")), (3, _page("c")), (3, _page("d"))]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted((r.doc_id, r.text[:2]) for r in got.collect()) == [(1, "a0"), (2, "b0"), (3, "c0"), (3, "d0")]


def test_limits_cover_all_labelled_rows(spark):
    from crownlake.llm import langid

    def text(k):
        return " ".join("".join(chr(97 + (k * 7 + i * j + i * i) % 26) for i in range(3 + (k + j) % 5)) for j in range(12))

    rows = [(text(k), "en") for k in range(300)] + [("ein ganz anderer satz der nur ein einziges mal in der tabelle vorkommt", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    all_rows, sample = langid.fit(docs, rows=10_000), langid.fit(docs, rows=3)
    assert (all_rows.limits < 100).all() and (sample.limits == all_rows.limits).all()
    h, n = all_rows.measure(*langid.utf8(__import__("pyarrow").array([t for t, lang in rows if lang == "en"])))
    own = h[n >= langid.REJECT_SYMBOLS, 1]
    high, mid = np.quantile(own, 0.999, method="higher"), np.median(own)
    assert abs(all_rows.limits[1] - high - max(high - mid, 0.5)) < 0.02


def _kneser_ney(counts, classes, order, shared):
    """p(class, gram) by dictionaries, from the definition: counts[class][gram as a tuple of symbols]."""
    table = {order: counts}
    for k in range(order - 1, 0, -1):
        kinds = [defaultdict(set) for _ in range(classes)]
        for c in range(classes):
            for g in table[k + 1][c]:
                for to in range(classes) if shared and k == order - 1 else (c,):
                    kinds[to][g[1:]].add(g[0])
        table[k] = [{g: len(s) for g, s in own.items()} for own in kinds]

    def p(c, gram):
        k = len(gram)
        if not k:
            return 1 / 256
        own = table[k][c]
        once, twice = (sum(n == x for n in own.values()) for x in (1, 2))
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        here = [n for g, n in own.items() if g[:-1] == gram[:-1]]
        if not here:
            return p(c, gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(here) + d * len(here) / sum(here) * p(c, gram[1:])

    return p


def test_models_against_dictionaries(spark):
    """Driver-built models and shards built by Spark: all grams of both classes, and grams that neither has."""
    from crownlake.llm import knlm

    r = np.random.default_rng(5)
    for order, shared in ((4, False), (5, True)):
        counts = [Counter(tuple(x) for x in r.integers(0, 4 + c, (400, order)).tolist()) for c in (0, 1)]
        rows = [(int.from_bytes(bytes(g), "big"), c, n) for c in (0, 1) for g, n in counts[c].items()]
        p = _kneser_ney(counts, 2, order, shared)
        asked = [*{g for c in counts for g in c}][:150] + [tuple(x) for x in r.integers(0, 6, (60, order)).tolist()]
        keys = np.array([int.from_bytes(bytes(g), "big") for g in asked])
        want = np.log([[p(c, g) for c in (0, 1)] for g in asked])
        model = knlm.Model(*(np.array(x) for x in zip(*rows, strict=True)), 2, order, shared)
        assert np.abs(model.score(keys) - want).max() < 1e-4
        shards = knlm.build(spark.createDataFrame(rows, "key long, class int, n long"), 2, order, shared, whole=600)
        assert len(shards.cuts) > 2 and shards.cuts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(shards.cuts, shards.cuts[1:], strict=False))
        pair = keys >> 8 & 0xFFFF
        got = np.zeros_like(want)
        for low, high in shards.cuts:
            own = (pair >= low) & (pair < high)
            got[own] = shards.load(low, high).score(keys[own])
        assert np.abs(got - want).max() < 1e-4


def test_shards_judge_alike(spark, sf_dir):
    """A model above the bound gives the results of one below it."""
    from crownlake.llm import langid, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = [{r.doc_id: (r.lang_pred, r.rejected, r.score) for r in langid.identify(docs, langid.fit(docs.repartition(n), whole=whole)).collect()} for n, whole in ((2, 10**9), (3, 40_000))]
    assert all(found[0][i][:2] == found[1][i][:2] and abs(found[0][i][2] - found[1][i][2]) < 1e-3 for i in found[0])
    scored = [{r.doc_id: r.score for r in toxicity.judge(docs, toxicity.fit(docs.repartition(n), labels, whole=whole)).collect()} for n, whole in ((2, 10**9), (3, 60_000))]
    assert scored[0].keys() == scored[1].keys() and max(abs(scored[0][i] - scored[1][i]) for i in scored[0]) < 1e-3


def test_models_keep_all_grams(spark):
    from crownlake.llm.knlm import gathered

    n = 4_000_010
    key, cls, count = gathered(spark.range(n).selectExpr("id AS key", "0 AS class", "IF(id < 10, 2L, 1L) AS n"))
    assert len(key) == n == len(set(key.tolist())) and count.sum() == n + 10


def _ranked(edges, seeds, damping):
    """Dense power iteration until nothing moves; what reaches a host without links is lost."""
    hosts = sorted({h for a, b, _ in edges for h in (a, b)} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    share = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        share[at[b], at[a]] += n
    share /= np.maximum(share.sum(axis=0), 1)
    restart = np.array([h in seeds for h in hosts]) / len(seeds)
    rank = restart
    for _ in range(300):
        rank = damping * share @ rank + (1 - damping) * restart
    return dict(zip(hosts, rank.tolist(), strict=True))


def test_ranks_converge(spark):
    from crownlake.llm import urlrank

    chain = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)]
    graph = [("a", "b", 3), ("a", "c", 1), ("b", "a", 2), ("c", "sink", 5), ("b", "sink", 1), ("hub", "a", 1), ("sink2", "hub", 4)]
    for edges, seeds, damping in ((chain, ["h0"], 0.85), (graph, ["a", "sink2"], 0.3), ([(b, a, n) for a, b, n in graph], ["sink", "b"], 0.3)):
        frame = spark.createDataFrame(edges, "src string, dst string, n long")
        got = {r.host: r["rank"] for r in urlrank.propagate(frame, spark.createDataFrame([(s,) for s in seeds], "host string"), damping=damping).collect()}
        want = _ranked(edges, seeds, damping)
        assert set(got) == {h for h, x in want.items() if x > 0}
        assert all(abs(got[h] - want[h]) < 1e-5 for h in got)


def test_links_decide(spark):
    """Trust follows links from allowed pages, distrust follows links to blocked pages backwards; a hostile page changes nothing."""
    from crownlake.llm import urlrank

    rows = [(1, "http://good.net/de/1", "<a href='http://far.edu/x'>" + "<p>" * 200_000), (2, "http://far.edu/", "<a href=//farther.edu/>"), (3, "http://farther.edu/q", ""), (4, "http://lures.info/", "<a href='//bad.org/es/1'>"), (5, "http://bad.org/es/1", None), (6, "http://both.info/", "<a href='//bad.org/'>"), (7, "http://good.net/other", "<a href='//both.info/'>")]
    out = urlrank.judge(spark.createDataFrame(rows, "page_id int, url string, html string"))
    r = {x.page_id: x for x in out.collect()}
    assert [r[i].verdict for i in (1, 2, 3, 4, 5)] == ["allow", "allow", "allow", "block", "block"]
    assert r[2].trust > r[3].trust > 0 == r[2].distrust and r[4].distrust > 0 == r[4].trust and r[6].distrust > 0 < r[6].trust


def test_blocks_find_all_windows():
    """Automaton of aligned blocks against plain search, over few different words, so that hits overlap."""
    from crownlake.llm.decontam import Items

    r = np.random.default_rng(1)
    for window in (1, 2, 3, 5, 13):
        for _ in range(15):
            items = [(str(i), " ".join(chr(97 + x) for x in r.integers(0, 3, r.integers(0, 40)))) for i in range(12)]
            texts = [[bytes([97 + x]) for x in r.integers(0, 4, n)] for n in (0, 1, 127, 128, 129, *r.integers(0, 400, 3))]
            tests = Items(items, window)
            own = [t.encode().split() for _, t in items if t]
            want = set()
            for j, w in enumerate(own):
                for p in {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))}:
                    want |= {(d, a, len(p), j) for d, t in enumerate(texts) for a in range(len(t) - len(p) + 1) if tuple(t[a : a + len(p)]) == p}
            assert set(zip(*(x.tolist() for x in tests.find(texts)), strict=True)) == want, window
