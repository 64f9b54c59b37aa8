"""Density clustering against plain definitions, and the class layer on fixed features."""

import numpy as np
import pytest

from crownlake.operators import density, models


def _prim(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, len(x)) - 1]
    d = np.maximum(np.maximum(d, core), core[:, None])
    inside, total = [0], []
    while len(inside) < len(x):
        rest = [i for i in range(len(x)) if i not in inside]
        i, j = np.unravel_index(d[np.ix_(inside, rest)].argmin(), (len(inside), len(rest)))
        total.append(d[inside[i], rest[j]])
        inside.append(rest[j])
    return sorted(total)


def test_spanning_tree(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(60, 3)), 1)  # ties among the distances
    x[50:] = x[:10]
    edges = density.spanning_tree(spark, x, 4)
    assert len(edges) == 59 and np.allclose([d for d, _, _ in edges], _prim(x, 4))


def test_density_clusters(spark):
    r = np.random.default_rng(3)
    blobs = [r.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))]
    noise = np.array([[20.0, 20.0], [-15.0, 3.0], [9.0, -12.0]])
    x = np.concatenate([*blobs, noise])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0, 0.0]), (999, None)], "id long, features array<double>")
    got = {r.id: r.cluster for r in density.density_clusters(df, "id", least=10).collect()}
    assert sorted(got) == list(range(123))
    for k in range(3):
        own = [got[i] for i in range(40 * k, 40 * k + 40)]
        assert np.mean([c == k for c in own]) > 0.9 and set(own) <= {k, -1}
    assert [got[i] for i in (120, 121, 122)] == [-1, -1, -1]
    assert density.density_clusters(df.where("false"), "id").count() == 0
    with pytest.raises(ValueError):
        density.density_clusters(df, "id", most=5)


def test_split_by_hand():
    """Two tight groups of three within one of seven: levels 1/1 and 1/4, the seventh row leaves first."""
    edges = [(1.0, 0, 1), (1.0, 1, 2), (1.0, 3, 4), (1.0, 4, 5), (4.0, 2, 3), (8.0, 5, 6)]
    assert density.lasting_clusters(edges, 7, 3).tolist() == [0, 0, 0, 1, 1, 1, -1]
    assert density.lasting_clusters(edges, 7, 4).tolist() == [-1] * 7
    assert density.lasting_clusters([], 1, 2).tolist() == [-1]


def test_trained_head(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(i % 10 == 0), (r.normal(size=4) + (2.5 if i % 10 == 0 else 0)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    out, balanced = models.trained_head(df.where("id < 300"), df.where("id >= 300"), "label")
    got = out.collect()
    assert len(got) == 100 and balanced > 0.9 and all(abs(sum(x.probs) - 1) < 1e-9 and x.found == int(np.argmax(x.probs)) for x in got)
