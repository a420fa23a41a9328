import math
import random

import numpy as np
import pytest

from millrace.llm import embed

DATA = "/root/testdata/sf0.01"


def brute(vectors):
    """n_links and components of {id: vector} by all pairs in double precision."""
    ids = sorted(vectors)
    ok = [i for i in ids if vectors[i] is not None and all(c is not None and math.isfinite(c) for c in vectors[i]) and any(vectors[i])]
    x = np.array([vectors[i] for i in ok], float) if ok else np.zeros((0, 1))
    n = np.sqrt((x * x).sum(1))
    link = (x @ x.T) / (n[:, None] * n) >= 0.9
    np.fill_diagonal(link, False)
    comp, links = {i: i for i in ids}, {i: 0 for i in ids}
    links |= dict(zip(ok, link.sum(1).tolist(), strict=True))
    seen = set()
    for k, i in enumerate(ok):
        if i in seen:
            continue
        stack = [k]
        seen.add(i)
        while stack:
            j = stack.pop()
            comp[ok[j]] = i
            for m in np.flatnonzero(link[j]):
                if ok[m] not in seen:
                    seen.add(ok[m])
                    stack.append(m)
    return {i: (links[i], comp[i], comp[i] == i) for i in ids}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block", [7, 160])
def test_planted_clusters(spark, block):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size, noise in ((60, 0.03), (1, 0), (5, 0.02), (40, 0.0), (200, 2.0)):
        c = rng.normal(size=32)
        for _ in range(size):
            rows.append((k, (c + noise * rng.normal(size=32)).tolist()))
            k += 1
    rows += [(k, None), (k + 1, [0.0] * 32), (k + 2, [float("nan")] * 32), (k + 3, [None] + [1.0] * 31), (k + 4, [float("inf")] * 32), (k + 5, [])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, n_links string")
    assert got(embed.near_duplicates(df, block=block)) == brute(dict(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert got(embed.near_duplicates(df)) == {1: (0, 1, True), 2: (0, 2, True)}


def unit(v):
    return v / np.sqrt((v * v).sum(1))[:, None]


def alike(spark, rng, n):
    """Vectors from a mixture fitted to the test table's."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    known = [unit(np.stack(g.to_numpy()).astype(float)) for _, g in t.groupby("label")["embedding"]]
    return unit(rng.permutation(np.concatenate([rng.multivariate_normal(g.mean(0), np.cov(g.T), n // len(known) + 1) for g in known]))[:n])


def planted(rng, base):
    """A vector for each at a cosine of 0.90 to 0.95."""
    off = rng.normal(size=base.shape)
    c = rng.uniform(0.9001, 0.95, (len(base), 1))
    return c * base + np.sqrt(1 - c * c) * unit(off - (off * base).sum(1)[:, None] * base)


def recall(spark, rows, least):
    want = brute(rows)
    have = got(embed.near_duplicates(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")))
    assert have.keys() == want.keys() and all(have[i][0] <= want[i][0] for i in want)
    total = sum(w[0] for w in want.values())
    assert total >= least and sum(h[0] for h in have.values()) >= 0.97 * total


def test_recall_of_links_planted_among_the_whole_table(spark):
    """The test tables have no link of their own: half of each vector's kin is planted near the bound."""
    rng = np.random.default_rng(3)
    own = np.stack([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]).astype(float)
    base = np.concatenate([unit(own), alike(spark, rng, 2000)])
    recall(spark, dict(enumerate(np.concatenate([base, planted(rng, base[:1500]), planted(rng, base[:1000])]).tolist())), 4000)


@pytest.mark.parametrize("count", [4096, 20_000])
def test_recall_at_many_pivots(spark, monkeypatch, count):
    """Pairs planted at cosine 0.90 to 0.95 among as many pivots as a large table has, flat and as a tree."""
    rng = np.random.default_rng(8)
    piv, base = alike(spark, rng, count), alike(spark, rng, 1000)
    monkeypatch.setattr(embed, "pivots", lambda classes: piv)
    recall(spark, dict(enumerate(np.concatenate([base, planted(rng, base)]).tolist())), 2000)


def test_comparisons_a_vector_stay_level(spark):
    """Vectors in lists times their length, over the number of vectors, at one pivot for each PER_PIVOT of them."""
    rng = np.random.default_rng(5)
    per = []
    for n in (20_000, 200_000):
        tree, x = embed.Tree(alike(spark, rng, n // embed.PER_PIVOT)), alike(spark, rng, n)
        sizes = np.bincount(np.concatenate([tree.nearest(x[at : at + 4096]).ravel() for at in range(0, n, 4096)]))
        per.append((sizes.astype(float) ** 2).sum() / n)
    assert per[1] < 1.5 * per[0]


def test_huge_and_tiny_components(spark):
    rows = {0: [1e308, 1e308], 1: [1.0, 1.01], 2: [1e-300, 1e-300], 3: [-1e308, 1e308], 4: [float("inf"), 1.0]}
    have = got(embed.near_duplicates(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")))
    assert have == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 3: (0, 3, True), 4: (0, 4, True)}


def test_lengths_are_indexed_apart(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim, n in ((16, 700), (8, 660), (5, 40)):
        c = rng.normal(size=(n // 10, dim))
        rows += [(c[k % len(c)] + 0.05 * rng.normal(size=dim)).tolist() for k in range(n)]
    data = dict(enumerate(rows))
    want = {}
    for dim in (16, 8, 5):
        want |= brute({i: v for i, v in data.items() if len(v) == dim})
    have = got(embed.near_duplicates(spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")))
    assert all(sum(want[i][0] for i in data if len(data[i]) == d) > 0 for d in (16, 8, 5))
    for d in (16, 8, 5):
        ids = [i for i in data if len(data[i]) == d]
        assert sum(have[i][0] for i in ids) >= 0.99 * sum(want[i][0] for i in ids) and all(have[i][0] <= want[i][0] for i in ids)
