import random

import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(fps):
    comp = {i: i for i in fps}

    def root(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 3:
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {i: root(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_within_the_radius_meets():
    ms = simhash.masks(0)
    assert len(ms) == 15
    rng = random.Random(0)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not d & m for m in ms)
        first = next(m for m in ms if not d & m)
        assert any(not d & m for m in simhash.masks(first))
    assert all((m & x).bit_count() == m.bit_count() and 64 - x.bit_count() <= 16 for m in ms for x in simhash.masks(m))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "One TWO", "A b C d\x0be", "É é É x y z " * 50, "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == signed(plain_fingerprint(text))


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == signed(plain_fingerprint(text))


@pytest.mark.parametrize("small", [3, 1024])
def test_components_of_planted_groups(spark, small):
    """Dense balls, chains and strangers; a small limit sends the balls through every level of tables."""
    rng = random.Random(3)
    fps = []
    for _ in range(3):
        base = rng.getrandbits(64)
        fps += [base] * 3 + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(25)]
        x = base ^ rng.getrandbits(64)
        for _ in range(10):
            x ^= sum(1 << b for b in rng.sample(range(64), 3))
            fps.append(x)
    fps += [rng.getrandbits(64) for _ in range(40)] + [0, 1, 3, 7, 15, (1 << 64) - 1]
    table = dict(enumerate(fps, 100))
    rows = spark.createDataFrame([(i, signed(f)) for i, f in table.items()], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, small=small).collect()}
    assert got == plain_components(table)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5, 5), (7, 6), (7, 6)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c", 1), (5, "a b c", 1), (7, None, 2), (3, "", 3), (None, "q r s t", 4), (9, "A B  C", 5)], "doc_id long, text string, fp int")
    rows = simhash.fingerprints(df)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (7, 3), (3, 3), (None, None)], key=str)
    assert simhash.near_duplicates(simhash.fingerprints(df.limit(0))).count() == 0


def test_query_on_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = {i: (format(fps[i], "016x"), c) for i, c in plain_components(fps).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, d).collect()} == want
