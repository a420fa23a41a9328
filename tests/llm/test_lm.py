import math
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm

DATA = "/root/testdata/sf0.001"


def brute(texts, order, alpha=0.4):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    counts = Counter(tuple(t[i : i + k]) for t in toks for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(map(len, toks))
    out = []
    for t in toks:
        own = Counter(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
        c = lambda g: counts[g] - own[g]
        s, backed = 0.0, 0
        for i in range(len(t)):
            n, factor = min(order, i + 1), 1.0
            backed += n == order > 1 and c(tuple(t[i - n + 1 : i + 1])) == 0
            while n > 1 and c(tuple(t[i - n + 1 : i + 1])) == 0:
                n, factor = n - 1, factor * alpha
            if n > 1:
                p = c(tuple(t[i - n + 1 : i + 1])) / c(tuple(t[i - n + 1 : i]))
            else:
                p = (c((t[i],)) or alpha) / max(total - len(t), 1)
            s += math.log(factor * p)
        out.append((len(t), backed, s))
    return out


def check(rows, want, near=1e-9):
    for r, (n, b, s) in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_backoff) == (n, b) and r.log_score == pytest.approx(s, rel=1e-9, abs=near)
        assert r.mean_log_score == (pytest.approx(s / n, abs=near) if n else None)


@pytest.mark.parametrize("order, chunks, buckets", [(1, 3, 2), (2, 1, 1), (2, 5, 7), (3, 4, 12), (4, 2, 3)])
def test_against_brute_force(spark, order, chunks, buckets):
    texts = [None, "", " \n", "a", "A b a B", "a b c a b d", "x y z", "x y z", "the the the the", "a b c d e f g a b c", "É é\x0bq"] + ["a b x y the the " * 40]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    rows = sorted(lm.score(df, order=order, chunks=chunks, buckets=buckets).collect(), key=lambda r: r.doc_id)
    check(rows, brute(texts, order))


def test_pack():
    rng = np.random.default_rng(1)
    for v in (np.zeros(0), np.zeros(5), rng.integers(0, 1 << 62, 100), rng.integers(0, 300, 100), np.array([2**64 - 1, 0, 1], np.uint64)):
        v = v.astype(np.uint64)
        assert (lm.unpack(lm.pack(v), len(v)) == v).all()


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    rows = sorted(lm.op5_lm_scoring(spark, DATA).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    check(rows, brute([d.text for d in docs], lm.ORDER), 1e-6)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    check(lm.score(df).collect(), brute(["a b"] * 3, lm.ORDER))
    assert lm.score(df.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 300_000))
    texts = [long, "w1 w2 w3", long[:3000]]
    rows = sorted(lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    check(rows, brute(texts, lm.ORDER), 1e-6)
