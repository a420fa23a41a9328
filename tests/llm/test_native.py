"""Sharding, quality rules and mixing: brute force in Python, and the registered SQL on whole small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, quality, sharding
from millrace.llm.common import words

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n\x0b\x0c\r", "a", "a b a b a b a b a b a b a b a b", "x\n\n x \nx\ny", "É é # | <b>", "A" * 50 + " " + "w " * 3000, "one two three four five six seven eight nine ten " * 3]


def spark_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [spark_words(t) for t in ODD]


# ---- sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


def check_shards(rows, texts, n):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(key_of(r.doc_id), n), jump(key_of(r.doc_id), n + 1)) and r.law == "key"
        assert r.grown_shard in (r.shard, n)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert ids == sorted(ids)


@pytest.mark.parametrize("n, runs", [(1, None), (16, None), (16, 3), (40, 10)])
def test_shards(spark, n, runs):
    rows = [(i, f"t{i % 7}", 1) for i in range(-50, 400)] + [(5, "t5", 1)] * 3 + [(None, None, 1), (None, "x", 1), (1 << 60, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(5)
    check_shards(sharding.shard(df, n, runs=runs).collect(), [r[:2] for r in rows], n)


def test_shards_of_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_shards(sharding.op4_sharding(spark, DATA).collect(), texts, 16)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("ids", ["hashes", "one", "null", "words"])
def test_runs_are_alike_in_size(spark, ids):
    make = {"hashes": lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "one": lambda i: 7 if i % 3 else i, "null": lambda i: None if i % 2 else i, "words": lambda i: f"w{i}"}[ids]
    rows = [(make(i), f"text {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, f"doc_id {'string' if ids == 'words' else 'long'}, text string")
    flat = df.select(F.col("doc_id").alias("id"), F.length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    sizes = [r["count"] for r in sharding.deal(flat, 20).groupBy("run").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 900
    check_shards(sharding.shard(df, 4, runs=20).collect(), rows, 4)


def test_shards_of_very_long_texts(spark):
    rows = [(1, "ab " * 1_000_000), (2, "\u00e9" * 2_000_000), (3, "")]
    check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 16)


# ---- quality


def measures(t):
    w = spark_words(t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if spark_words(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def lines_and_words(t):
    lines = [x for x in (t or "").split("\n") if spark_words(x)]
    end, start = (lambda x: x.rstrip(" \t\x0b\x0c\r")), (lambda x: x.lstrip(" \t\x0b\x0c\r"))
    return sum(end(x).endswith(("...", "\u2026")) for x in lines), sum(start(x)[:1] in tuple("-*\u2022\u00b7\u25aa") for x in lines), sum(not any(map(str.isalpha, x)) for x in spark_words(t))


def test_measures(spark):
    texts = [*ODD, "- a...\n* b \u2026 \n\u2022 c 12\n 1.2 .. - x4", "so it goes... \r\nand on\u2026\nend", ("a b c d e f " * 2 + "z ") * 30, " ".join(str(k % 11) for k in range(100)), " ".join(str(k * k % 101) for k in range(400))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = quality.apply_policy(quality.ledger(df)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        m = measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and r.kept == (r.failed & 63 == 0)
        assert (r.n_ellipses, r.n_bullets, r.n_bare) == lines_and_words(t)
        own = {name for name, bit in quality.BIT.items() if r.failed & bit}
        assert ("word_length" in own) == (not 2 * m[0] <= m[1] <= 12 * m[0]) and ("bare_words" in own) == (2 * r.n_bare > m[0])


def test_measures_of_very_long_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(200_000)), "a b c d e f g " * 60_000, "x" * 2_000_000]
    rows = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [measures(t) for t in texts]


def test_policies_have_versions(spark):
    led = quality.ledger(spark.createDataFrame([(1, "- one two three four five six seven eight nine ten eleven twelve")], "doc_id long, text string"))
    assert [quality.apply_policy(led, p).first().kept for p in ("base", "v1", "v2")] == [True, True, False]


def test_policies_and_ablation(spark):
    led = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 4), (5, 6), (6, 0)], "doc_id long, failed long")
    assert {r.doc_id for r in quality.apply_policy(led, "base").filter("kept").collect()} == {1, 3, 4, 6}
    got = {r.rule: (r.failing, r.failing_alone, r.kept_without) for r in quality.ablation(led).collect()}
    assert got["symbols"] == (3, 2, 4) and got["few_words"] == (1, 1, 3) and got["repeated_words"] == (1, 0, 2)


def test_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op7_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.97 * len(bad) and sum(r.kept for r in good) >= 0.99 * len(good)


# ---- mixing


def test_targets(spark):
    df = spark.createDataFrame([("b", 10), (None, 100), ("a", 1000), ("c", 0), ("d", 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    size, weight = {"a": 1000, "b": 10, "c": 0, "d": 500, None: 100}, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    assert sum(got.values()) == pytest.approx(1.5 * 1610) and all(got[s] <= 2 * size[s] for s in size)
    level = {s: got[s] / weight[s] for s in size if got[s] < 2 * size[s]}
    assert max(level.values()) == pytest.approx(min(level.values())) and all(2 * size[s] <= max(level.values()) * weight[s] for s in size if s not in level)


@pytest.mark.parametrize("slices, crowded", [(1, 10**9), (64, 10**9), (4096, 10**9), (1, 3)])
def test_mix(spark, slices, crowded):
    rows = [(i, f"w{i} " * (i % 13), ["a", "b", None, "c", "a"][i % 5], 1) for i in range(300)] + [(7, "x y", "a", 1)] * 3 + [(None, None, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(4)
    got = mixing.mix(df, per_octave=slices, crowded=crowded).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), per_octave=slices, crowded=crowded).collect()))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(r.epochs * r.size <= r.taken <= min(2, r.epochs + 1) * r.size for r in own)
        assert sum(r.epochs * r.size < r.taken < (r.epochs + 1) * r.size for r in own) <= 1
    assert mixing.mix(df.limit(0)).count() == 0


def sliced(spark, rows):
    """Sizes of the groups that one task sorts, and the mix."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = -F.log(mixing.unit(F.col("doc_id"), "mix")) / mixing.quality_weight(F.col("text"), F.size(words(F.col("text"))))
    flat = df.select(key.alias("key"), "source", F.xxhash64("doc_id", "text").alias("twin")).withColumn("slice", F.floor(F.log2("key") * 4096).cast("int"))
    per = flat.groupBy("source", "slice").agg(F.count("*").alias("m"))
    sizes = mixing.split(flat, per, 4096, 100).groupBy("source", "slice", "fine", "part").count()
    return max(r["count"] for r in sizes.collect()), mixing.mix(df, crowded=100).collect()


def test_slices_stay_small(spark):
    rows = [(i, "# $ % & * " * (i % 9 + 1) if i % 5 == 0 else f"plain text {i}", "code" if i % 3 else "web") for i in range(12000)]
    most, got = sliced(spark, rows)
    assert most <= 25 and len(got) == 12000
    for make in (lambda i: None, lambda i: 5):
        most, got = sliced(spark, [(make(i) if i % 3 == 0 else i, f"text number {i}", "a") for i in range(6000)])
        assert most <= 25 and len(got) == 6000 and abs(sum(r.taken for r in got) - got[0].target) <= 1


def test_mix_of_very_long_texts(spark):
    rows = [(1, "ab " * 1_000_000, "a"), (2, "x" * 3_000_000, "a"), (3, "w " * 10, "b")]
    got = {r.doc_id: r.size for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 1_000_000, 2: 1, 3: 10}
