"""Stupid-backoff language-model scores, computed relationally over hash-partitioned n-gram counts.

Documents belong to chunks by hash. Each chunk asks for its distinct n-grams: per bucket of the hash
space one row with a packed, sorted list of hashes and local counts, so an n-gram costs a few bytes a
chunk and a frequent one no more than a rare one. A bucket sums the counts over all chunks (the count
table) and answers each chunk in the order of its list. The answers join the chunk's documents, whose
n-grams are looked up and summed per document. Nothing of the corpus passes through the driver.

An n-gram's count leaves out what the document itself adds, so that backing off happens: with counts c,
S(w | context) = c(context w) / c(context) if c(context w) > 0, else ALPHA times S one word shorter; a
word that no other document has counts as ALPHA of one.

Hashes have so many bits that an n-gram meets a stranger with a probability of 2^-STRANGER at most.

The requests are packed because they would otherwise be most of the traffic: as rows of a hash, a document and a
count, unigrams and bigrams take about 40 bytes a word of 7 bytes, packed by chunk about 8.

Cases: a null or empty text has no tokens and score 0; a very long text is a chunk of its own size, with arrays of
some 60 bytes a word; words of equal count have equal scores, nothing is ranked; repeated rows and copies count as
documents of their own, but rows alike in id and text fall into one chunk; null ids are scored; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import returns, ship, table

ORDER, ALPHA, STRANGER = 2, 0.4, 24
#: Tokens of the table for a chunk and for a bucket.
CHUNK_TOKENS, BUCKET_TOKENS = 2_000_000, 1_500_000

#: Most partitions of an exchange.
PARTITIONS = 20_000

_BASE = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (A-Z as a-z) of a text, by differences of one running polynomial sum."""
    b = np.frombuffer((text or "").encode().lower(), np.uint8)
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    inside = np.concatenate([[False], ~_GAP[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    s, e = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * _powers[0][:n], dtype=np.uint64)])
    return _mix((sums[e] - sums[s]) * _powers[1][s])


def grams(words: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams of one order, each at the place of its last word."""
    h = np.zeros(max(0, len(words) - order + 1), np.uint64)
    for k in range(order):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - order + 1 + k] + np.uint64(order))
    return h


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, the sparse upper ones compressed."""
    n = len(values)
    planes = values.astype("<u8").view(np.uint8).reshape(n, 8).T
    width = int(np.max(np.flatnonzero(planes.any(1)), initial=-1)) + 1
    mean = int(values.mean()).bit_length() // 8 if n else 0
    return bytes([width, min(mean, width)]) + planes[: min(mean, width)].tobytes() + zlib.compress(planes[min(mean, width) : width].tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    width, plain = data[0], data[1]
    raw = data[2 : 2 + plain * n] + zlib.decompress(data[2 + plain * n :])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _buckets(h: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Limits of the buckets in sorted hashes of so many bits."""
    step = -(-(1 << bits) // buckets)
    return np.searchsorted(h, (np.arange(1, buckets, dtype=np.uint64) * np.uint64(step)))


def _all_grams(text: str | None, order: int, bits: int) -> list[np.ndarray]:
    w = word_hashes(text)
    return [grams(w, k) >> np.uint64(64 - bits) for k in range(1, order + 1)]


def _ask(order: int, bits: int, buckets: int):
    """Requests: (bucket, chunk, n, hashes, counts) of a task's documents by chunk."""

    def flush(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for chunk, hs in held.items():
            h, c = np.unique(np.concatenate(hs), return_counts=True)
            for k, (hk, ck) in enumerate(zip(np.split(h, cut := _buckets(h, bits, buckets)), np.split(c, cut), strict=True)):
                if len(hk):
                    rows.append((k, chunk, len(hk), pack(np.diff(hk, prepend=np.uint64(0))), pack(ck)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "n", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = _all_grams(text.as_py(), order, bits)
                held.setdefault(chunk, []).extend(got)
                size += sum(map(len, got))
                if size > 12_000_000:
                    yield flush(held)
                    held, size = {}, 0
        if size:
            yield flush(held)

    return run


def _count(key: tuple, asked: pa.Table) -> pa.Table:
    """One bucket: counts over all chunks, answered to each chunk in the order of its own distinct hashes."""
    rows = asked.to_pylist()
    hs = [np.cumsum(unpack(r.pop("h"), r["n"]), dtype=np.uint64) for r in rows]
    cs = [unpack(r.pop("c"), r["n"]).astype(np.int64) for r in rows]
    flat = np.concatenate(hs)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    known, total = flat[first], np.add.reduceat(np.concatenate(cs)[order], first)
    del flat, order, first, cs
    own: dict[int, list[np.ndarray]] = {}
    for r, h in zip(rows, hs, strict=True):
        own.setdefault(r["chunk"], []).append(h)
    out = []
    for chunk, parts in own.items():
        mine = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        out.append((chunk, rows[0]["bucket"], len(mine), pack(total[np.searchsorted(known, mine)].astype(np.uint64))))
    cols = list(zip(*out, strict=True))
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("chunk", "bucket", "n", "c"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)})


def _score_text(gs: list[np.ndarray], known: np.ndarray, counts: np.ndarray, tokens: int, alpha: float) -> tuple[int, int, float]:
    """(tokens, tokens that back off, log score) of one document, whose own counts are left out."""
    n = len(gs[0])
    if not n:
        return 0, 0, 0.0
    rest = max(tokens - n, 1)
    cs = []
    for g in gs:
        own, back, c = np.unique(g, return_inverse=True, return_counts=True)
        cs.append((counts[np.searchsorted(known, own)] - c)[back])
    s = np.log(np.where(cs[0] > 0, cs[0], alpha) / rest)
    backed = 0
    for k in range(1, len(gs)):
        if n > k:
            hit = cs[k] > 0
            context = cs[k - 1][: n - k]
            s[k:] = np.where(hit, np.log(np.maximum(cs[k], 1) / np.maximum(context, 1)), math.log(alpha) + s[k:])
            if k == len(gs) - 1:
                backed = int((~hit).sum())
    return n, backed, float(s.sum())


def _score(order: int, bits: int, buckets: int, tokens: int, alpha: float, kind: pa.DataType):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        gs = [_all_grams(t.as_py(), order, bits) for t in docs["text"]]
        known = np.concatenate([g for d in gs for g in d]) if gs else np.zeros(0, np.uint64)
        known.sort()
        known = known[np.concatenate([[True], known[1:] != known[:-1]])] if len(known) else known
        got = {r["bucket"]: unpack(r["c"], r["n"]).astype(np.int64) for r in answers.to_pylist()}
        counts = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(0, np.int64)
        rows = [_score_text(g, known, counts, tokens, alpha) for g in gs]
        return pa.table({"doc": docs["doc"].cast(kind), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "n_backoff": pa.array([r[1] for r in rows], pa.int64()), "log_score": pa.array([r[2] for r in rows], pa.float64())})

    return run


def _by(df: DataFrame, key: str, n: int) -> GroupedData:
    """Groups of the keys 0 to n - 1, which are dealt in turn: no task gets two keys where a partition a key can be had."""
    parts = min(n, PARTITIONS)
    return df.withColumn("deal", F.col(key) % parts).repartitionById(parts, F.col("deal")).groupBy("deal", key)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, chunks: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, n_backoff, log_score and mean_log_score."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    tokens = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    chunks, buckets = chunks or max(12, tokens // CHUNK_TOKENS + 1), buckets or max(12, tokens // BUCKET_TOKENS + 1)
    chunk = F.pmod(F.xxhash64("doc", F.coalesce("text", F.lit(""))), F.lit(chunks)).cast("int")
    keyed = docs.select(chunk.alias("chunk"), "doc", "text")
    bits = min(64, max(32, tokens.bit_length() + STRANGER))
    asked = keyed.select("chunk", "text").mapInArrow(_ask(order, bits, buckets), "bucket int, chunk int, n int, h binary, c binary")
    answers = _by(asked, "bucket", buckets).applyInArrow(_count, "chunk int, bucket int, n int, c binary")
    arrow = docs.limit(0).select("doc").toArrow().schema.field("doc").type
    out = _by(keyed, "chunk", chunks).cogroup(_by(answers, "chunk", chunks)).applyInArrow(_score(order, bits, buckets, tokens, alpha, arrow), returns(docs, ["doc"], "n_tokens bigint, n_backoff bigint, log_score double"))
    return out.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))).withColumnRenamed("doc", id_col)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded, since their sums depend on the order of addition in the last digits."""
    out = score(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p FROM t),
c AS (SELECT x.*, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS cw, count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY r, p, w) AS cb,
        greatest(count(*) OVER () - count(*) OVER (PARTITION BY r), 1) AS rest FROM x),
y AS (SELECT c.*, lag(cw) OVER (PARTITION BY r ORDER BY i) AS cp, ln((CASE WHEN cw > 0 THEN CAST(cw AS DOUBLE) ELSE 0.4 END) / rest) AS base FROM c),
s AS (SELECT r, count(*) AS n_tokens, CAST(sum(CASE WHEN p IS NOT NULL AND cb = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_backoff,
        sum(CASE WHEN p IS NULL THEN base WHEN cb > 0 THEN ln(CAST(cb AS DOUBLE) / greatest(cp, 1)) ELSE ln(CAST(0.4 AS DOUBLE)) + base END) AS z FROM y GROUP BY r)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(z, 0), 6) AS log_score, round(z / n_tokens, 6) AS mean_log_score FROM d LEFT JOIN s USING (r)
"""
