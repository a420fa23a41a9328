"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit of a fingerprint gets a vector of r + 1 bits; table v keeps the bits whose
vector has an odd product with v. Any r differing bits leave some v != 0 orthogonal to all of them, so
two fingerprints within the radius agree on all that table v keeps: every such pair meets in one of the
2^(r+1) - 1 tables. Members of a crowded bucket are hashed again over the bits that it leaves free, by
the same rule; the bits still free then bound how many can meet.

Cases: null and empty texts have fingerprint 0 and link like any other; fewer words than a shingle
form one shingle; a bit set in just half the shingles is 0; very long texts are counted CHUNK shingles at a time;
equal texts share a fingerprint and are linked through it; repeated rows are one node; null ids get a component
like others; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, returns, ship, table
from millrace.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a bucket that one task compares; larger buckets are hashed again.
SMALL = 1024
#: Shingles that are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number. Bytes are split where A-Z are lower case and white space is ASCII."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[k:] for k in range(SHINGLE)], strict=False)) if len(w) >= SHINGLE else iter([b" ".join(w)])
    n, ones = 0, np.zeros(64, np.int64)
    while part := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, CHUNK)]:
        n += len(part)
        ones += np.unpackbits(np.array(part, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "fp": pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())})

    return df.select(id_col, text_col).mapInArrow(run, returns(df, [id_col], "fp bigint"))


def masks(fixed: int, radius: int = RADIUS) -> list[int]:
    """The tables below a table that keeps the bits ``fixed``: each keeps these and some of the free bits."""
    free = [i for i in range(64) if not fixed >> i & 1]
    if len(free) <= radius:
        return []
    size = 1 << (radius + 1)
    out = []
    for v in range(1, size):
        m = fixed
        for rank, i in enumerate(free):
            if (v & (rank % (size - 1) + 1)).bit_count() & 1:
                m |= 1 << i
        out.append(m)
    return sorted(set(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(radius: int):
    """Links that connect what lies within the radius in a bounded bucket, one less than members at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for row in b.column(0):
                x = np.array(row.as_py(), np.int64)
                while len(x) > 1:
                    root, front, x = x[0], [x[0]], x[1:]
                    while front and len(x):
                        near = np.bitwise_count((x ^ front.pop()).view(np.uint64)) <= radius
                        front.extend(x[near])
                        us.extend([root] * int(near.sum()))
                        vs.extend(x[near])
                        x = x[~near]
            yield pa.RecordBatch.from_pydict({"a": pa.array(us, pa.int64()), "b": pa.array(vs, pa.int64())})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that give the components of all pairs within the radius.

    A bucket of up to ``small`` members is compared in one task. The members of larger ones are hashed
    again; a bucket of the second round leaves 16 bits free at most (at radius 3), so it has 2^16 members at most.
    """
    first = masks(0, radius)
    cand = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in first])).alias("kept"))
    cand = cand.select("kept", F.col("fp").bitwiseAND(F.col("kept")).alias("key"), "fp")
    sizes = cut(cand.groupBy("kept", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = cand.join(sizes, ["kept", "key"])
    again = F.lit(None).cast("array<bigint>")
    for m in first:
        again = F.when(F.col("kept") == _signed(m), F.array(*[F.lit(_signed(x)) for x in masks(m, radius)])).otherwise(again)
    more = met.filter(F.col("n") > small).select("fp", F.explode(again).alias("kept")).distinct()
    more = more.select("kept", F.col("fp").bitwiseAND(F.col("kept")).alias("key"), "fp")
    buckets = met.filter(F.col("n") <= small).select("kept", "key", "fp").union(more)
    gathered = buckets.groupBy("kept", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return gathered.select("fps").mapInArrow(_spanning(radius), "a bigint, b bigint")


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(id, fp) rows with ``component_id``: the smallest id reachable by links."""
    nodes = cut(rows.groupBy("fp").agg(F.min(id_col).alias("low")))
    joined = components(links(nodes.select("fp"), radius, small)).withColumnsRenamed({"id": "fp", "component": "root"})
    rooted = cut(nodes.join(joined, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = cut(rooted.join(lowest, "root").select("fp", "component_id"))
    return rows.join(known, "fp").select(id_col, "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")))
    return near_duplicates(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
