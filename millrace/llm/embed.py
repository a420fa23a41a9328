"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by the ordered list of its nearest pivots, reference vectors drawn from the
data. Inverted lists hold, for each pivot, the vectors that name it; all vectors of a list are compared
by their cosine in double precision, so that one shared pivot is enough at any number of pivots. A pair
that meets in several lists is counted in that of its smallest shared pivot.

Equal vectors are one class with a count, so copies are never paired. Lists are cut into blocks of
bounded size, and a task compares two blocks, so that a crowded list is spread over many tasks; what
leaves a task is one count a vector and a spanning forest, not the pairs.

The pivots are a bounded sample, in number (PIVOTS_MOST) and in bytes (PIVOT_BYTES), since every worker
holds them; every row is indexed. There is one for each PER_PIVOT vectors, so lists stay as long as they
are until that bound is reached. Over FLAT pivots they form a tree of two levels: a vector looks for its nearest pivots
below the PROBES branches nearest to it. Recall against brute force is measured in the tests.

Each length of vectors has pivots and lists of its own; a length of few vectors is one list.

Cases: null or zero vectors and null or non-finite components link with nothing; vectors are scaled by their largest
component, so that no finite one overflows; of pivots at equal distance the first in their order is named; repeated rows are copies; very long vectors
have fewer pivots; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, ship, table
from millrace.llm.components import components, forest

COSINE = 0.9
#: Pivots named by a vector.
NEAREST = 8
#: One pivot per so many vectors, within these bounds.
PER_PIVOT, PIVOTS_LEAST, PIVOTS_MOST, PIVOT_BYTES = 40, 16, 1 << 16, 1 << 25
#: Pivots over which a tree is built, its branches, and those that a vector looks into.
FLAT, BRANCHES, PROBES = 4096, 256, 16
#: Two pivots have a cosine below this.
PIVOTS_APART = 0.7
#: Vectors in a block, and how many of them are compared with a block at once.
BLOCK, STRIP = 1024, 256


def _clean(v: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can link, their vectors as doubles)."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.array([len(x) if x is not None else -1 for x in v], np.int64) if v.null_count else np.diff(v.offsets.to_numpy())
    rows = np.flatnonzero(size == dim)
    flat = v.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim) if dim else np.zeros((0, 0))
    most = np.abs(x).max(1) if dim else np.zeros(0)
    good = np.isfinite(most) & (most > 0)
    return rows[good], x[good] / most[good][:, None]


def pivots(classes: DataFrame) -> np.ndarray:
    """Unit vectors of the pivots: of the classes, all of one length, whose ids have the smallest hashes, those
    that are far from each other. Pivots inside one crowded group would split it by chance."""
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m = min(PIVOTS_MOST, max(PIVOTS_LEAST, PIVOT_BYTES // (4 * max(dim, 1))), max(PIVOTS_LEAST, n // PER_PIVOT))
    got = classes.orderBy(F.xxhash64("id"), "id").select("v").limit(m).toArrow()["v"]
    _, x = _clean(got, dim)
    x /= np.sqrt((x * x).sum(1))[:, None]
    apart = x[:0]
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        part = part[(part @ apart.T < PIVOTS_APART).all(1)]
        own, free = [], np.ones(len(part), bool)
        for i in range(len(part)):
            if free[i]:
                own.append(i)
                free &= part @ part[i] < PIVOTS_APART
        apart = np.concatenate([apart, part[own]])
    return apart


class Tree:
    """The nearest of some pivots. Over FLAT of them, the first BRANCHES are branches, and every pivot hangs at the one nearest to it."""

    def __init__(self, p: np.ndarray):
        self.p, self.k = p.astype(np.float32), min(NEAREST, len(p))
        self.below: list[np.ndarray] = []
        if len(p) > FLAT:
            branch = np.concatenate([(self.p[at : at + 4096] @ self.p[:BRANCHES].T).argmax(1) for at in range(0, len(p), 4096)])
            order = np.argsort(branch, kind="stable")
            self.below = np.split(order, np.searchsorted(branch[order], np.arange(1, BRANCHES)))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the ``k`` nearest pivots of each row, in order; -1 for none."""
        x = x.astype(np.float32)
        if not self.below:
            return self._first(x @ self.p.T, np.broadcast_to(np.arange(len(self.p)), (len(x), len(self.p))))
        near = np.argpartition(-(x @ self.p[:BRANCHES].T), PROBES - 1, axis=1)[:, :PROBES]
        sim = np.full((len(x), PROBES * self.k), -np.inf, np.float32)
        who = np.full(sim.shape, -1)
        for b in np.unique(near):
            rows, slot = np.nonzero(near == b)
            own = self.below[b]
            if len(own):
                s = x[rows] @ self.p[own].T
                k = min(self.k, len(own))
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                at = slot[:, None] * self.k + np.arange(k)
                sim[rows[:, None], at] = np.take_along_axis(s, top, 1)
                who[rows[:, None], at] = own[top]
        return self._first(sim, who)

    def _first(self, sim: np.ndarray, who: np.ndarray) -> np.ndarray:
        top = np.argpartition(-sim, self.k - 1, axis=1)[:, : self.k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(who, top, 1)


def index(classes: DataFrame, piv: dict[int, np.ndarray]) -> DataFrame:
    """(id, n, v, near): ``near`` are the nearest pivots of the vector's length in order, or
    the one list of a length without pivots; none for vectors that can't link."""
    shared = classes.sparkSession.sparkContext.broadcast({dim: Tree(p) for dim, p in piv.items() if len(p)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near: list = [[]] * b.num_rows
            for dim in set(pa.compute.list_value_length(b.column(2)).to_pylist()):
                rows, x = _clean(b.column(2), dim)
                tree = shared.value.get(dim)
                for at in range(0, len(rows), 1024):
                    named = tree.nearest(x[at : at + 1024]).tolist() if tree else [[0]] * len(rows[at : at + 1024])
                    for r, t in zip(rows[at : at + 1024], named, strict=True):
                        near[r] = [q for q in t if q >= 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], ["id", "n", "v", "near"])

    return classes.select("id", "n", "v").mapInArrow(run, f"id bigint, n bigint, v {classes.schema['v'].dataType.simpleString()}, near array<int>")


def _verify(key: tuple, rows: pa.Table) -> pa.Table:
    """Compare one block with itself, or two blocks of a list: (a, b) links of a forest, and (a, null, weight) counts."""
    _, pivot, lo, hi = (k.as_py() for k in key)
    rows = rows.combine_chunks()
    ids, n, side = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
    named = rows["near"].to_pylist()
    near = np.full((len(ids), max(map(len, named))), -1)
    for i, t in enumerate(named):
        near[i, : len(t)] = t
    x = rows["v"].combine_chunks().flatten().cast(pa.float64()).to_numpy().reshape(len(ids), -1)
    x = x / np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    weight = np.zeros(len(ids), np.int64)
    first, second = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(first), STRIP):
        close = x[first[at : at + STRIP]] @ x[second].T >= COSINE
        i, j = np.nonzero(np.triu(close, at + 1) if lo == hi else close)
        i, j = first[at + i], second[j]
        if len(i):
            links.append(forest(ids[i], ids[j]))
        # A pair counts here if no smaller pivot is shared.
        low = np.where((near[i][:, :, None] == near[j][:, None, :]).any(2) & (near[i] >= 0), near[i], np.iinfo(np.int32).max).min(1)
        i, j = i[low == pivot], j[low == pivot]
        np.add.at(weight, i, n[j])
        np.add.at(weight, j, n[i])
    a, b = map(np.concatenate, zip(*links, strict=True))
    a, b = forest(a, b) if len(links) > 2 else (a, b)
    hit = np.flatnonzero(weight)
    return pa.table({"a": pa.array(np.concatenate([a, ids[hit]]), pa.int64()), "b": pa.array([*b.tolist(), *[None] * len(hit)], pa.int64()), "w": pa.array([*[0] * len(a), *weight[hit].tolist()], pa.int64())})


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("own"), F.col(vec_col).alias("v"))
    # Vectors that can't link are classes of their own: null components make two arrays unlike.
    sound = F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True)) & F.exists("v", lambda c: c != 0)
    rows = rows.select("own", "v", F.coalesce(sound, F.lit(False)).alias("sound"))
    classes = cut(rows.filter("sound").groupBy("v").agg(F.min("own").alias("id"), F.count("*").alias("n")).select("id", "n", "v").filter("id IS NOT NULL"))
    sizes = classes.groupBy(F.size("v").alias("dim")).count().collect()
    piv = {r["dim"]: pivots(classes.filter(F.size("v") == r["dim"])) for r in sizes if r["count"] > PER_PIVOT * PIVOTS_LEAST}
    described = cut(index(classes, piv))
    posts = described.select(F.size("v").alias("dim"), "id", "n", "v", "near", F.explode("near").alias("pivot"))
    lists = posts.groupBy("dim", "pivot").agg(F.count("*").alias("size")).select("dim", "pivot", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    # At most PIVOTS_MOST lists a length.
    posts = posts.join(F.broadcast(lists), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    posts = posts.select("dim", "pivot", "id", "n", "v", "near", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    units = posts.select("dim", "pivot", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "id", "n", "v", "near", "block")
    found = cut(units.groupBy("dim", "pivot", "lo", "hi").applyInArrow(_verify, "a bigint, b bigint, w bigint"))
    comp = components(found.filter("b IS NOT NULL").select("a", "b"))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"))
    known = classes.join(links, "id", "left").join(comp, "id", "left")
    known = cut(known.select("v", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = rows.filter("sound").join(known, "v", "left").select("own", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
    alone = rows.filter("NOT sound").select("own", F.lit(0).cast("bigint").alias("n_links"), F.col("own").alias("component_id"))
    return linked.union(alone).select(F.col("own").alias(id_col), "n_links", "component_id", (F.col("own") == F.col("component_id")).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS id, b AS c FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.c = p.a),
m AS (SELECT id, min(c) AS low FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS k FROM p GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN n ON n.id = vec_id
"""
