"""Sharding by jump consistent hashing (law ``key``), in DataFrame functions only.

A stable 64-bit key of the id walks the buckets it would have lived in as shards were appended; the
last stop below the shard count is its shard. Nothing but the id and the count decides, and with one
shard more only rows that move into the new shard change place.

Slots follow the order of (id, CRC, size). Rows are dealt to runs by range in that order, so that runs are
alike in size whether ids are dense, hashes, or one id repeated with many texts.

Cases: a null text has size 1 and CRC 0; a null id counts as the empty text, shares one key and comes
first; ids may be of any type that sorts; repeated rows have the same shard and slots of their own, which
of them has which is left open, and stay in one run; very long texts cost their bytes once, for the CRC; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, table

_MULTIPLIER = "2862933555777941757"  # fixed: the generator of jump consistent hashing
_WORD = "18446744073709551616"


def stable_key(key: Column) -> Column:
    """64 bits of MD5 as DECIMAL(20,0), the same on every engine."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump(key: Column, n: int) -> Column:
    """(shard among n, shard among n + 1) as a struct, from one walk.

    The state is the generator's, the bucket and the next one; unsigned 64-bit arithmetic is done in
    DECIMAL(38,0), which holds every product. At most n + 1 steps; about ln n of them do any work.
    """
    state = F.struct(key.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(-1).cast("bigint").alias("grown"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(_MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(_WORD).cast("decimal(20,0)")).cast("decimal(20,0)")

        def go(arr: Column) -> Column:
            top = F.call_function("div", arr, F.lit(1 << 33).cast("decimal(20,0)"))
            j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("bigint")
            return F.struct(arr.alias("k"), F.when(s["j"] < n, s["j"]).otherwise(s["b"]).alias("b"), s["j"].alias("grown"), j.alias("j"))

        return F.when(s["j"] > n, s).otherwise(F.transform(F.array(k), go)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(n + 1)), state, step, lambda s: F.struct(s["b"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown_shard")))


def deal(rows: DataFrame, runs: int) -> DataFrame:
    """Rows with the number of their ``run``, a range in the order of (id, CRC, size).

    Both cuts hold a few bytes a row: the range's limits come from a sample of the first, and the second fixes the runs."""
    return cut(cut(rows).repartitionByRange(runs, "id", "text_crc32", "size").withColumn("run", F.spark_partition_id()))


def shard(df: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 without gaps in each shard, by id. They are numbered in two levels, so that no
    task holds a whole shard: within a run, and by a prefix sum over the runs' counts. There are ``runs``
    runs, the session's shuffle partitions unless given.
    """
    runs = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
        jump(stable_key(F.col(id_col)), n).alias("to"),
    ).select("id", "size", "text_crc32", "to.*")
    rows = deal(rows, runs)
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "run").orderBy("id", "text_crc32", "size")
    return rows.join(starts, ["shard", "run"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.row_number().over(within) - 1).cast("bigint").alias("slot"), "grown_shard"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text"), 16)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) g(i)) q),
hexed AS MATERIALIZED (SELECT r, hex(encode(t)) AS h FROM d),
bytes AS MATERIALIZED (SELECT r, list_transform(range(1, CAST(strlen(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bs FROM hexed),
crc AS (SELECT r, xor(list_reduce(bs,
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM bytes, tab),
walk(r, n, k, b, j) AS (
    SELECT r, n, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS UHUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d, (VALUES (16), (17)) m(n)
    UNION ALL
    SELECT r, n, k2, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT r, n, j, (k * CAST(2862933555777941757 AS UHUGEINT) + 1) % CAST(18446744073709551616 AS UHUGEINT) AS k2 FROM walk WHERE j < n) s),
place AS (SELECT r, max(b) FILTER (WHERE n = 16) AS shard, max(b) FILTER (WHERE n = 17) AS grown FROM walk GROUP BY r)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, strlen(t)) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM d JOIN crc USING (r) JOIN place USING (r)
"""
