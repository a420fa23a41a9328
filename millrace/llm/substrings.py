"""Removal of long repeated byte strings, by merged Burrows-Wheeler transforms.

Every window of ``length`` bytes has an anchor: the k-gram of least hash inside it, the leftmost of
equals. Equal windows have equal anchors at equal offsets, so windows are compared only within the
group of an anchor that occurs twice or more. The stretch of text whose windows share one anchor
occurrence is a fragment. Equal fragments are told by their digests: all their windows repeat. Groups
with unlike fragments go to ``bwt.repeated``, where the anchor, common to the group, is one symbol, so
that a window is length - k + 1 symbols and the transforms are merged to that depth.

A group of very many unlike fragments is never gathered: it is halved by content. Windows that reach
at least half-way left of the anchor share that much more text, and so do the others to the right;
fragments go to a group of either half under the key of the longer common text, where equal ones are
one again, until groups are small.

A row is told from others by 128 bits of hash of its id and text. Keys with more than one in HEAVY of
all rows, of which there are HEAVY at most, are joined by broadcasting them, so that no task of a join
gets all members of a common passage.

Cases: null is the empty text; texts shorter than the length lose nothing; repeated rows and copies
repeat each other and are removed wholly if long enough; very long texts are hashed in chunks that
overlap by a window, so no window is lost; of equally small hashes the leftmost is the anchor; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bwt import repeated
from millrace.llm.common import cut, returns, ship, table

LENGTH = 400
#: Bytes of an anchor: longer ones leave less to the transforms, shorter ones leave fewer anchors.
ANCHOR = 272
#: Fragments of a group that one task sorts; symbols that are sorted at once.
GROUP, SYMBOLS = 256, 1 << 18
#: Groups that are sorted at once: with the bytes in use they mostly stay below 256 symbols.
GROUPS = 150
#: Windows of a text that are handled at once.
CHUNK = 1 << 20
#: A key is heavy with more than one in so many rows.
HEAVY = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, inv = max(n, 1 << 14), pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))])) for b in (_BASE, inv)]
    return _POWERS[0], _POWERS[1]


def anchors(data: bytes, length: int = LENGTH, k: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, digest, first window, anchor, last window) of every fragment of a text, chunk by chunk."""
    w = length - k + 1
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = len(part)
        power, inverse = _powers(n + 1)
        t = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
        s = np.concatenate([[np.uint64(0)], np.cumsum(t * power[:n], dtype=np.uint64)])
        grams = n - k + 1
        z = _mix((s[k:] - s[:grams]) * inverse[:grams])
        # Sliding minimum: of a window's rest of one block and of the start of the next, with places in the low bits.
        blocks = -(-grams // w) + 1
        low = np.full(blocks * w, ~np.uint64(1023))
        low[:grams] = z & ~np.uint64(1023)
        low = low.reshape(blocks, w)
        place = np.arange(w, dtype=np.uint64)
        rest = np.minimum.accumulate((low | place)[:, ::-1], axis=1)[:, ::-1]
        start = np.minimum.accumulate(low | (place + np.uint64(w)), axis=1)
        best = rest[:-1].copy()
        best[:, 1:] = np.minimum(best[:, 1:], start[1:, :-1])
        windows = n - length + 1
        owner = ((best & np.uint64(1023)).astype(np.int64) + np.arange(blocks - 1)[:, None] * w).ravel()[:windows]
        lo = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        hi = np.concatenate([lo[1:], [windows]]) - 1
        p = owner[lo]
        span = (hi - lo + length).astype(np.uint64) * np.uint64(1024) + (p - lo).astype(np.uint64)
        digest = _mix(_mix((s[hi + length] - s[lo]) * inverse[lo]) ^ (span * np.uint64(0x94D049BB133111EB)))
        yield z[p].view(np.int64), digest.view(np.int64), lo + at, p + at, hi + at


def _row_key() -> list[Column]:
    """128 bits of hash as two columns."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc", text).alias("u"), F.xxhash64(F.lit("second"), text, "doc").alias("x")]


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], n: str, want: Column | None = None) -> DataFrame:
    """Rows whose key is among those of ``keys`` that are wanted; column ``n`` of these unique keys says how many rows each has.

    The heavy keys are HEAVY at most whatever the table's size, which bounds the broadcast."""
    limit = max(1, rows.count() // HEAVY)
    want = F.lit(True) if want is None else want
    heavy = keys.filter(F.col(n) > limit)
    if not heavy.limit(1).collect():
        return rows.join(keys.filter(want).select(*on), on)
    hot, cold = F.broadcast(heavy.filter(want).select(*on)), keys.filter((F.col(n) <= limit) & want).select(*on)
    return rows.join(hot, on).union(rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(cold, on))


def _data(x) -> bytes:
    return (x.as_py() or "").encode()


def _scan(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                part = b.slice(at, 512)
                for u, x, text in zip(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), strict=True):
                    for h, d, lo, p, hi in anchors(_data(text), length, k):
                        for c, v in zip(cols, (np.full(len(h), u), np.full(len(h), x), h, d, lo << 16 | (p - lo) << 8 | (hi - lo)), strict=True):
                            c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["u", "x", "h", "d", "loc"])

    return run


def _fetch(length: int, k: int):
    """Fragments' text left and right of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(at, 512) for part in batches for at in range(0, part.num_rows, 512)):
            out: dict[str, list] = {c: [] for c in ("key", "u", "x", "loc", "twin", "l", "r")}
            for u, x, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                data = _data(text)
                for a in asked:
                    lo = a["loc"] >> 16
                    p, hi = lo + (a["loc"] >> 8 & 255), lo + (a["loc"] & 255)
                    for c, v in zip(out, (a["h"], u, x, a["loc"], a["twin"], data[lo:p], data[p + k : hi + length]), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], list(out))

    return run


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    if not len(places):
        return []
    ends = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.concatenate([[0], ends + 1])].tolist(), places[np.concatenate([ends, [len(places) - 1]])].tolist(), strict=True))


def _resolve(width: int, length: int):
    """Repeated windows of small groups; rows come sorted by key."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # One symbol for each group's anchor, above the bytes.
        symbol = {key: 257 + i for i, key in enumerate(dict.fromkeys(r[0] for r in rows))}
        strings = [np.concatenate([np.frombuffer(r[5], np.uint8).astype(np.int64) + 1, [symbol[r[0]]], np.frombuffer(r[6], np.uint8).astype(np.int64) + 1]) for r in rows]
        us, xs, ss, es = [], [], [], []
        for r, hit in zip(rows, repeated(strings, width + 1), strict=True):
            _, u, x, loc, twin, left, _, off = r
            if twin:
                continue
            p = (loc >> 16) + (loc >> 8 & 255)
            # A window that starts at place q of the string reaches len(left) - q bytes left of the anchor.
            q = np.flatnonzero(hit[: len(left) + 1])
            for a, b in _runs(q):
                us.append(u)
                xs.append(x)
                ss.append(p - off - (len(left) - a))
                es.append(p - off - (len(left) - b) + length)
        return pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "x": pa.array(xs, pa.int64()), "s": pa.array(ss, pa.int64()), "e": pa.array(es, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, groups = 0, 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and row[0] != held[-1][0]:
                    groups += 1
                    if size > SYMBOLS or groups >= GROUPS:
                        yield solve(held)
                        held, size, groups = [], 0, 0
                held.append(row)
                size += len(row[5]) + len(row[6]) + 2
        if held:
            yield solve(held)

    return run


def _halve(width: int):
    """Both halves of a fragment's windows, each under the key of the text that all its windows have."""
    c = (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, u, x, loc, twin, left, right, off in zip(*[x.to_pylist() for x in b.columns], strict=True):
                seed = key & (1 << 64) - 1
                if len(right) >= width - (c - 1):
                    core = right[: width - (c - 1)]
                    out.append((xxhash.xxh64_intdigest(b"R" + core, seed), u, x, loc, twin, left[len(left) - min(len(left), c - 1) :], right[len(core) :], off, c - 1))
                if len(left) >= c:
                    core = left[len(left) - c :]
                    out.append((xxhash.xxh64_intdigest(b"L" + core, seed), u, x, loc, twin, left[: len(left) - c], right[: width - c], off + c, width - c))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            keys = pa.array(np.array(cols[0], np.uint64).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(v, t) for v, t in zip(cols[1:], kinds, strict=True)]], ["key", "u", "x", "loc", "twin", "l", "r", "off", "width"])

    return run


_COLUMNS = ["key", "u", "x", "loc", "twin", "l", "r"]
_FRAGMENT = "key bigint, u bigint, x bigint, loc bigint, twin boolean, l binary, r binary"
_SPAN = "u bigint, x bigint, s bigint, e bigint"


def _unlike(frags: DataFrame, length: int, width: int, group: int, top: bool = True) -> list[DataFrame]:
    """(u, x, s, e) of repeated windows in groups of unlike fragments; crowded groups are halved."""
    sizes = cut(frags.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    few = _meet(frags, sizes, ["key"], "m", F.col("m") <= group).select(*_COLUMNS, "off")
    # Dealt by a hash of the key: dealt by the key, it would be merged with the join's exchange, whose
    # partitions are joined by their bytes, and sorting costs much more than these bytes say.
    parts = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = [cut(few.repartition(parts if top else max(1, parts // 4), F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(_resolve(width, length), _SPAN))]
    if not sizes.filter(F.col("m") > group).limit(1).collect():
        return found
    crowded = _meet(frags, sizes, ["key"], "m", F.col("m") > group)
    halves = cut(crowded.select(*_COLUMNS, "off").mapInArrow(_halve(width), _FRAGMENT + ", off int, width int"))
    # A twin stands for fragments whose verdict is known; others become twins where they are alike now.
    same = ["key", "width", "l", "r"]
    alike = cut(halves.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("u", "x", "loc", "off", "twin")).alias("one")))
    whole = _meet(halves, alike.filter("n > 1"), same, "n").filter("NOT twin")
    p = F.shiftright("loc", 16) + F.shiftright("loc", 8).bitwiseAND(F.lit(255))
    # Windows of the half: y from width - len(r) to len(l) bytes left of its anchor.
    found.append(cut(whole.select("u", "x", (p - F.col("off") - F.octet_length("l")).alias("s"), (p - F.col("off") - (F.col("width") - F.octet_length("r")) + length).alias("e"))))
    left = alike.select("key", "one.u", "one.x", "one.loc", (F.col("one.twin") | (F.col("n") > 1)).alias("twin"), "l", "r", "one.off", "width")
    for wd in sorted({(width + 1) // 2 - 1, width - (width + 1) // 2}):
        rows = left.filter((F.col("width") == wd) & (F.lit(wd) > 0)).drop("width")
        if wd > 0:
            found += _unlike(rows, length, wd, group, False)
    return found


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(u, x, spans) for the rows (u, x, text) that have windows starting elsewhere too; spans are [s, e) in bytes and may overlap."""
    # Written once: hashing the texts again would cost more than reading these back.
    found = cut(docs.mapInArrow(_scan(length, k), "u bigint, x bigint, h bigint, d bigint, loc bigint"))
    again = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    members = cut(_meet(found, again, ["h"], "n"))
    alike = cut(members.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("u", "x", "loc")).alias("one")))
    lo = F.shiftright("loc", 16)
    whole = _meet(members, alike.filter("n > 1"), ["h", "d"], "n")
    spans = cut(whole.select("u", "x", lo.alias("s"), (lo + F.col("loc").bitwiseAND(F.lit(255)) + length).alias("e")))
    mixed = cut(alike.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1"))
    asked = _meet(alike, mixed, ["h"], "m", F.col("least") == 1).select("one.u", "one.x", F.struct("h", "one.loc", (F.col("n") > 1).alias("twin")).alias("a")).groupBy("u", "x").agg(F.collect_list("a").alias("asked"))
    # Rows that are alike in id and text share their key: one of them serves.
    frags = docs.join(cut(asked), ["u", "x"]).dropDuplicates(["u", "x"]).select("u", "x", "text", "asked").mapInArrow(_fetch(length, k), _FRAGMENT)
    frags = cut(frags.withColumn("off", F.lit(0)))
    for part in _unlike(frags, length, length - k, group):
        spans = spans.union(part)
    return cut(spans.distinct().groupBy("u", "x").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for text, spans in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    data, kept, n, end = _data(text), [], 0, 0
                    removed = 0
                    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                        if s > end or not n:
                            n += 1
                            kept.append(data[end:s])
                            removed += e - s
                        else:
                            removed += max(0, e - end)
                        end = max(end, e)
                    left = b"".join([*kept, data[end:]])
                    for c, v in zip(out, (len(data), removed, n, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if with_text else None), strict=True):
                        out[c].append(v)
                cols = [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(cols if with_text else cols[:4])], ["doc", *(list(out) if with_text else list(out)[:4])])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: what
    is left as text. A character that a cut leaves incomplete is dropped from ``kept``, not from the digest."""
    if not 0 < k < length or length - k > 255:
        raise ValueError("the anchor must be shorter than the length, by 255 bytes at most")
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    keyed = docs.select(*_row_key(), "doc", "text")
    spans = repeats(keyed.select("u", "x", "text"), length, k, group)
    joined = keyed.join(spans, ["u", "x"], "left").select("doc", "text", "spans")
    schema = returns(docs, ["doc"], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if with_text else ""))
    return joined.mapInArrow(_apply(with_text), schema).withColumnRenamed("doc", id_col)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
