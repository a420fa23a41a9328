"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter serves all languages: a slot holds a word with one bit per language, so the AND of an
n-gram's slots gives every language that contains it. A text's votes are counted per language bit and
corrected for that language's false-positive rate; the largest share decides.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is everything where no
labelled row can be learned from; equal shares go to the first language in code-point order; very long
texts are read in chunks that lose no n-gram, but aren't learned from where a language has shorter ones;
repeated rows are judged alike; an empty table gives no rows; other columns play no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import returns, ship, table

ORDERS = (3, 4)
#: Documents a language that are learned from (expected number; the ids' hashes decide which).
SAMPLE = 1500
#: Code points of a document that is learned from. A language with longer documents only learns from these.
LONGEST = 1 << 17
#: An n-gram belongs to a language if it was seen this often there, and at least this share as often as
#: in the language that uses it most (foreign lines in a text don't count).
LEAST, SHARE = 3, 0.05
SLOTS, HASHES = 1 << 19, 3
#: Code points that are handled at once.
CHUNK = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # odd multipliers


@cache
def _letters() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of each order, chunk by chunk: lower case, runs of other characters as one space."""
    text = text.lower()
    # The end of what has been read: a blank at first, later enough for the n-grams that reach into the next chunk.
    held = np.full(1, 32, np.uint64)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, 32).astype(np.uint64)
        if at + CHUNK >= len(text):
            codes = np.concatenate([codes, [np.uint64(32)]])
        blank = codes == 32
        new = codes[~(blank & np.concatenate([[held[-1] == 32], blank[:-1]]))]
        codes = np.concatenate([held, new])
        old, held = len(held), codes[-(max(ORDERS) - 1) :]
        for n in ORDERS:
            # Those that end in the new part.
            first = max(0, old - n + 1)
            if len(codes) - first >= n and len(new):
                own = codes[first:]
                h = np.full(len(own) - n + 1, n, np.uint64)
                for k in range(n):
                    h += own[k : len(own) - n + 1 + k] * _MIX[k]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                yield h ^ (h >> np.uint64(32))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Filter:
    """The bit-sliced filter: ``slots`` has one row per slot and one 64-bit word per 64 languages."""

    def __init__(self, langs: list[str], slots: int = SLOTS):
        self.langs = langs
        self.slots = np.zeros((slots, max(1, (len(langs) + 63) // 64)), np.uint64)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        """Double hashing; the slot count is a power of two."""
        mask, step = np.uint64(len(self.slots) - 1), (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]

    def add(self, h: np.ndarray, lang: int) -> None:
        for p in self.places(h):
            self.slots[p, lang // 64] |= np.uint64(1 << lang % 64)

    def learned(self) -> list[str]:
        """The languages that have n-grams."""
        return [lang for lang, rate in zip(self.langs, self.false_positives(), strict=True) if rate > 0]

    def false_positives(self) -> np.ndarray:
        """Per language: the share of strange n-grams that its bits let through."""
        bits = np.array([np.count_nonzero(self.slots[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.langs))])
        return (bits / len(self.slots)) ** HASHES

    def votes(self, h: np.ndarray) -> np.ndarray:
        """How many n-grams each language has."""
        p = self.places(h)
        m = self.slots[p[0]]
        for q in p[1:]:
            m = m & self.slots[q]
        if len(self.langs) <= 8:
            counts = np.bincount(m[:, 0].astype(np.int64), minlength=256)
            return np.array([counts[(np.arange(256) >> i) & 1 == 1].sum() for i in range(len(self.langs))])
        return np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)[: len(self.langs)]

    def predict(self, text: str | None, fp: np.ndarray) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        votes, n = np.zeros(len(self.langs)), 0
        for h in ngrams(text):
            votes += self.votes(h)
            n += len(h)
        share = np.clip((votes / max(n, 1) - fp) / (1 - fp).clip(1e-9), 0, 1)
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filter:
    """Learn from about ``sample`` documents a language, of LONGEST code points at most: an n-gram table of bounded size comes to the driver."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    short = F.length("text") <= LONGEST
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).collect()
    if not found:
        return Filter([])
    sizes = {r["lang"]: r["short"] or r["n"] for r in found}
    if alone := [r["lang"] for r in found if not r["short"]]:
        short |= F.col("lang").isin(alone)
    rows = rows.filter(short)
    # A document is drawn if its id's hash, as a share of all hashes, lies below the language's rate.
    draw = (F.xxhash64(F.lit("langid"), F.col("id")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    rate = F.lit(1.0)
    for lang, n in sizes.items():
        if n > sample:
            rate = F.when(F.col("lang") == lang, F.lit(sample / n)).otherwise(rate)
    langs = sorted(sizes, key=lambda s: [ord(c) for c in s])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, []).extend(ngrams(text))
        for lang, hs in seen.items():
            h, n = np.unique(np.concatenate([*hs, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(h), pa.string()), "h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = rows.filter(draw < rate).select("lang", "text").mapInArrow(count, "lang string, h bigint, n bigint")
    per = counted.groupBy("h", "lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).toPandas()
    totals = per.groupby("lang")["n"].sum()
    per["share"] = per["n"] / per["lang"].map(totals)
    most = per.groupby("h")["share"].transform("max")
    per = per[per["share"] >= SHARE * most]
    out = Filter(langs)
    for i, lang in enumerate(langs):
        out.add(per.loc[per["lang"] == lang, "h"].to_numpy(np.int64).view(np.uint64), i)
    return out


def predict(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row. The filter, of fixed size, is broadcast. The text may be a field of
    the id, ``id.field``, so that it isn't sent twice."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    inside = text_col.removeprefix(f"{id_col}.") if text_col.startswith(f"{id_col}.") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        fp = m.false_positives()
        for b in batches:
            got = [m.predict(x.as_py(), fp) for x in (b.column(0).field(inside) if inside else b.column(1))]
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

    return df.select(id_col, *([] if inside else [text_col])).mapInArrow(run, returns(df, [id_col], "lang_pred string, score double"))


def lettered(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([has_letter(x.as_py()) for x in b.column(text_col)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
