"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Text is cut into pieces that merges never cross. A piece is a stream of bytes: the transducer reads
up to a window of it, applies the merges there and emits the tokens that end at least ``lookahead``
bytes before the window's edge. No text that follows can change these, so they are stable, and
reading goes on from the end of the last one. Memory is a window and a bounded memo of pieces,
however long the piece or the text.

Why a lookahead exists: appended bytes can take the last token away from a merge by rule i = (a, b),
which leaves a free for a later rule j = (c, a), j > i, which takes c away from a still later one, and
so on to the left. Each step needs a higher rule whose right part is the left part of the one before,
so the bytes of the longest such chain bound how far back a change can reach.

Cases: null is the empty text: no tokens, digests of the empty string; special tokens of the
vocabulary are matched in the text as the library does; of merges of equal rank the leftmost comes first;
very long texts, with or without white space, are handled segment by segment and a long piece window by
window; repeated rows give equal rows; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import returns, ship, table

#: The cut into pieces, as byte-level vocabularies define it; white space as in Unicode's White_Space.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same for U+0000 to U+00FF, written out for the faster engine.
_L, _N, _W = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
#: Pieces in the memo, by generation; characters of text that are cut into pieces at once.
MEMO, SEGMENT = 1 << 18, 1 << 16
#: Characters of a piece whose ids are given out in parts of so many.
LONG = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges, token bytes and special tokens of a tokenizer file's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        #: left << 20 | right -> rank, and rank -> merged id
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes of the longest chain of rules along which a change can travel, and two tokens to spare."""
        by_left: dict[int, int] = {}
        most, longest = 0, max(map(len, self.bytes_of.values()), default=1)
        for pair in sorted(self.rank, key=self.rank.get):
            a, b = pair >> 20, pair & 0xFFFFF
            reach = len(self.bytes_of[a]) + max(len(self.bytes_of[b]), by_left.get(b, 0))
            by_left[a] = max(by_left.get(a, 0), reach)
            most = max(most, reach)
        return most + 2 * longest


class Transducer:
    """Encodes and decodes with one vocabulary. ``window`` is in bytes, over the lookahead."""

    def __init__(self, vocab: Vocabulary, window: int = 4096, memo: int = MEMO):
        self.v, self.any_cut, self.latin_cut = vocab, regex.compile(PIECES), re.compile(LATIN_PIECES)
        #: No token is longer than a window, so each one emits something.
        self.window = max(window, *map(len, vocab.bytes_of.values()))
        #: Places where one piece ends and another begins in any case: before white space, and where letters, numbers
        #: and other characters meet, but after an apostrophe.
        self.safe = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{L}\p{White_Space}])|(?<=\p{N})(?=[^\p{N}\p{White_Space}])|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{L}\p{N}])")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.memo = _Memo(self, memo)
        self.by_name = {str(i): b for i, b in vocab.bytes_of.items()}

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a bounded string: always the merge of lowest rank, the leftmost of equals first."""
        ids = [self.v.byte_id[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.v.rank.get, len(self.v.merged)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            k = ranks.index(low)
            ids[k] = self.v.merged[low]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list and a heap."""
        get, n = self.v.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r] = self.v.merged[m], -1
            after[k] = after[r]
            if after[r] < n:
                before[after[r]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (m := get(ids[left] << 20 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[after[left]]))
        return [i for i in ids if i >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """The tokens of a piece of any length; each is emitted once it is stable."""
        at, size = 0, self.v.lookahead + self.window
        while at < len(data):
            part = data[at : at + size]
            last, stable, end = at + size >= len(data), len(part) - self.v.lookahead, 0
            for i in self.merge(part):
                if not last and end + len(self.v.bytes_of[i]) > stable:
                    break
                end += len(self.v.bytes_of[i])
                yield i
            at += end

    def in_parts(self, data: bytes) -> Iterator[str]:
        """A long piece's ids as runs of decimals."""
        ids = self.stream(data)
        while part := ",".join(map(str, islice(ids, LONG))):
            yield part

    def segments(self, text: str) -> Iterator[str]:
        """The text in segments of about SEGMENT characters, cut only where pieces end in any case."""
        at = 0
        while len(text) - at > SEGMENT:
            m = self.safe.search(text, at + SEGMENT)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:] if at else text

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_cut.findall(text)
        return self.latin_cut.findall(text)

    def encode_parts(self, text: str) -> Iterator[str]:
        """Token ids as runs of decimals joined by commas."""
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                yield str(self.v.special[part])
                continue
            for seg in self.segments(part):
                pieces = self.cut(seg)
                if len(seg) <= 2 * SEGMENT:
                    yield ",".join(map(self.memo.__getitem__, pieces))
                    continue
                for piece in pieces:
                    yield from [self.memo[piece]] if len(piece) <= LONG else self.in_parts(piece.encode())

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.encode_parts(text or "") for i in p.split(",")]

    def decode(self, ids) -> str:
        """Text of ids by the incremental state machine; bytes that are no UTF-8 become U+FFFD."""
        d = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join(d.decode(self.v.bytes_of[i]) for i in ids) + d.decode(b"", True)

    def digests(self, text: str | None, with_ids: bool = False) -> tuple:
        """(tokens, SHA-256 of the ids, SHA-256 of the decoded text, ids or None), in one pass over segments."""
        ids_sha, text_sha, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
        d = codecs.getincrementaldecoder("utf-8")("replace")
        for part in self.encode_parts(text or ""):
            names = part.split(",")
            ids_sha.update(("," + part if n else part).encode())
            n += len(names)
            text_sha.update(d.decode(b"".join(map(self.by_name.__getitem__, names))).encode())
            if with_ids:
                kept.append(np.array(names, dtype=np.int32))
        text_sha.update(d.decode(b"", True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest(), (np.concatenate(kept) if kept else np.zeros(0, np.int32)) if with_ids else None


class _Memo(dict):
    """Piece to its ids as text, in two generations of bounded size; long pieces are not kept."""

    def __init__(self, owner: Transducer, most: int):
        super().__init__()
        self.owner, self.most, self.old = owner, most, {}

    def forget(self) -> None:
        """Workers outlive their tasks; the memo doesn't."""
        self.old = {}
        self.clear()

    def __missing__(self, piece: str) -> str:
        out = self.old.get(piece)
        if out is None:
            data = piece.encode()
            out = ",".join(map(str, self.owner.merge(data) if len(data) <= 64 else self.owner.stream(data)))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


_made: dict[int, Transducer] = {}


def transducer(text: str) -> Transducer:
    """One per Python worker and vocabulary."""
    key = hash(text)
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(Vocabulary(text))
    return _made[key]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row.

    The vocabulary file is read by the driver and sent along, so executors need no copy of it.
    """
    ship(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        text = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(text)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [t.digests(x.as_py(), with_ids) for x in part.column(1)]
                cols = {id_col: part.column(0), "n_tokens": pa.array([g[0] for g in got], pa.int64()), "ids_sha256": pa.array([g[1] for g in got], pa.string()), "decoded_sha256": pa.array([g[2] for g in got], pa.string())}
                if with_ids:
                    ends = np.cumsum([0, *(len(g[3]) for g in got)]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g[3] for g in got]) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_pydict(cols)
        t.memo.forget()

    schema = returns(df, [id_col], "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    return df.select(id_col, text_col).mapInArrow(run, schema)


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), production_path())
