import hashlib
import itertools
import json
import random

import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(bpe.production_path())


@pytest.fixture(scope="module")
def mine():
    with open(bpe.production_path(), encoding="utf-8") as f:
        return bpe.Transducer(bpe.Vocabulary(f.read()), window=64)


HARD = [
    "", " ", "\n\n  x", "a  b   c\t\td", "don't we'll I'M", "x y  z　", "\x1c\x1d\x1e\x1f a\x85b​᠎", "été ÉÉ ß漢字かな🙂🙂‍👩️", "a<|endoftext|>b <|endoftext|><|endoftext|> c<|endoftext",
    "١٢٣ ½ Ⅷ 12,345.678", "퟿￿", "a" * 5000, "ab" * 3000, "=" * 3001, " " * 2000 + "x", "\n" * 1000, "ÃÂ" * 900, "-" * 70 + "é" * 90, "ha" * 77 + "hhaha" * 99,
]


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_hard_texts(lib, mine, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_random_long_pieces(lib, mine):
    """Letters only: one piece each, far over a window; made of vocabulary strings, which merge most."""
    rng = random.Random(1)
    pool = [b.decode() for b in mine.v.bytes_of.values() if b.isalpha() and b.isascii()]
    for n in range(60):
        text = "".join(rng.choice(pool if n % 2 else pool[:400]) for _ in range(600))
        assert mine.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_utf8(lib, mine):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_segments_keep_tokens(lib, mine, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 20)
    text = "one two  three\n four don't  five " * 40 + "x" * 90
    assert mine.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded(lib, mine):
    t = bpe.Transducer(mine.v, memo=10)
    text = " ".join(f"w{k}" for k in range(500))
    assert t.encode(text) == lib.encode(text, add_special_tokens=False).ids and len(t.memo) <= 10


def test_operator(spark, lib):
    texts = [None, "", *HARD, "x y", "x y"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_decode(df, bpe.production_path(), with_ids=True).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[k].ids) == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), bpe.production_path()).count() == 0


def test_query_on_whole_table(spark, lib):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = bpe.op9_bpe(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_of_random_merge_lists(seed):
    """Every text up to a length over two letters, and longer random ones: the stream gives what merging the whole does."""
    rng = random.Random(seed)
    letters = bpe.byte_letters()
    vocab = {c: k for k, c in enumerate(letters)}
    tokens, merges = ["a", "b"], []
    for _ in range(rng.randrange(3, 14)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            tokens.append(a + b)
            merges.append([a, b])
    t = bpe.Transducer(bpe.Vocabulary(json.dumps({"model": {"vocab": vocab, "merges": merges}})), window=1)
    texts = ["".join(x) for n in range(11) for x in itertools.product("ab", repeat=n)] + ["".join(rng.choice("ab") for _ in range(400)) for _ in range(30)] + ["ab" * 300, "a" * 500, "aab" * 200]
    for x in texts:
        assert list(t.stream(x.encode())) == t.merge(x.encode())


def test_texts_without_spaces(lib, mine, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    monkeypatch.setattr(bpe, "LONG", 40)
    rng = random.Random(4)
    for text in ["你好，世界。" * 60, "x" * 900, "abc123'tis''s--'ll9" * 40, "a1" * 300, "'" * 300 + "s" * 300, "".join(rng.choice("ab1'-你\n") for _ in range(3000)), "\n" * 500 + "x" * 500]:
        assert mine.encode(text) == lib.encode(text, add_special_tokens=False).ids
        assert mine.digests(text)[2] == hashlib.sha256(text.encode()).hexdigest()
        assert max(map(len, mine.segments(text))) <= 1000  # two runs at most


def test_parts_of_a_very_long_piece_are_bounded(mine):
    parts = [p.count(",") + 1 for p in mine.encode_parts("你" * 400_000)]
    assert max(parts) <= bpe.LONG and sum(parts) == len(mine.encode("你" * 1000)) * 400
