import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from millrace.llm import bpe, langid
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_substrings import brute as plain_removal

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, on the smallest table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"input": docs.orderBy("doc_id").collect(), "predicted": langid.op10_language_id(spark, DATA).collect()}
    for name, f in cp.STAGES:
        docs = cp.cut(f(spark, docs, DATA))
        out[name] = docs.orderBy("doc_id").collect()
    return out


def test_columns(stages):
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mixing", "bpe"]
    for n in names[:-1]:
        assert stages[n][0].__fields__ == stages["input"][0].__fields__


def test_every_stage_against_brute_force(stages):
    src = stages["input"]
    seen = {r.doc_id: r for r in stages["predicted"]}
    assert [r.asDict() for r in stages["language_id"]] == [{**r.asDict(), "lang": seen[r.doc_id].lang_pred} for r in src if r.text and any(map(str.isalpha, r.text)) and seen[r.doc_id].score >= cp.LEAST_SCORE]
    comp = plain_components({r.doc_id: plain_fingerprint(r.text) for r in stages["language_id"]})
    assert stages["simhash_near_dedup"] == [r for r in stages["language_id"] if comp[r.doc_id] == r.doc_id]
    want = plain_removal([r.text for r in stages["simhash_near_dedup"]], cp.REPEAT)
    for r, (n, removed, _, sha), before in zip(stages["suffix_array_dedup"], want, stages["simhash_near_dedup"], strict=True):
        assert r.n_chars == len(r.text) and (removed or r.text == before.text)
        assert hashlib.sha256(r.text.encode()).hexdigest() == sha or len(r.text.encode()) < n - removed
    kept = {r.doc_id: r for r in stages["suffix_array_dedup"]}
    sizes, taken = {}, {}
    for r in kept.values():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in stages["mixing"]:
        assert kept[r.doc_id] == r
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert 1.2 < sum(taken.values()) / sum(sizes.values()) < 2 and all(taken[s] <= 2 * sizes[s] for s in taken)
    lib = Tokenizer.from_file(bpe.production_path())
    assert sorted((r.doc_id, tuple(r.ids)) for r in stages["bpe"]) == sorted((r.doc_id, tuple(lib.encode(r.text, add_special_tokens=False).ids)) for r in stages["mixing"])
    assert all(r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].text.encode()).hexdigest() for r in stages["bpe"])


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, u int, row string"
    rows = [(1, "the of and to in that is " * 4, "en", "a", 100, 1, "x")] * 2 + [(2, None, None, None, None, 2, "x"), (3, "", "en", "a", 0, 3, "x"), (None, "der die und das ist von zu", "de", None, 26, 4, "x"), (4, "12 34", "en", "b", 5, 5, "x")]
    for data, n in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for _, f in cp.STAGES:
            docs = cp.cut(f(spark, docs, DATA))
        assert docs.count() >= n


def test_language_stage_decides_by_evidence(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, "the of and to in that is " * 4, "en", "a", 100) for k in range(12)]
    odd = [(20, "\u4f60\u597d\u4e16\u754c " * 9, None, "a", 45), (21, "\u4f60\u597d\u4e16\u754c " * 9, "en", "a", 45), (22, "12 34", "en", "a", 5), (23, None, "en", "a", None)]
    # A label none of whose texts teaches anything.
    rare = [(24, "\u0434\u0430", "ru", "a", 2)]
    stage = lambda data: sorted(r.doc_id for r in cp.language_id(spark, spark.createDataFrame(data, schema), DATA).collect())
    assert stage(rows + odd + rare) == [*range(12), 24]


def test_language_stage_without_languages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the of and", None, "a", 10), (2, "\u4f60\u597d", None, "a", 2), (3, "12 34", None, "a", 5), (4, None, None, "a", None), (5, "", None, "a", 0)]
    for lang in (None, "en"):  # no label, or too little text to learn from
        docs = spark.createDataFrame([(*r[:2], lang, *r[3:]) for r in rows], schema)
        assert sorted(r.doc_id for r in cp.language_id(spark, docs, DATA).collect()) == [1, 2]


def test_language_stage_writes_the_language_into_the_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int"
    texts = {"en": "the of and to in that is for it was on are as with they be at this have from ", "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch "}
    rows = [(k + 100 * i, t * 3, lang, "a", 200, k) for i, (lang, t) in enumerate(texts.items()) for k in range(12)]
    odd = [(300, texts["de"], "en", "a", 80, 1), (301, texts["en"], None, "a", 80, 2), (302, "the of and to " + "\u4f60\u597d\u4e16\u754c" * 40, "en", "a", 170, 3)]
    got = {r.doc_id: r for r in cp.language_id(spark, spark.createDataFrame(rows + odd, schema), DATA).collect()}
    assert (got[300].lang, got[301].lang, got[301]["a.b"]) == ("de", "en", 2)
    assert 302 not in got and len(got) == 26  # most of its n-grams are of no learned language


def test_choice_among_rows_alike_in_id_and_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` array<int>"
    rows = [(1, "one text that stands here twice", "en", s, 5, [k]) for k, s in enumerate("cab")] + [(2, "another text of its own kind", None, None, None, None)]
    got = set()
    for turn in range(3):
        docs = spark.createDataFrame(rows[turn:] + rows[:turn], schema).repartition(turn + 1)
        out = cp.simhash_near_dedup(spark, docs, DATA).collect()
        assert sorted(r.doc_id for r in out) == [1, 2]
        got.add(next(r.source for r in out if r.doc_id == 1))
    assert len(got) == 1


def test_passages_of_over_fifty_words_go(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    word = lambda a, b: chr(97 + a * 7 % 23) + chr(97 + b * 5 % 19) + chr(97 + (a * b) % 17)
    passage = " ".join(word(k, k * k % 31) for k in range(51))
    own = [" ".join(word(k * 3 + i, k + i * i) + str(i) for k in range(60)) for i in range(3)]
    docs = spark.createDataFrame([(0, f"{own[0]} {passage} {own[0][::-1]}", "en", "a", 0), (1, f"{own[1]} {passage}", "en", "a", 0), (2, own[2], "en", "a", 0)], schema)
    got = {r.doc_id: r.text for r in cp.suffix_array_dedup(spark, docs, DATA).collect()}
    assert len(passage) < 210 and not any(passage[5:-5] in t for t in got.values())
    assert got[2] == own[2] and own[1] == got[1].strip()


def test_very_long_texts(spark):
    """Longer than every chunk of the stages; one of them twice, so that it goes as a copy."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"{w} {k * k} the of and" for k, w in enumerate(["to", "in", "that"] * 40_000))
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), *((k, f"the of and to in that is number {k} " * 3, "en", "a", 100) for k in range(3, 12))]
    docs = spark.createDataFrame(rows, schema)
    for name, f in cp.STAGES:
        docs = cp.cut(f(spark, docs, DATA))
        if name == "simhash_near_dedup":
            assert 1 in (ids := [r.doc_id for r in docs.select("doc_id").collect()]) and 2 not in ids
    assert all(r.n_tokens > 500_000 for r in docs.filter("doc_id = 1").collect()) and docs.filter("doc_id = 1").count() >= 1
