import random
import re
import zlib
from collections import Counter

from millrace.llm import langid

DATA = "/root/testdata/sf0.01"


def test_filter_has_no_false_negatives_and_few_false_positives():
    import numpy as np

    rng = np.random.default_rng(1)
    f = langid.Filter([f"l{k}" for k in range(70)])
    sets = {k: rng.integers(0, 1 << 63, 2000).astype(np.uint64) for k in (0, 3, 69)}
    for k, h in sets.items():
        f.add(h, k)
    for k, h in sets.items():
        assert f.votes(h)[k] == len(h)
    other = f.votes(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    assert other.sum() <= 20 and (f.false_positives()[[0, 3, 69]] < 1e-3).all()


def test_held_out_accuracy(spark):
    rows = langid.op10_language_id(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in test) / len(test) > 0.97


def test_odd_rows(spark):
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 .. !", "x"), (4, "a", "x"), (4, "a", "x"), (None, "the of and " * 30, "x"), (5, "und der die " * 200_000, "x")], "doc_id long, text string, score string")
    got = sorted(langid.predict(df, model).collect(), key=lambda r: (r.doc_id or 0, r.lang_pred))
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3 and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"] and [r.lang_pred for r in got if r.doc_id == 5] == ["de"]
    assert len([r for r in got if r.doc_id == 4]) == 2
    none = langid.fit(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_chunks_lose_no_ngram(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé .你İΣ\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    whole = [sorted(np.concatenate([*langid.ngrams(t), np.zeros(0, np.uint64)]).tolist()) for t in texts]
    for chunk in (1, 2, 3, 7, 30):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert [sorted(np.concatenate([*langid.ngrams(t), np.zeros(0, np.uint64)]).tolist()) for t in texts] == whole


def grams(text):
    """The n-grams themselves: letters in lower case, anything else as one blank."""
    t = re.sub(r" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return [t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)]


def test_votes_against_exact_sets(spark):
    """Texts are judged as by exact sets of the n-grams, counted and chosen in plain Python."""
    docs = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text]
    seen = {}
    for r in docs:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            seen.setdefault(r.lang, Counter()).update(grams(r.text))
    counts = {lang: {g: n for g, n in c.items() if n >= langid.LEAST} for lang, c in seen.items()}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    sets = {lang: {g for g, s in c.items() if s >= langid.SHARE * max(x.get(g, 0) for x in share.values())} for lang, c in share.items()}
    model = langid.fit(spark.createDataFrame(docs))
    fp = model.false_positives()
    for r in docs[:300]:
        if not any(map(str.isalpha, r.text)):
            continue
        own = grams(r.text)
        want = {lang: sum(g in s for g in own) / len(own) for lang, s in sets.items()}
        lang, score = model.predict(r.text, fp)
        assert abs(score - want[lang]) < 0.01 and want[lang] >= max(want.values()) - 0.01


def test_long_documents_teach_only_alone(spark, monkeypatch):
    monkeypatch.setattr(langid, "LONGEST", 200)
    rows = [(k, "the of and to in " * 5, "en") for k in range(12)] + [(100 + k, "quux zyx wvu " * 500, "en") for k in range(9)] + [(200 + k, "der die und das ist " * 50, "de") for k in range(9)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.learned() == ["de", "en"] and model.predict("quux zyx wvu", model.false_positives())[1] < 0.2
