"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and keeps the measurements and one bit per failed rule.
Policies are masks over those bits, with versions; applying another policy, or asking what a rule
alone costs (``ablation``), reads the ledger and never the texts.

Cases: a null or empty text has no words, fails ``few_words`` and is not kept; a measure that equals its limit
passes; a very long text is held as arrays of a few numbers a word, some 100 bytes a word at most; repeated rows are
judged alike; an empty table gives an empty ledger; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import GAP, SPACE, let, table, words

#: Rule names in the order of their bits.
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "stutter", "word_length", "ellipsis_lines", "bullet_lines", "bare_words")
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Versioned policies: the rules that reject. ``base`` is the part that the contract fixes.
POLICIES = {"base": BIT["few_words"] | BIT["repeated_words"], "v1": sum(BIT[r] for r in RULES[:6]), "v2": sum(BIT.values())}
PRODUCTION = "v1"

WINDOW = 5
#: Lines that trail off, lines of a list, and words without a letter, for Java's patterns.
ELLIPSIS = r"(\.\.\.|\u2026)[\x20\x09-\x0D]*\z"
BULLET = r"\A[\x20\x09-\x0D]*[-*\u2022\u00B7\u25AA]"
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"


def repeat_words(w: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window found twice or more, for an array of word hashes.

    Windows are compared by 64-bit hashes. If all differ, nothing is sorted; otherwise hashes are
    sorted with their places and equal neighbours give the places to be covered. Linear but for sorts.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(k)), F.lit(k)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def pairs(s: Column) -> Column:
        twins = F.zip_with(s, F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return let(F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))), covered)

    def by_hash(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(marked, pairs))

    def over(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - k), lambda i: F.xxhash64(*[F.get(v, i + j) for j in range(k)]))
        return F.when(F.size(v) < k, F.lit(0).cast("bigint")).otherwise(let(hashes, by_hash))

    return over(w)


def measures(text: Column) -> Column:
    """All measurements of a text as one struct."""
    t = F.coalesce(text, F.lit(""))

    def having(full: Column, pattern: str) -> Column:
        return F.size(F.filter(full, lambda x: F.rlike(x, F.lit(pattern)))).cast("bigint")

    def lines(ls: Column) -> Column:
        return let(F.filter(ls, lambda x: F.trim(x, F.lit(SPACE)) != ""), lambda full: F.struct(F.size(full).cast("bigint").alias("n_lines"), (F.size(full) - F.size(F.array_distinct(full))).cast("bigint").alias("n_dup_lines"), having(full, ELLIPSIS).alias("n_ellipses"), having(full, BULLET).alias("n_bullets")))

    def of(w: Column) -> Column:
        again = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b)
        return F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.filter(again, lambda x: x)).cast("bigint").alias("n_stutter"))

    return F.struct(
        let(F.transform(words(t), lambda x: F.xxhash64(x)), of).alias("w"),
        let(F.split(t, "\n"), lines).alias("l"),
        F.length(F.regexp_replace(t, GAP, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals"),
        F.regexp_count(t, F.lit(BARE)).cast("bigint").alias("n_bare"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements and ``failed``, the bits of the rules that fail."""
    # inline() keeps the optimizer from copying a measure into each of its uses.
    m = df.select(F.col(id_col), F.inline(F.array(measures(F.col(text_col)))))
    m = m.select(id_col, "w.*", "l.*", "word_chars", "n_symbols", "n_capitals", "n_bare")
    fails = {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("n_words"),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "capitals": 100 * F.col("n_capitals") > 40 * F.col("word_chars"),
        "stutter": 100 * F.col("n_stutter") > 30 * F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
        "ellipsis_lines": 100 * F.col("n_ellipses") > 30 * F.col("n_lines"),
        "bullet_lines": 100 * F.col("n_bullets") > 90 * F.col("n_lines"),
        "bare_words": 100 * F.col("n_bare") > 50 * F.col("n_words"),
    }
    bits = [F.when(fails[name], F.lit(BIT[name])).otherwise(F.lit(0)) for name in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return m.withColumn("failed", failed.cast("bigint"))


def apply_policy(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """``base_failed`` and ``kept`` under a policy; the base rules reject under every policy."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return led.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)).withColumn("policy", F.lit(policy))


def ablation(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that fail it alone, and that would be kept
    without it. One pass: counts per distinct bit pattern, combined after."""
    mask = POLICIES[policy]
    patterns = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in RULES if BIT[r] & mask]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").alias("failed_bits"), (F.col("failed").bitwiseAND(F.lit(POLICIES["v2"])) == 0).alias("kept_v2"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 4) AS v FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5) x),
hit AS (SELECT DISTINCT r, i + k AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM win) y, (SELECT unnest([0, 1, 2, 3, 4]) AS k) z WHERE c > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, len(list_filter(list_zip(ws, ws[2:]), lambda x: x[1] = x[2])) AS n_stutter,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_capitals, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z'))) AS n_ellipses,
        len(list_filter(ls, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[-*\x{2022}\x{B7}\x{25AA}]'))) AS n_bullets, len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_bare,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 16 ELSE 0 END + CASE WHEN 100 * n_stutter > 30 * n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_ellipses > 30 * n_lines THEN 128 ELSE 0 END
        + CASE WHEN 100 * n_bullets > 90 * n_lines THEN 256 ELSE 0 END + CASE WHEN 100 * n_bare > 50 * n_words THEN 512 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 63 = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits, bits = 0 AS kept_v2 FROM f
"""
