"""Line-first quality rules, in DataFrame functions only.

Lines that fail a punctuation, navigation or boilerplate rule are removed; a document that
loses too much of its text that way is rejected, as is one that fails the base rules.
Everything happens inside a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
# Share of the text's characters that must stay after line cleaning.
MIN_KEPT = 0.5
# Symbols and doubled exclamation marks in a line, by its characters.
MAX_SYMBOL_SHARE = 0.05
# A line of fewer words must end like a sentence.
FRAGMENT_WORDS = 3

# Phrases of boilerplate lines (fixed values).
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
    "use cookies", "click here", "sign up", "log in", "sign in", "subscribe to", "share this",
    "read more", "licensed under", "released under the", "lorem ipsum", "javascript is disabled",
)


def _lambda_free_words(text: Column) -> Column:
    """Words of a text without empty ones; none for an empty text."""
    trimmed = F.btrim(text, F.lit(BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def line_passes(line: Column) -> Column:
    """Whether one line survives: blank lines do, otherwise all three rules must hold."""
    bare = F.btrim(line, F.lit(BREAKS))
    size = F.length(bare)
    marks = F.regexp_count(bare, F.lit(SYMBOLS + "|!!"))
    shouted = (F.upper(bare) == bare) & (F.lower(bare) != bare) & (size > 20)
    fragment = ~bare.rlike(r"[.!?:;…。！？»”\"')]$") & (F.size(F.split(bare, WORD_BREAK)) < FRAGMENT_WORDS)
    punctuation = (marks <= MAX_SYMBOL_SHARE * size) & ~shouted & ~fragment
    # Menus: items held apart by bars, arrows or dots.
    navigation = F.regexp_count(bare, F.lit(r"\s[|»›·>/]\s")) * 25 > size
    boilerplate = F.lower(bare).rlike("|".join(BOILERPLATE)) & (size < 200)
    return (bare == "") | (punctuation & ~navigation & ~boilerplate)


def judge(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Add the statistics, the cleaned text and the verdict of every document.

    New columns, each with ``prefix`` before its name: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (bigint), base_failed, kept (boolean), clean_text.  A null text counts as
    empty: all counts 0, base_failed true, clean_text empty.  Existing columns of these names are
    replaced, all others and repeated rows stay.
    """
    own = [c for c in docs.columns if c not in {prefix + n for n in NAMES}]
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(*own, F.col("text").cast("string").alias("__text"))
    rows = rows.select(*own, text.alias("__text"), _lambda_free_words(text).alias("__words"),
                       F.split(text, "\n").alias("__lines"))
    rows = rows.withColumns({
        "__n": F.size("__words"),
        "__said": F.filter("__lines", lambda s: F.btrim(s, F.lit(BREAKS)) != ""),
        "__clean": F.array_join(F.filter("__lines", line_passes), "\n"),
    })
    rows = rows.withColumn(
        "__windows",
        F.when(F.col("__n") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.col("__n") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)]),
        )),
    )
    # Only texts that repeat a window sort their windows, to find the places of equal ones.
    rows = rows.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def same(k: Column, other: Column) -> Column:
        return F.coalesce(F.get(F.col("__sorted"), k)["h"] == F.get(F.col("__sorted"), other)["h"], F.lit(False))

    rows = rows.withColumn(
        "__places",
        F.sort_array(F.transform(
            F.filter("__sorted", lambda e, k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | same(k, k + 1)),
            lambda e: e["i"],
        )),
    )
    covered = F.aggregate(
        F.transform("__places", lambda at, k: F.when(
            k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), at - F.get(F.col("__places"), k - 1)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    rows = rows.select(
        *own, "__text", "__clean",
        F.col("__n").cast("long").alias(prefix + "n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias(prefix + "word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias(prefix + "n_symbols"),
        (F.size("__said") - F.size(F.array_distinct("__said"))).cast("long").alias(prefix + "n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias(prefix + "n_repeat_words"),
    )
    n, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    rows = rows.withColumn(prefix + "base_failed", (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n))
    stays = F.length("__clean") >= MIN_KEPT * F.length("__text")
    return rows.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & stays).withColumnRenamed(
        "__clean", prefix + "clean_text"
    ).drop("__text")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with: text cleaned, n_chars (if any) counted anew."""
    judged = judge(docs, "__q_")
    # A generator instead of a filter: a filter would be pushed below the projections and repeat their work.
    row = F.struct(*[
        F.col("__q_clean_text").alias(c) if c == "text"
        else F.length("__q_clean_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(c) for c in docs.columns
    ])
    return judged.select(F.inline(F.when(F.col("__q_kept"), F.array(row))))


def oracle_sql() -> str:
    """The judgement in plain SQL over ``documents``, by exploding words and windows."""
    phrases = "|".join(BOILERPLATE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT doc_id, string_split_regex(t, '[\x20\x09-\x0D]+') AS raw FROM d),
w1 AS (SELECT doc_id, list_filter(raw, lambda x: x <> '') AS ws FROM w0),
wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], chr(31)) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w1 WHERE len(ws) >= 5)
),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id
),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
b AS (SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM b WHERE bare <> '' GROUP BY doc_id),
pass AS (
  SELECT doc_id, k, line FROM b WHERE bare = '' OR NOT (
    len(regexp_extract_all(bare, '[#*$%&|<>]|!!')) > {MAX_SYMBOL_SHARE} * length(bare)
    OR (upper(bare) = bare AND lower(bare) <> bare AND length(bare) > 20)
    OR (NOT regexp_matches(bare, '[.!?:;…。！？»”"'')]$')
        AND len(string_split_regex(bare, '[\x20\x09-\x0D]+')) < {FRAGMENT_WORDS})
    OR len(regexp_extract_all(bare, '\s[|»›·>/]\s')) * 25 > length(bare)
    OR (regexp_matches(lower(bare), '{phrases}') AND length(bare) < 200))
),
kl AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS n FROM pass GROUP BY doc_id),
s AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(kl.n, 0) >= {MIN_KEPT} * length(t) AS stays
  FROM d JOIN w1 USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN kl USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND stays AS kept
FROM s"""
