"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Each rule bounds one ratio of a text; a text is kept if the base rules pass and every rule's ratio lies within its
bounds. Null and empty texts have zero counts and fail the base rule; ratios without a denominator count as passed.
Rows repeat as they come, an empty table gives an empty result, and columns of the input other than doc_id and text
are not carried by `quality_measures` (`keep_quality` returns the input's own columns only). Three-word windows are
compared by a 64-bit hash within their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

SYMBOLS = "#*$%&|<>"
#: Common words of the languages that the rules know; a text in another language passes by no stop word.
STOP_WORDS = {
    "en": "the of and to in is that with for was by on be this are have it as",
    "de": "der die und das den von mit ist in zu ein im dem des nicht auf sich eine",
    "fr": "le la de et les des un une est que en pour dans qui du au par pas",
    "es": "el la de los que y en un una las del se por con para es al no",
}


@dataclass(frozen=True)
class Rule:
    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / n_words", most=0.1),
    Rule("shouts_per_word", "n_shouts / n_words", most=0.3),
    Rule("stop_word_share", "n_stop_words / n_words", least=0.02),
    Rule("repeated_line_share", "n_dup_lines / n_lines", most=0.5),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(grams: str) -> Column:
    """Positions of words inside three-word windows whose hash stands twice or more."""
    ordered = F.sort_array(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    # one-element arrays stand for local names: each inner expression is made once
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(once(once(ordered, covered), total))


def quality_measures(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = (), stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """doc_id, the base measures, the rules' ratios, base_failed and kept; `keep` names further input columns. A corpus
    in other languages needs their stop words, or rules without the share of stop words."""
    stop = sorted({w for words in stop_words.values() for w in words.split()})
    text, zero = F.col("_text"), F.lit(0)
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    split = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text")).select(
        "doc_id",
        *keep,
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(text, "!").cast("long").alias("n_shouts"),
        lines.alias("_lines"),
        common.words_of(text).alias("_words"),
    )
    n = F.size("_words")
    grams = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id",
        *keep,
        "word_chars",
        "n_symbols",
        "n_shouts",
        n.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stop_words"),
        grams.alias("_grams"),
    )
    measured = counted.withColumn("n_repeat_words", _repeat_words("_grams").cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        over, under = rule.ratio.split(" / ")
        ratio = F.try_divide(F.col(over), F.col(under))
        for bound, passes in ((rule.least, ratio.__ge__), (rule.most, ratio.__le__)):
            if bound is not None:
                verdict = verdict & F.coalesce(passes(F.lit(bound)), F.lit(True))
    # always true, but not deterministic: a filter on the verdict stays above this projection instead of being moved
    # down and evaluating all measures again, once for each word
    here = F.monotonically_increasing_id() >= 0
    return measured.select("doc_id", *keep, *MEASURES, failed.alias("base_failed"), (here & ~failed & verdict).alias("kept"), "n_stop_words", "n_shouts", "n_lines")


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = quality_measures(docs.select("doc_id", "text", row), rules, ("_row",), stop_words).where("kept")
    return kept.select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(common.documents(spark, sf_dir)).select("doc_id", *MEASURES, "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
_RULE_SQL = " AND ".join(
    f"coalesce({r.ratio.replace(' / ', '::DOUBLE / nullif(')}, 0) {op} {bound}::DOUBLE, true)"
    for r in RULES
    for op, bound in ((">=", r.least), ("<=", r.most))
    if bound is not None
)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM s)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT s.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts, len(lines) AS n_lines,
             len(list_filter(words, lambda w: lower(w) IN ({_STOP_SQL}))) AS n_stop_words
      FROM s LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_RULE_SQL} AS kept FROM f
"""
