"""Keyword search: query terms, scores and top-k as expressions over the chunk text.

The terms of a query given as a string are found once, in the driver, so its score is one plain expression a term over
the lowered text; a query given as a column (one for each row) is scored by array functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# What a term is, how often it counts, and what the whole phrase adds.
TERM = r"[A-Za-z0-9_]+|[一-鿿]+"
MOST_A_TERM, PHRASE_BONUS = 3, 5.0


def query_terms(query: Column) -> Column:
    """Distinct terms in the order of their first place; ASCII terms of one character are left out."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) | ~F.regexp_like(t, F.lit("^[A-Za-z0-9_]$"))))


def terms_of(query: str) -> list[str]:
    """The same for a query that is known."""
    return list(dict.fromkeys(t for t in re.findall(TERM, query) if len(t) >= 2 or not t.isascii()))


def occurrences(text: Column, term: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def _score_by_row(content: Column, query: Column) -> Column:
    def one(term: Column) -> Column:
        ascii_term = F.regexp_like(term, F.lit("^[A-Za-z0-9_]+$"))
        n = F.when(ascii_term, occurrences(F.lower(content), F.lower(term))).otherwise(occurrences(content, term))
        return F.least(F.lit(float(MOST_A_TERM)), n)

    q = T.strip(F.coalesce(query, F.lit("")))
    terms = F.aggregate(F.transform(query_terms(query), one), F.lit(0.0), lambda a, b: a + b)
    phrase = F.when((q != "") & F.contains(F.lower(content), F.lower(q)), PHRASE_BONUS).otherwise(0.0)
    return F.when(F.size(query_terms(query)) > 0, terms + phrase).otherwise(0.0)


def keyword_score(content: Column, query: Column | str) -> Column:
    """Sum over the terms of their places in the text, three at most each, and five for the whole query as a phrase.
    ASCII terms match in either case, others exactly."""
    if isinstance(query, Column):
        return _score_by_row(content, query)
    low, score = F.lower(content), F.lit(0.0)
    for t in terms_of(query):
        n = occurrences(low, F.lit(t.lower())) if t.isascii() else occurrences(content, F.lit(t))
        score = score + F.least(F.lit(float(MOST_A_TERM)), n)
    phrase = F.when(F.contains(low, F.lit(query.strip().lower())), PHRASE_BONUS).otherwise(0.0)
    return score + phrase if terms_of(query) else F.lit(0.0)


def has_term(content: Column, query: str) -> Column:
    """Whether any term of the query stands in the text, which is the same as a positive score."""
    low, found = F.lower(content), F.lit(False)
    for t in sorted(terms_of(query), key=len):
        found = found | (F.contains(low, F.lit(t.lower())) if t.isascii() else F.contains(content, F.lit(t)))
    return found


def scored(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks with a positive score. The filter names the terms and not the score, which so is made once a chunk."""
    return chunks.where(has_term(F.col("content"), query)).withColumn("score", keyword_score(F.col("content"), query))


def order() -> list:
    return [F.desc("score"), F.length("content"), F.desc("file_id"), F.desc("chunk_index")]


def keyword_search(chunks: DataFrame, query: str, k: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """The k best chunks: higher score, then shorter text, then the later key. `exclude` holds keys already found."""
    if exclude is not None:
        chunks = chunks.join(exclude.select("file_id", "chunk_index"), ["file_id", "chunk_index"], "left_anti")
    best = scored(chunks, query).orderBy(*order()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order())))
