"""Secret scans behind a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived: an OR of clauses, each an AND of trigrams that
any match must hold in lower case. Postings (trigram, text) are made for the trigrams of these queries over all whole
texts, intersected clause by clause, and only candidate texts are matched against the rule. A rule without mandatory
trigrams (long hexadecimal runs) scans every text.

Null and empty texts have no span; equal rows give equal results and are returned as often as they come; spans of one
kind never overlap, spans of different kinds may; an empty table gives an empty result; columns of the input other
than doc_id and text are not carried by `scan_secrets` (`redact` keeps the input's own columns). Texts are known by
doc_id and a 64-bit text hash between the steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

_sre = re._parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1
    #: Group whose length `least` bounds.
    group: int = 0
    #: A cheap test without which no match can pass, for rules that scan every text.
    needs: str | None = None
    base: bool = False


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]+", 32, needs=r"[0-9a-f]{32}", base=True),
)
#: Kinds that the method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{16,}=*"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@[^\s]+"),
)
RULES = BASE_RULES + MORE_RULES
#: More alternatives than this make a rule's query no longer selective; the part that has them demands nothing.
ALTERNATIVES = 64


def _literals(tokens) -> list[list[str]]:
    """Alternatives, each the list of literal runs that a match holds in order (in lower case)."""
    found: list[list[str]] = [[""]]

    def append(options: list[list[str]]) -> None:
        nonlocal found
        joined = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(found, options)]
        found = joined if len(joined) <= ALTERNATIVES else [[*a, ""] for a in found]

    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            append([[chr(arg).lower()]])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            append([[c] for c in sorted({chr(v).lower() for _, v in arg})])
        elif name == "SUBPATTERN":
            append(_literals(arg[-1]))
        elif name == "BRANCH":
            append([x for branch in arg[1] for x in _literals(branch)])
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            append([[""], *_literals(arg[2])])
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            append([[*x, ""] for x in _literals(arg[2])])
        else:
            append([["", ""]])
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of AND-sets of lower-case trigrams; None if some match needs no trigram, so that texts are scanned fully."""
    clauses = {frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in _literals(_sre.parse(pattern))}
    if frozenset() in clauses:
        return None
    return [c for c in sorted(clauses, key=sorted) if not any(o < c for o in clauses)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, text_hash) for the given trigrams over all whole texts."""
    lowered = common.ascii_lower(F.col("text"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), t) for t in trigrams]))
    return keyed.select("doc_id", "text_hash", lowered.alias("_low")).select("doc_id", "text_hash", F.explode(present).alias("trigram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash and the kinds whose trigram query the text fulfils. The clause table is a constant of the
    rules, a few hundred rows, and so may be broadcast."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    rows = [(kind, n, t, len(c)) for kind, q in queries.items() if q for n, c in enumerate(q) for t in sorted(c)]
    if not rows:
        return keyed.select("doc_id", "text_hash", F.array(F.lit("")).alias("kinds")).where("false")
    clauses = keyed.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, needed int")
    index = postings(keyed, sorted({r[2] for r in rows}))
    met = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "text_hash", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = needed").groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


SPAN, PIECE = "struct<start:bigint,rank:int,end:bigint>", "struct<begin:bigint,end:bigint,rank:int>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) in code points of the leftmost non-overlapping matches that pass the rule."""
    sizes = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x).cast("bigint"))
    bound = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x).cast("bigint")) if rule.group else whole
    gaps = F.zip_with(F.slice(sizes, 1, F.size(whole)), F.arrays_zip(whole.alias("whole"), bound.alias("bound")), lambda g, m: F.struct(g.alias("gap"), m["whole"].alias("whole"), m["bound"].alias("bound")))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = at + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + m["whole"]).alias("end"))
        return begin + m["whole"], F.when(m["bound"] >= rule.least, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return common.scan(gaps, F.lit(0).cast("bigint"), step, SPAN)


def _named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, `keep` and spans: an array of (start, rank of the rule, end), ordered, for every row."""
    keyed = _keyed(docs)
    found = common.maybe_broadcast(common.saved(candidates(keyed, rules), "secret-candidates").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    parts = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            due = F.col("text").rlike(rule.needs or rule.pattern)
        else:
            due = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        parts.append(F.when(due, _spans(F.col("text"), rule, rank)).otherwise(none))
    return joined.select("doc_id", *keep, "text", F.sort_array(F.concat(*parts)).alias("spans"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the count of each base kind, the digest of all base spans and all spans as text, for every row."""
    base = [i for i, r in enumerate(rules) if r.base]
    spans = find_spans(docs, rules).select("doc_id", "spans", F.filter("spans", lambda s: s["rank"].isin(base)).alias("_base"))

    def count(i: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["rank"] == i)).cast("long").alias(f"n_{rules[i].kind}")

    return spans.select("doc_id", *map(count, base), F.sha2(_named(F.col("_base"), rules), 256).alias("base_sha256"), _named(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input with every span replaced by its kind in square brackets; overlapping spans become one. n_chars, where
    the input has it, follows the text; rows without a span are unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = find_spans(docs.select("doc_id", "text", row), rules, ("_row",))
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.struct(at.alias("begin"), s["start"].alias("end"), s["rank"].alias("rank"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(piece)).otherwise(F.array().cast(f"array<{PIECE}>"))

    def replaced(cut: common.Cut) -> Column:
        pieces = common.scan(F.col("spans"), F.lit(0).cast("bigint"), step, PIECE)
        shown = F.transform(pieces, lambda p: F.concat(cut.part(p["begin"], p["end"]), F.get(kinds, p["rank"])))
        end = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(shown, ""), cut.part(end, F.length("text").cast("bigint")))

    done = common.Cut.of(F.col("text"), replaced)
    new = F.when(F.size("spans") > 0, done).otherwise(F.col("_row.text"))
    made = found.select("_row", new.alias("_text"))
    columns = []
    for c in docs.columns:
        own = F.col(f"_row.`{c}`")
        columns.append(F.col("_text").alias(c) if c == "text" else F.when(F.col("_text") != F.col("_row.text"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(own).alias(c) if c == "n_chars" else own.alias(c))
    return made.select(*columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.documents(spark, sf_dir))


def _spans_sql(rule: Rule, rank: int) -> str:
    blank = r"\x20\x09-\x0D"  # what \s means to Spark
    pattern = rule.pattern.replace(r"[^\s]", f"[^{blank}]").replace(r"\s", blank).replace("'", "''")
    return (
        f"SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, {rule.least} AS least, n, "
        f"gaps[n] AS gap, length(found[n]) AS whole, length(bound[n]) AS bound FROM (SELECT rid, unnest(range(1, len(found) + 1)) AS n, gaps, found, bound FROM ("
        f"SELECT rid, list_transform(regexp_split_to_array(text, '{pattern}'), lambda x: length(x)) AS gaps, regexp_extract_all(text, '{pattern}') AS found, "
        f"regexp_extract_all(text, '{pattern}', {rule.group}) AS bound FROM t))"
    )


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(_spans_sql(r, i) for i, r in enumerate(RULES))}),
s AS (SELECT *, sum(gap + whole) OVER (PARTITION BY rid, rank ORDER BY n) AS stop FROM m),
k AS (SELECT rid, rank, kind, base, stop - whole AS start, kind || ':' || (stop - whole)::BIGINT || ':' || stop::BIGINT AS shown FROM s WHERE bound >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(shown, ',' ORDER BY start, rank) FILTER (base) AS base, string_agg(shown, ',' ORDER BY start, rank) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rid)
"""
