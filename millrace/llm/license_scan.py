"""License scans by diagonal voting, with DataFrame operations only.

All rolling two-word grams of every text are hashed and joined to the gram positions of license templates. Matches of
one template on one offset diagonal (word position minus template position) vote together. Neighbouring diagonals, up
to MERGE_GAP words apart, merge into one place, so that inserted or missing words do not split it. A place is
verified: its share is the longest run of its matches that stand in the template's order, over the template's grams,
and as no two of its diagonals lie further apart than MERGE_GAP, it spans at most that many words more than the
template. Every gram is compared as text beside its hash. Templates may be of any length from two words on.

Short phrases (`base`) count wherever all their words stand consecutively. Null and empty texts have no words and no
label; equal rows give equal results and are returned as often as they come; an empty table gives an empty result;
columns of the input other than doc_id and text are not carried. Texts are known by doc_id and a 64-bit text hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words: texts are split there, as taking all matches of WORD costs many times as much.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
MERGE_GAP = 3
COPIES = 1 << 16


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Share of the template's grams that a place must hold.
    least: float = 0.8
    base: bool = False

    def grams(self) -> list[str]:
        words = self.text.split()
        return [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]


TEMPLATES = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
    Template("mit", "released under the mit license", 0.75),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software",
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", 1.0),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc0", "creative commons zero public domain dedication"),
)


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row a gram; a constant of the templates, a few hundred rows at most."""
    rows = [(n, i, g) for n, t in enumerate(templates) for i, g in enumerate(t.grams())]
    return spark.createDataFrame(rows, "template int, at int, t_gram string").withColumn("t_hash", F.xxhash64("t_gram"))


def in_order(hits: Column) -> Column:
    """Length of the longest run of (pos, -at) structs in which pos and at both grow."""

    def step(ends: Column, hit: Column) -> Column:
        # ends[i] is the least template position at which a run of i + 1 matches can end
        at = -hit["minus_at"]
        before = F.filter(ends, lambda e: e < at)
        return F.concat(before, F.array(at), F.slice(ends, F.size(before) + 2, F.size(ends)))

    # of matches at one word the latest template position comes first, so that they never follow each other
    return F.when(F.size(hits) < 2, F.size(hits)).otherwise(F.aggregate(F.array_sort(hits), F.array().cast("array<int>"), step, F.size))


def places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, text_hash, n_words, template, first diagonal of the place, whether that diagonal alone is complete, and
    the share of the template's grams in order there; and one row a text without template, whose `copies` counts its
    equal rows."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(common.ascii_lower(text), BETWEEN), "")
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words.alias("_words"))
    # the leading null stands for the text itself and matches no gram
    grams = F.concat(F.array(F.lit(None).cast("string")), F.transform("_words", lambda w, i: F.concat(w, F.lit(" "), F.get("_words", i + 1))))
    rolled = texts.select("doc_id", "text_hash", F.size("_words").cast("long").alias("n_words"), F.posexplode(grams).alias("pos", "gram"))
    table = F.broadcast(template_table(docs.sparkSession, templates))
    hits = rolled.join(table, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").where("template is not null or pos = 0")
    keys = ["doc_id", "text_hash", "n_words", "template"]
    diagonal = (F.col("pos") - 1 - F.col("at")).cast("long")
    votes = hits.groupBy(*keys, diagonal.alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.count_if(F.col("pos") == 0).alias("copies"))
    # equal rows are one by now; what follows groups by text
    merged = votes.repartition("doc_id", "text_hash").withColumn("near", F.collect_list(F.struct("diagonal", "ats")).over(Window.partitionBy(*keys).orderBy("diagonal").rangeBetween(0, MERGE_GAP)))
    matches = F.flatten(F.transform("near", lambda d: F.transform(d["ats"], lambda at: F.struct((d["diagonal"] + at).alias("pos"), (-at).alias("minus_at")))))
    size = F.get(F.array(*[F.lit(len(t.grams())) for t in templates]), F.col("template"))
    return merged.select(*keys, "diagonal", "copies", (F.size("ats") == size).alias("complete"), F.when(F.col("template").isNotNull(), in_order(matches) / size).alias("share"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, the base places' number, first and last start, base labels, all labels, and a score: the
    largest share of a template found in order (0 without any)."""
    labels = F.array(*[F.lit(t.label) for t in templates])
    least = F.array(*[F.lit(t.least) for t in templates])
    base = F.col("template").isin(*[i for i, t in enumerate(templates) if t.base])
    label = F.get(labels, F.col("template"))
    base_hit, hit = base & F.col("complete"), F.col("share") >= F.get(least, F.col("template"))
    joined = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, label))), ",")
    found = places(docs, templates).groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(base_hit).alias("n_base"),
        F.min(F.when(base_hit, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base_hit, F.col("diagonal"))).alias("last_word"),
        joined(base_hit).alias("base_labels"),
        joined(base_hit | (hit & ~base)).alias("labels"),
        F.round(F.coalesce(F.max(F.when(base_hit, 1.0).when(~base, F.col("share"))), F.lit(0.0)), 9).alias("score"),
        F.sum("copies").alias("copies"),
    )
    # equal rows come back in blocks of a bounded size
    blocks = found.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))))
    every = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("_block") * COPIES).cast("int"))))
    return every.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.documents(spark, sf_dir))


_ROWS = ", ".join(f"({n}, {i}, '{g}', {len(t.grams())}, '{t.label}', {t.least}, {str(t.base).lower()})" for n, t in enumerate(TEMPLATES) for i, g in enumerate(t.grams()))
#: States the rule by itself: all increasing runs of matches around every match, by recursion.
ORACLE = rf"""
WITH RECURSIVE tpl(template, "at", gram, size, label, least, base) AS (VALUES {_ROWS}),
w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{WORD}') AS words FROM documents),
g AS (SELECT rid, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT rid, words, unnest(range(1, len(words))) AS i FROM w)),
h AS MATERIALIZED (SELECT rid, template, pos, "at", pos - "at" AS d FROM g JOIN tpl USING (gram)),
-- a place starts at a match that no other precedes on its diagonals, and reaches {MERGE_GAP} diagonals on
p AS MATERIALIZED (SELECT DISTINCT rid, template, d AS low FROM h),
runs(rid, template, low, pos, "at", n) AS (
  SELECT p.rid, p.template, low, pos, "at", 1 FROM p JOIN h ON h.rid = p.rid AND h.template = p.template AND d BETWEEN low AND low + {MERGE_GAP}
  UNION
  SELECT r.rid, r.template, r.low, h.pos, h."at", r.n + 1 FROM runs r JOIN h ON h.rid = r.rid AND h.template = r.template
    AND h.d BETWEEN r.low AND r.low + {MERGE_GAP} AND h.pos > r.pos AND h."at" > r."at"),
s AS (SELECT rid, template, max(n) AS n FROM runs GROUP BY rid, template),
t AS (SELECT DISTINCT template, size, label, least, base FROM tpl),
b AS (SELECT rid, template, d FROM h JOIN t USING (template) WHERE base GROUP BY rid, template, d, size HAVING count(*) = size),
r AS (SELECT rid, max(n / size) AS score, list(DISTINCT label) FILTER (n / size >= least) AS own FROM s JOIN t USING (template) WHERE NOT base GROUP BY rid),
q AS (SELECT rid, count(*) AS n_base, min(d) AS first_word, max(d) AS last_word, list(DISTINCT label) AS own FROM b JOIN t USING (template) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(q.own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(q.own, r.own))), ','), '') AS labels,
       round(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END, 9)::DOUBLE AS score
FROM w LEFT JOIN r USING (rid) LEFT JOIN q USING (rid)
"""
