"""Mixing sources to target weights, with DataFrame operations only.

Every document draws an exponential key divided by its quality weight (Efraimidis-Spirakis); within its source the
smallest keys come first and their sizes are summed up to the source's token budget. A source whose target exceeds
its size is first taken whole, epoch by epoch; only the rest is selected. The document at which the budget ends is
taken up to the word that meets it.

The running sum needs no ordered pass over a source: keys fall into ranges of their logarithm (none holds a hundredth
of a source), whose sums show in which range the budget ends; that range is split into PARTS, and only the part in
which the budget ends is ordered. Keys come from an MD5 hash of doc_id and text, so reruns agree.

Null text has size 0 and is never taken; null sources are one source, last; a source of size 0 has target 0; equal
rows have equal keys and are taken one after another; an empty table gives an empty result. One row a source is kept
in one ordered window and joined by broadcast only up to a checked count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
#: Ranges to a doubling of the key, and parts of the range in which a budget ends.
RANGES, PARTS = 64, 2048


def identity_hash(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))


def exponential_key(identity: Column, quality: Column) -> Column:
    u = (F.conv(F.substring(identity, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def text_quality(text: Column, size: Column) -> Column:
    """1 for prose, falling with the symbols a word holds; between 0 and 1, never 0."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return 1 / (1 + F.coalesce(F.try_divide(symbols, size), F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target: `share` of all sizes by repeating weights, no target above most_epochs times
    its source. Sharing the excess out again until none is above ends at one level: the largest of the levels that
    arise when sources are filled up in the order of their cap per weight."""
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    caps = ranked.withColumn("cap", F.col("source_size") * most_epochs).withColumn("fill", F.col("cap") / F.col("weight"))
    filled = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    levels = caps.withColumn("level", (total - filled) / left)
    level = F.max("level").over(Window.partitionBy())
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken words, whole epochs and part words for every row, and `keep`."""
    with common.scratch(docs.sparkSession):
        text = F.coalesce("text", F.lit(""))
        sized = docs.select("doc_id", "source", *keep, text.alias("_text"), common.word_count(F.col("text")).alias("size"))
        identity, quality = identity_hash(F.col("doc_id"), F.col("_text"), seed), text_quality(F.col("_text"), F.col("size"))
        keyed = sized.select("doc_id", "source", *keep, "size", identity.alias("tie"), quality.alias("_quality"))
        keyed = keyed.withColumn("key", exponential_key(F.col("tie"), F.col("_quality"))).drop("_quality")
        place = F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * (RANGES * PARTS)).cast("long")
        rows = common.saved(keyed.withColumn("place", place), "mix-keys", lasting=True)
        ranged = F.floor(F.col("place") / PARTS).cast("int")
        sums = common.saved(rows.groupBy("source", ranged.alias("slot")).agg(F.sum("size").alias("words")), "mix-sums")
        targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_epochs)
        epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
        budgets = targets.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        plan = common.saved(_cut(budgets.withColumn("before", F.lit(0).cast("long")), sums), "mix-plan")
        within = rows.join(common.maybe_broadcast(plan.select(F.col("source").alias("_source"), "slot")), F.col("source").eqNullSafe(F.col("_source")) & (ranged == F.col("slot")))
        parts = common.saved(within.groupBy("source", F.col("place").alias("slot")).agg(F.sum("size").alias("words")), "mix-parts")
        plan = common.saved(_cut(plan.drop("slot"), parts), "mix-plan", lasting=True).withColumnsRenamed({"source": "_source", "slot": "cut"})
        planned = rows.join(common.maybe_broadcast(plan), F.col("source").eqNullSafe(F.col("_source")))
    inside = Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_cut = planned.where("place = cut").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("budget") - earlier)))
    # without a cut the whole source is taken
    others = planned.where("cut is null or place <> cut").withColumn("part", F.when(F.coalesce(F.col("place") < F.col("cut"), F.lit(True)), F.col("size")).otherwise(0))
    both = others.unionByName(at_cut)
    return both.select("doc_id", *keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", F.col("part").cast("long").alias("part"))


def _cut(budgets: DataFrame, sums: DataFrame) -> DataFrame:
    """The rows of budgets with the slot of their source in which the budget ends (null: none does) and the words
    `before` it, for (source, slot, words) sums that begin after the budgets' own `before` words."""
    named = sums.withColumnRenamed("source", "_source").join(budgets, F.col("_source").eqNullSafe(F.col("source")))
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    running = named.withColumn("_at", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    ends = running.where(F.col("_at") + F.col("words") > F.col("budget")).groupBy("source").agg(F.min(F.struct("slot", "_at")).alias("_end"))
    joined = budgets.join(ends.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("source", "source_size", "target", "epochs", "budget", F.col("_end.slot").cast("long").alias("slot"), F.coalesce("_end._at", "before").alias("before"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of the input: a document once for each whole time it is taken, and the one at
    which its source's budget ends once more, cut after its last word taken (n_chars follows)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    mixed = mix(docs.select("doc_id", "source", "text", row), keep=("_row",), **options)
    whole = F.col("epochs") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part"))
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), F.when(F.col("size") > 0, whole).otherwise(0).cast("int")), F.when(cut.isNotNull(), F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    taken = mixed.where("taken > 0").select("_row", F.explode(copies).alias("_words"))
    pieces = F.split(F.col("_row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_words").isNull(), F.col("_row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.coalesce("_words", F.lit(0)).cast("int")), ""))
    columns = [
        text.alias(c) if c == "text"
        else F.when(F.col("_words").isNull(), F.col("_row.n_chars")).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
        else F.col(f"_row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return taken.select(*columns)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
                  len(regexp_extract_all(coalesce(text, ''), '{common.BLANK_WORD}'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || text) AS tie,
             1 / (1 + coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / nullif(size, 0), 0)) AS quality FROM t),
y AS (SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE) / quality AS "key" FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM t GROUP BY source),
c AS (SELECT *, source_size * {MOST_EPOCHS} AS cap, (source_size * {MOST_EPOCHS})::DOUBLE / weight AS fill, sum(source_size) OVER () * {SHARE}::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
g AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM g),
r AS (SELECT doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY y.source ORDER BY "key", tie, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
      FROM y JOIN b ON y.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - earlier)))::BIGINT AS taken,
       epochs, greatest(0, least(size, budget - earlier))::BIGINT AS part FROM r
"""
