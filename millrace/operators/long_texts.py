"""Chunking of documents too long for one task: a document as rows of blocks or lines that any task may take.

`windows` and `headings` give what `chunking.split_fixed` and `chunking.split_headings` give for the whole text. A document
comes as rows (doc, block, content) whose contents in the order of their blocks are its text; `blocks` makes such rows of
whole texts, and a reader of large files can make them at once. What goes through one task for a document is narrow: a
length a block, or its heading candidates; contents are joined by document and block, or grouped by chunk.

Null and empty documents have no block and no chunk of `windows`; `headings` needs a block, if an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking as C
from millrace.sources import shared

#: Code points of a block.
BLOCK = 1 << 16


def blocks(docs: DataFrame, doc: str, text: str = "text", size: int = BLOCK) -> DataFrame:
    """(doc, block, content) of whole texts, dealt evenly; all blocks but the last of a document have `size` code points."""
    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select(F.col(doc).alias("doc"), F.posexplode(cut).alias("block", "content")).repartition("doc", "block")


def windows(parts: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """doc, chunk_index and content of the fixed windows of documents given as blocks of at least `size` code points (the
    last may be shorter)."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")
    step = size - overlap
    saved = shared.saved(parts, "long-blocks")
    blank = lambda pattern: F.length(F.regexp_extract("content", f"(?U){pattern}", 0))
    # (length, blanks at either end) of every block: the narrow rows of a document
    sizes = saved.select("doc", "block", F.length("content").alias("n"), blank(rf"^{T.WS}+").alias("lead"), blank(rf"{T.WS}+\z").alias("trail"))
    before, whole = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc")
    placed = sizes.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    filled = F.col("lead") < F.col("n")
    ends = placed.withColumns({"first": F.min(F.when(filled, F.col("at") + F.col("lead"))).over(whole), "stop": F.max(F.when(filled, F.col("at") + F.col("n") - F.col("trail"))).over(whole)})
    heads = saved.where("block > 0").select("doc", (F.col("block") - 1).alias("block"), F.substring("content", 1, size).alias("next"))
    rows = saved.join(ends.where("first is not null").select("doc", "block", "n", "at", "first", "stop"), ["doc", "block"]).join(heads, ["doc", "block"], "left")
    # windows start every step from the first letter, the last where it meets the end
    last = F.greatest(F.ceil((F.col("stop") - F.col("first") - size) / step), F.lit(0))
    low = F.greatest(F.ceil((F.col("at") - F.col("first")) / step), F.lit(0))
    high = F.least(F.ceil((F.col("at") + F.col("n") - F.col("first")) / step) - 1, last)
    begin = lambda i: F.col("first") + i * step
    text = F.concat("content", F.coalesce("next", F.lit("")))
    window = lambda i: F.struct(i.cast("int").alias("chunk_index"), F.substring(text, (begin(i) - F.col("at") + 1).cast("int"), F.least(F.lit(size), F.col("stop") - begin(i)).cast("int")).alias("content"))
    made = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), window))
    return rows.select("doc", F.explode_outer(made).alias("w")).where("w is not null").select("doc", "w.*")


def lines(parts: DataFrame) -> DataFrame:
    """(doc, block, lines) of documents given as blocks of whole lines with their line ends; an empty block is an empty line."""
    found = T.split_lines(F.col("content"))
    return parts.select("doc", "block", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))).alias("lines"))


def line_blocks(docs: DataFrame, doc: str, text: str = "text", size: int = 4096) -> DataFrame:
    """(doc, block, content) of whole texts, `size` lines a block, each with a line feed."""
    held = docs.select(F.col(doc).alias("doc"), T.split_lines(F.col(text)).alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("lines") - 1, F.lit(0)) / size).cast("int")), lambda b: F.array_join(F.transform(F.slice("lines", b * size + 1, F.lit(size)), lambda x: F.concat(x, F.lit("\n"))), ""))
    return held.select("doc", F.posexplode(cut).alias("block", "content")).repartition("doc", "block")


def headings(rows: DataFrame) -> DataFrame:
    """doc, chunk_index, number, title, path and content of the heading chunks of documents given as lines (doc, block, lines).

    Candidates are found line by line; those of a document, in order, carry the state of its appendices. Every block is
    then cut at the headings that stand in it; what comes before them belongs to the last one of the blocks before, which
    is carried along a document's blocks without their lines. The pieces of a chunk are joined.
    """
    saved = shared.saved(rows, "long-lines")
    begins = saved.select("doc", "block", F.posexplode("lines").alias("i", "line")).where(T.like(F.col("line"), C.HEADING_START))
    found = begins.select("doc", "block", "i", C.heading_candidate(F.col("line"), F.col("i")).alias("c")).where("c is not null")
    # a candidate's place is its number in the document, so that lines need not be counted
    ordered = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("block", "i", "c"))).alias("found"))
    numbered = F.transform("found", lambda x, k: x["c"].withField("at", k))
    heads = ordered.select("doc", F.transform("found", lambda x: F.struct(x["block"].alias("block"), x["i"].alias("i"))).alias("places"), C.accepted_headings(numbered).alias("heads"))
    every = saved.groupBy("doc").agg(F.min("block").alias("start")).join(heads, "doc", "left").withColumn("heads", F.coalesce("heads", F.array().cast(f"array<{C.HEADING}>")))
    nothing: Column = F.array().cast("array<string>")
    chunks = every.select("doc", "start", "places", "heads", F.posexplode(C.heading_chunks(nothing, F.col("heads"))).alias("chunk_index", "chunk"))
    # without headings the whole document is one chunk, from its first line on
    place = F.get("places", F.get("heads", F.col("chunk_index"))["at"])
    begun = chunks.select("doc", "chunk_index", F.coalesce(place["block"], "start").alias("block"), F.coalesce(place["i"], F.lit(0)).alias("i"), "chunk.number", "chunk.title", "chunk.path")
    begun = shared.saved(begun, "long-heads")
    own = begun.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("i", "chunk_index"))).alias("starts"))
    before = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.get("starts", F.size("starts") - 1)["chunk_index"], ignorenulls=True).over(before)
    cuts = saved.select("doc", "block").join(own, ["doc", "block"], "left").select("doc", "block", "starts", carried.alias("carried"))
    first = F.filter(F.array(F.struct(F.lit(0).alias("i"), F.col("carried").alias("chunk_index"))), lambda x: x["chunk_index"].isNotNull() & ~F.coalesce(F.get("starts", 0)["i"] == 0, F.lit(False)))
    starts = F.concat(first, F.coalesce("starts", F.array().cast("array<struct<i:int,chunk_index:int>>")))
    met = saved.join(cuts, ["doc", "block"]).select("doc", "block", "lines", starts.alias("starts"))
    text = lambda x, k: F.array_join(F.slice("lines", x["i"] + 1, F.coalesce(F.get("starts", k + 1)["i"], F.size("lines")) - x["i"]), "\n")
    pieces = met.select("doc", "block", F.explode(F.transform("starts", lambda x, k: F.struct(x["chunk_index"].alias("chunk_index"), x["i"].alias("i"), text(x, k).alias("text")))).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "p.i", "p.text"))), lambda x: x["text"]), "\n")
    contents = pieces.groupBy("doc", F.col("p.chunk_index").alias("chunk_index")).agg(T.strip(joined).alias("content"))
    return begun.drop("block", "i").join(contents, ["doc", "chunk_index"], "left").withColumn("content", F.coalesce("content", F.lit("")))
