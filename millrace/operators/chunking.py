"""Chunking: one document row to its chunks, by expressions over the row's own lines.

Nothing here shuffles: a document's lines, headings and chunks are arrays of its row, so plans stay one scan however
many documents there are, and a document's memory is its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

WS = T.WS
HEADING = "struct<at:int,number:string,title:string>"
#: Starts of table parts that are gathered in one array.
STARTS = 256


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once: the argument of a lambda is a local name."""
    return F.get(F.transform(F.array(value), use), 0)


def fixed_windows(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Array of windows of `size` code points that start every size - overlap, up to the first that meets the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")
    step = size - overlap
    met = -(-size // step)  # blocks that a window meets
    s = T.strip(F.coalesce(text, F.lit("")))

    def windows(s: Column, n: Column) -> Column:
        # one pass cuts the text into blocks of a step, as a substring would walk from its start for every window
        last = F.when(n > size, F.ceil((n - size) / step)).otherwise(0).cast("int")
        joined = lambda blocks: lambda block, i: F.substring(F.array_join(F.slice(blocks, i + 1, F.lit(met)), ""), 1, size)
        cut = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        return once(cut, lambda blocks: F.transform(F.slice(blocks, F.lit(1), last + 1), joined(blocks)))

    return once(s, lambda s: once(F.length(s), lambda n: windows(s, n)))


# -- tables of contents ------------------------------------------------------------------------------------------


def toc_bounds(lines: Column, probe: int = 5000, noise: int = 80, other: int = 20) -> Column:
    """struct(first, stop, title) of the line range of a table of contents, or null.

    It starts at the first title line, else at the first entry, within `probe` lines; after it, noise and other lines
    may stand between entries up to their streak limits; it stops after its last entry and has three lines at least.
    """
    head = F.slice(lines, 1, probe)
    titled = F.get(F.filter(F.transform(head, lambda x, i: F.when(T.is_toc_title(x), i)), lambda i: i.isNotNull()), 0)
    entry = F.get(F.filter(F.transform(head, lambda x, i: F.when(T.is_toc_line(x), i)), lambda i: i.isNotNull()), 0)

    def scan(first: Column) -> Column:
        rest = F.transform(F.slice(lines, first + 2, F.greatest(F.size(lines) - first - 1, F.lit(0))), lambda x: F.when(T.is_toc_line(x), 1).when(T.is_toc_noise(x), 2).otherwise(3))
        begin = F.struct(first.alias("at"), F.lit(0).alias("n"), first.alias("last"), F.lit(False).alias("done"))

        def step(acc: Column, kind: Column) -> Column:
            at = acc["at"] + 1
            streak = at - acc["last"]
            stops = ((kind == 3) & ((acc["n"] < 3) | (streak > other))) | ((kind == 2) & (acc["n"] >= 3) & (streak > noise))
            done = acc["done"] | stops
            hit = ~done & (kind == 1)
            return F.struct(at.alias("at"), (acc["n"] + hit.cast("int")).alias("n"), F.when(hit, at).otherwise(acc["last"]).alias("last"), done.alias("done"))

        stop = F.aggregate(rest, begin, step, lambda acc: acc["last"] + 1)
        title = F.when(titled.isNotNull(), T.strip(F.get(lines, titled))).otherwise("Table of Contents")
        found = F.struct(first.alias("first"), stop.alias("stop"), title.alias("title"))
        return F.when((first + 1 < F.size(lines)) & (stop - first >= 3), found)

    return once(F.coalesce(titled, entry), lambda first: F.when(first.isNotNull(), scan(first)))


def toc_text(lines: Column, bounds: Column) -> Column:
    """Content of the chunk of a table of contents: its title and entry lines without five-dot leaders."""
    own = F.slice(lines, bounds["first"] + 1, bounds["stop"] - bounds["first"])
    kept = F.filter(own, lambda x: (T.strip(x) != "") & (T.is_toc_title(x) | T.is_toc_line(x)))
    return T.strip(F.replace(F.array_join(kept, "\n"), F.lit("....."), F.lit("")))


def without_range(lines: Column, bounds: Column) -> Column:
    return F.filter(lines, lambda x, i: bounds.isNull() | (i < bounds["first"]) | (i >= bounds["stop"]))


# -- headings ----------------------------------------------------------------------------------------------------

# The three kinds of heading lines, and the titles that are none.
NUMBERED = rf"^{WS}*(\d+(?:\.\d+)*)(?:{WS}+|{WS}*[-–]{WS}*)(.+?){WS}*\z"
APPENDIX = rf"^{WS}*[Aa][Pp][Pp][Ee][Nn][Dd][Ii][Xx]{WS}+(\d+|[A-Za-z])(?:\.|-|{WS})+(.+?){WS}*\z"
LETTER = rf"^{WS}*([A-Za-z])(?:\.|-|{WS})+(.+?){WS}*\z"
CONTENTS = ("contents", "table of contents", "目录")
#: What every heading line of any kind begins with, after its marks: most lines need no other test.
HEADING_START = rf"^(?:{WS}|[#*_])*(?:\d|[A-Za-z](?:[.-]|{WS})|[Aa][Pp][Pp][Ee][Nn][Dd][Ii][Xx]{WS})"
#: Headings of one block of the fold over a document.
HEADINGS = 256


def bare_line(line: Column) -> Column:
    """A line without one markdown heading prefix and one emphasis mark at either end."""
    s = T.sub(F.coalesce(line, F.lit("")), rf"^{WS}*#{{1,6}}{WS}*")
    return T.sub(T.sub(s, rf"^{WS}*(?:\*\*|\*|_){WS}*"), rf"{WS}*(?:\*\*|\*|_){WS}*\z")


def heading_candidate(line: Column, at: Column) -> Column:
    """struct(at, kind, number, title) of a line that may be a heading, else null; kind `a` opens an appendix."""

    def classify(s: Column) -> Column:
        made = lambda kind, number, title: F.struct(at.alias("at"), F.lit(kind).alias("kind"), number.alias("number"), T.strip(title).alias("title"))
        contents = lambda title: T.normalize_title(title).isin(*CONTENTS)
        appendix = made("a", F.concat(F.lit("Appendix "), F.upper(T.group(s, APPENDIX, 1))), T.group(s, APPENDIX, 2))
        letter = made("a", F.upper(T.group(s, LETTER, 1)), T.group(s, LETTER, 2))
        numbered = made("n", T.group(s, NUMBERED, 1), T.group(s, NUMBERED, 2))
        listed = F.lower(T.strip(T.group(s, NUMBERED, 2))).isin(*CONTENTS)
        entry = T.like(s, rf"\b\d{{1,5}}{WS}*\z") & T.like(s, r"[.·-]{3,}")
        return (
            F.when(T.like(s, APPENDIX), F.when(~contents(T.group(s, APPENDIX, 2)), appendix))
            .when(T.like(s, LETTER), F.when(~contents(T.group(s, LETTER, 2)), letter))
            .when(T.like(s, NUMBERED) & ~listed & ~entry, numbered)
        )

    return F.when(T.like(F.coalesce(line, F.lit("")), HEADING_START), once(bare_line(line), classify))


def plausible_next(last: Column, cur: Column) -> Column:
    """Whether a number may follow inside an appendix: the next sibling, a first child, or the next at a higher level."""
    n, m = F.size(last), F.size(cur)
    bumped = lambda k: (F.slice(cur, F.lit(1), m - 1) == F.slice(last, F.lit(1), m - 1)) & (F.try_element_at(cur, F.lit(-1)) - 1 == F.get(last, k - 1))
    child = (m == n + 1) & (F.slice(cur, F.lit(1), n) == last) & (F.try_element_at(cur, F.lit(-1)) == 1)
    return F.when(last.isNull(), F.get(cur, 0) == 1).when(m <= n, bumped(m)).otherwise(child)


def headings(lines: Column) -> Column:
    """Array of (at, number, title): candidates in order, those inside an appendix only where they go on plausibly."""
    return accepted_headings(F.filter(F.transform(lines, heading_candidate), lambda c: c.isNotNull()))


def accepted_headings(found: Column) -> Column:
    """The same from the candidates of all lines."""
    none = F.array().cast(f"array<{HEADING}>")
    state = lambda appendix, last, heads: F.struct(appendix.alias("appendix"), last.alias("last"), heads.alias("heads"))

    def step(acc: Column, c: Column) -> Column:
        inside, cur = acc["appendix"].isNotNull(), T.number_segments(c["number"])
        follows = ~inside | F.coalesce(~T.looks_like_table_row(c["title"]) & plausible_next(acc["last"], cur), F.lit(False))
        opens = c["kind"] == "a"
        number = F.when(opens | ~inside, c["number"]).otherwise(F.concat_ws(".", acc["appendix"], c["number"]))
        head = F.struct(c["at"].alias("at"), number.alias("number"), c["title"].alias("title"))
        heads = F.when(opens | follows, F.concat(acc["heads"], F.array(head))).otherwise(acc["heads"])
        last = F.when(opens, F.lit(None)).when(inside & follows, cur).otherwise(acc["last"])
        return state(F.when(opens, c["number"]).otherwise(acc["appendix"]), last, heads)

    def fold(found: Column) -> Column:
        # block by block, as an array that grew with every heading would be copied each time
        def block(acc: Column, b: Column) -> Column:
            own = F.aggregate(F.slice(found, b * HEADINGS + 1, F.lit(HEADINGS)), state(acc["appendix"], acc["last"], none), step)
            return once(own, lambda own: state(own["appendix"], own["last"], F.concat(acc["heads"], F.array(own["heads"]))))

        blocks = F.sequence(F.lit(0), F.floor(F.size(found) / HEADINGS).cast("int"))
        begin = state(F.lit(None).cast("string"), F.lit(None).cast("array<bigint>"), F.array().cast(f"array<array<{HEADING}>>"))
        return F.flatten(F.aggregate(blocks, begin, block)["heads"])

    return once(found, fold)


def allowed_heading(line: Column, at: Column, allowed: list[tuple[str, str]]) -> Column:
    """struct(at, number, title) of the first allowed (number, title) that a line names, else null."""

    def match(s: Column) -> Column:
        out = F.lit(None).cast(HEADING)
        for number, title in reversed([(n.strip(), t) for n, t in allowed if n.strip()]):
            quoted = "\\Q" + number.replace("\\E", "") + "\\E"
            named = T.like(s, rf"(?i)\b{quoted}\b") & F.contains(T.normalize_title(s), T.normalize_title(F.lit(title)))
            out = F.when(named, F.struct(at.alias("at"), F.lit(number).alias("number"), F.lit(title).alias("title"))).otherwise(out)
        return out

    return once(T.sub(T.sub(F.coalesce(line, F.lit("")), rf"^{WS}*#{{1,6}}{WS}*"), r"[*_]+"), match)


def distinct_headings(found: Column) -> Column:
    """Array of (number, title) without blank titles and without what repeats the number and the normalised title of an
    earlier one."""
    clean = F.filter(F.transform(found, lambda h: F.struct(T.strip(F.coalesce(h["number"], F.lit(""))).alias("number"), T.strip(F.coalesce(h["title"], F.lit(""))).alias("title"))), lambda h: h["title"] != "")
    key = lambda h: F.concat_ws("\0", h["number"], T.normalize_title(h["title"]))
    return once(clean, lambda hs: once(F.transform(hs, key), lambda keys: F.filter(hs, lambda h, i: F.array_position(keys, key(h)) == i + 1)))


def model_headings(answer: Column) -> Column:
    """Headings of a table of contents from a model's answer, as distinct_headings gives them; none if it can't be read."""
    return distinct_headings(F.coalesce(F.from_json(T.json_array_text(F.coalesce(answer, F.lit(""))), "array<struct<number:string,title:string>>"), F.array().cast("array<struct<number:string,title:string>>")))


def heading_chunks(lines: Column, heads: Column, keep_preamble: bool = False) -> Column:
    """Array of (number, title, path, content): each heading's lines up to the next; without headings the whole text.
    What stands before the first heading is left out unless keep_preamble."""
    path_type = "array<struct<number:string,title:string>>"
    chunk = lambda number, title, path, content: F.struct(number.alias("number"), title.alias("title"), path.alias("path"), T.strip(F.array_join(content, "\n")).alias("content"))
    empty = F.array().cast(path_type)

    def cut(heads: Column) -> Column:
        def path(h: Column) -> Column:
            segments = F.split(h["number"], r"\.")

            def prefix(j: Column) -> Column:
                key = F.array_join(F.slice(segments, F.lit(1), j), ".")
                named = F.try_element_at(F.filter(heads, lambda x: x["number"] == key), F.lit(-1))
                return F.struct(key.alias("number"), named["title"].alias("title"))

            return F.filter(F.transform(F.sequence(F.lit(1), F.size(segments)), prefix), lambda p: p["title"].isNotNull())

        def one(h: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
            return chunk(h["number"], h["title"], path(h), F.slice(lines, h["at"] + 1, F.greatest(stop - h["at"], F.lit(0))))

        made = F.transform(heads, one)
        if keep_preamble:
            before = chunk(F.lit(""), F.lit(""), empty, F.slice(lines, F.lit(1), F.get(heads, 0)["at"]))
            made = F.when(F.get(heads, 0)["at"] > 0, F.concat(F.array(before), made)).otherwise(made)
        return F.when(F.size(heads) > 0, made).otherwise(F.array(chunk(F.lit(""), F.lit(""), empty, lines)))

    return once(heads, cut)


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lines", T.split_lines(F.col(text)))


def split_headings(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, chunk_index, number, title, path and content of every heading chunk."""
    lined = with_lines(docs.select(*keys, text), text).select(*keys, "lines", headings(F.col("lines")).alias("heads"))
    return _exploded(lined.select(*keys, heading_chunks(F.col("lines"), F.col("heads")).alias("chunks")), keys)


def split_adaptive(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """As split_headings, with a table of contents as the first chunk (type `toc`) and the rest split without it."""
    lined = with_lines(docs.select(*keys, text), text).select(*keys, "lines", toc_bounds(F.col("lines")).alias("toc"))
    body = lined.select(*keys, "lines", "toc", without_range(F.col("lines"), F.col("toc")).alias("body"))
    headed = body.select(*keys, "lines", "toc", "body", headings(F.col("body")).alias("heads"))
    made = headed.select(*keys, "lines", "toc", heading_chunks(F.col("body"), F.col("heads")).alias("chunks"))
    typed = F.transform("chunks", lambda c: c.withField("type", F.lit(None).cast("string")))
    path = F.array().cast("array<struct<number:string,title:string>>")
    first = F.struct(F.lit("").alias("number"), F.col("toc.title").alias("title"), path.alias("path"), toc_text(F.col("lines"), F.col("toc")).alias("content"), F.lit("toc").alias("type"))
    return _exploded(made.select(*keys, F.when(F.col("toc").isNull(), typed).otherwise(F.concat(F.array(first), typed)).alias("chunks")), keys)


def split_fixed(docs: DataFrame, keys: list[str], text: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    return _positions(docs.select(*keys, fixed_windows(F.col(text), size, overlap).alias("chunks")), keys, "content")


def split_document(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, chunk_index, type, number, title and content: adaptive chunks where the first is a table of contents or
    has a number, else fixed windows."""
    lined = with_lines(docs.select(*keys, text), text).select(*keys, text, "lines", toc_bounds(F.col("lines")).alias("toc"))
    body = lined.select(*keys, text, "lines", "toc", without_range(F.col("lines"), F.col("toc")).alias("body"))
    headed = body.select(*keys, text, "lines", "toc", "body", headings(F.col("body")).alias("heads"))
    shape = lambda kind, number, title, content: F.struct(kind.alias("type"), number.alias("number"), title.alias("title"), content.alias("content"))
    chunks = F.transform(heading_chunks(F.col("body"), F.col("heads")), lambda c: shape(F.lit("heading"), c["number"], c["title"], c["content"]))
    toc = shape(F.lit("toc"), F.lit(""), F.col("toc.title"), toc_text(F.col("lines"), F.col("toc")))
    plain = F.transform(fixed_windows(F.col(text)), lambda w: shape(F.lit("fixed"), F.lit(""), F.lit(""), w))
    chosen = F.when(F.col("toc").isNotNull(), F.concat(F.array(toc), chunks)).when(F.size("heads") > 0, chunks).otherwise(plain)
    return _exploded(headed.select(*keys, chosen.alias("chunks")), keys)


def _exploded(chunked: DataFrame, keys: list[str]) -> DataFrame:
    return _positions(chunked, keys, "chunk").select(*keys, "chunk_index", "chunk.*")


def _positions(chunked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, chunk_index and each element of `chunks`. The outer form keeps the optimizer from filtering on the size of
    the array further down, where it would make lines and headings again for every element."""
    return chunked.select(*keys, F.posexplode_outer("chunks").alias("chunk_index", name)).where("chunk_index is not null")


# -- tables ------------------------------------------------------------------------------------------------------


def render_row(cells: Column, width: Column) -> Column:
    """A markdown table row of `width` cells; short rows are filled with empty ones."""
    filled = F.transform(F.sequence(F.lit(0), width - 1), lambda i: T.cell_text(F.get(cells, i)))
    return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))


def render_table(rows: Column) -> Column:
    """Markdown lines of an array of cell arrays: the first is the header."""

    def render(width: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        made = F.transform(rows, lambda r: render_row(r, width))
        return F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, F.lit(2), F.greatest(F.size(made) - 1, F.lit(0))))

    return once(F.array_max(F.transform(rows, lambda r: F.size(r))), render)


def sheet_blocks(lines: Column) -> Column:
    """Array of (sheet, lines) of a workbook's text: `[Sheet] name` opens a block; lines before the first go."""
    marks = F.filter(F.transform(lines, lambda x, i: F.when(T.like(x, rf"^\[Sheet\]{WS}*\S"), F.struct(i.alias("at"), T.strip(T.sub(x, r"^\[Sheet\]")).alias("name")))), lambda m: m.isNotNull())

    def cut(marks: Column) -> Column:
        def block(m: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(marks, k + 1)["at"], F.size(lines))
            return F.struct(m["name"].alias("sheet"), F.slice(lines, m["at"] + 2, stop - m["at"] - 1).alias("lines"))

        return F.filter(F.transform(marks, block), lambda b: F.exists(b["lines"], lambda x: T.strip(x) != ""))

    return once(marks, cut)


def table_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, T.strip), lambda x: x.startswith("|"))


def table_header(line: Column) -> Column:
    cells = F.split(T.sub(T.strip(line), r"^\|+|\|+\z"), r"\|")
    return F.filter(F.transform(cells, T.strip), lambda c: c != "")


def table_parts(lines: Column, max_rows: int = 200, max_chars: int = 8000) -> Column:
    """Array of parts, each an array of table lines that begins with header and rule (the first two lines).

    Rows are packed greedily: a part is closed after max_rows rows; a row that brings a part to max_chars opens the
    next one unless it is the part's first; a table without rows is one part.
    """
    max_rows, max_chars = max_rows if max_rows > 0 else 50, max_chars if max_chars > 0 else 6000

    def pack(head: Column, body: Column) -> Column:
        return once(F.length(F.array_join(head, "\n")), lambda base: once(_part_starts(body, base, max_rows, max_chars), lambda starts: F.transform(starts, lambda x, k: F.concat(head, F.slice(body, x + 1, F.coalesce(F.get(starts, k + 1), F.size(body)) - x)))))

    # bound once: what stands in a lambda is evaluated for each of its elements
    return once(F.slice(lines, 1, 2), lambda head: once(F.slice(lines, F.size(head) + 1, F.greatest(F.size(lines) - F.size(head), F.lit(0))), lambda body: pack(head, body)))


def _part_starts(body: Column, base: Column, max_rows: int, max_chars: int) -> Column:
    """Where the parts of the rows `body` begin, under a head of `base` characters. Starts are gathered in blocks, as adding
    to an array copies it."""
    begin = F.struct(F.lit(0).alias("rows"), base.alias("chars"), F.array(F.lit(0)).alias("starts"), F.array().cast("array<array<int>>").alias("blocks"), F.lit(0).alias("at"))

    def step(acc: Column, size: Column) -> Column:
        at, rows, chars = acc["at"] + 1, acc["rows"] + 1, acc["chars"] + 1 + size
        by_rows, by_chars = rows >= max_rows, (chars >= max_chars) & (acc["rows"] > 0)
        new, full = F.when(by_rows, at).when(by_chars, acc["at"]), F.size(acc["starts"]) >= STARTS
        starts = F.when(~by_rows & ~by_chars, acc["starts"]).when(full, F.array(new)).otherwise(F.concat(acc["starts"], F.array(new)))
        blocks = F.when((by_rows | by_chars) & full, F.concat(acc["blocks"], F.array(acc["starts"]))).otherwise(acc["blocks"])
        kept_rows = F.when(by_rows, 0).when(by_chars, 1).otherwise(rows)
        kept_chars = F.when(by_rows, base).when(by_chars, base + 1 + size).otherwise(chars)
        return F.struct(kept_rows.alias("rows"), kept_chars.alias("chars"), starts.alias("starts"), blocks.alias("blocks"), at.alias("at"))

    every = lambda acc: F.filter(F.flatten(F.concat(acc["blocks"], F.array(acc["starts"]))), lambda x: (x < acc["at"]) | (x == 0))
    return F.aggregate(F.transform(body, lambda r: F.length(r)), begin, step, every)


def split_tables(sheets: DataFrame, keys: list[str], table_name: Column, max_rows: int = 200, max_chars: int = 8000, summary: Column | None = None) -> DataFrame:
    """keys with `sheet` and `lines` (markdown) to table chunks: content with its heading lines, part_index from 1,
    part_count and header; `summary` stands on the first part where it is not empty."""
    parts = sheets.select(*keys, "sheet", table_name.alias("table_name"), (summary if summary is not None else F.lit("")).alias("summary"), table_lines(F.col("lines")).alias("table"))
    made = parts.where(F.size("table") > 0).select(*keys, "sheet", "table_name", "summary", table_header(F.get("table", 0)).alias("header"), table_parts(F.col("table"), max_rows, max_chars).alias("parts"))
    rows = made.select(*keys, "sheet", "table_name", "summary", "header", F.size("parts").alias("part_count"), F.posexplode_outer("parts").alias("at", "part")).where("at is not null")
    note = F.when((F.col("at") == 0) & (F.col("summary") != ""), F.concat(F.lit("[TableSummary] "), F.col("summary")))
    content = F.concat_ws("\n", F.concat(F.lit("[Table] "), F.col("table_name")), F.concat(F.lit("[Sheet] "), F.col("sheet")), note, F.array_join("part", "\n"))
    return rows.select(*keys, "table_name", "sheet", (F.col("at") + 1).alias("part_index"), "part_count", "header", content.alias("content"))
