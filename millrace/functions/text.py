"""String rules as Column expressions: stripping, titles, previews, HTML, and the line classes that chunking needs.

White space means what Python's `str.strip` and `\\s` mean, so every pattern is Unicode-aware.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
#: Line ends, the longest first.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# What makes a line an entry, a title or noise of a table of contents, and a title a table row.
PAGE_NUMBER = rf"\b\d{{1,5}}{WS}*\z"
LEADER = rf"(?:[.·•⋅…-]{WS}*){{3,}}"
LETTERS = r"[A-Za-z一-鿿]"
NUMBERED_ENTRY = rf"^\d+(?:\.\d+)*{WS}*\.?{WS}+.+"
APPENDIX_ENTRY = rf"(?i)^appendix{WS}+(\d+|[a-z]){WS}*[-–—.]?{WS}+.+"
TOC_TITLE = rf"(?i)^{WS}*(table{WS}+of{WS}+contents|contents|目录)\b"
NOISE = (
    rf"^\d+{WS}*-{WS}*\d+\z",
    rf"(?i)^page{WS}+\d+\b",
    r"(?i)^(author|version|current issue date|first issue date)\b",
    r"(?i)\b(archsd|property services branch)\b",
)
TITLE_END = r"[.:;、，]+\z"
NUMBER_TOKEN = r"\b\d+(?:[,\-]\d+)*\b"
NUMBER_GROUP = r"\b\d{1,4}(?:-\d{1,4}){2,}\b"


def sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, F.lit(f"(?U){pattern}"), F.lit(to))


def like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(f"(?U){pattern}"))


def group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, f"(?U){pattern}", n)


def strip(text: Column) -> Column:
    return sub(text, rf"^{WS}+|{WS}+\z")


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return strip(sub(text, rf"{WS}+", " "))


def cell_text(cell: Column) -> Column:
    return collapse(F.coalesce(cell, F.lit("")))


def normalize_title(title: Column) -> Column:
    return sub(sub(F.lower(strip(F.coalesce(title, F.lit("")))), rf"{WS}+", " "), TITLE_END)


def preview(content: Column, size: int = 200) -> Column:
    return F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("..."))).otherwise(content)


def split_lines(text: Column) -> Column:
    """Lines as `str.splitlines` gives them: no empty line after the last line end."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


#: The named character references of everyday pages; numeric ones are decoded by `html_unescape`.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "middot": "·", "copy": "©", "reg": "®", "mdash": "—", "ndash": "–", "hellip": "…", "amp": "&"}


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES.items():  # the ampersand last, so that nothing is decoded twice
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def html_to_text(page: Column, decode=None) -> Column:
    """Visible text: scripts, styles and comments go, other tags become blanks, all character references are decoded
    (`decode_entities` knows the everyday ones and needs no Python)."""
    decode, text = decode or html_unescape, F.coalesce(page, F.lit(""))
    for pattern in (r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", r"(?is)<!--.*?-->"):
        text = F.regexp_replace(text, pattern, "")
    return collapse(decode(F.regexp_replace(text, r"(?s)<[^>]+>", " ")))


def html_unescape(text: Column) -> Column:
    """All named and numeric references, by the standard library in Arrow batches."""

    @F.pandas_udf("string")
    def unescape(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return unescape(text)


def is_toc_line(line: Column) -> Column:
    """An entry of a table of contents: a page number after a numbered title, an appendix title or a leader."""
    s = strip(F.coalesce(line, F.lit("")))
    body = strip(sub(s, rf"{WS}*{PAGE_NUMBER}"))
    named = like(body, NUMBERED_ENTRY) | like(body, APPENDIX_ENTRY) | (like(body, LEADER) & like(body, LETTERS))
    return like(s, PAGE_NUMBER) & (body != "") & named


def is_toc_title(line: Column) -> Column:
    return like(F.coalesce(line, F.lit("")), TOC_TITLE)


def is_toc_noise(line: Column) -> Column:
    """Page heads and feet that may stand between the entries of a table of contents."""
    s = strip(F.coalesce(line, F.lit("")))
    noise = (s == "") | is_toc_title(s)
    for pattern in NOISE:
        noise = noise | like(s, pattern)
    return noise


def looks_like_table_row(title: Column) -> Column:
    t = strip(F.coalesce(title, F.lit("")))
    numbers = F.size(F.regexp_extract_all(t, F.lit(f"(?U){NUMBER_TOKEN}"), F.lit(0)))
    return (t != "") & ((numbers >= 2) | like(t, NUMBER_GROUP))


def number_segments(number: Column) -> Column:
    """Whole numbers between the dots; null where a part is none."""
    parts = F.filter(F.split(F.coalesce(number, F.lit("")), r"\."), lambda p: strip(p) != "")
    found = F.transform(parts, lambda p: strip(p).try_cast("bigint"))
    return F.when((F.size(found) > 0) & F.forall(found, lambda x: x.isNotNull()), found)


def mime_type(filename: Column) -> Column:
    name = F.lower(filename)
    return F.when(name.endswith(".pdf"), "application/pdf").when(name.endswith(".xlsx"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").otherwise("application/octet-stream")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as a browser counts it."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def listed(content: Column, size: int = 30) -> Column:
    """The start of a chunk in one line of a list."""
    return F.concat(F.regexp_replace(F.substring(content, 1, size), r"[\r\n]+", " "), F.lit("..."))


def external_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), number.cast("string"))


def parse_external_id(prefix: str, value: Column) -> Column:
    """`kb-12` or `12` as a number; null for anything else."""
    return group(strip(value), rf"^(?:{prefix}-)?(\d+)\z", 1).try_cast("bigint")


def json_array_text(answer: Column) -> Column:
    """The JSON list in a model's answer: the answer itself, a fenced block, or the first list of objects; else `[]`."""
    fenced = F.regexp_extract(answer, r"(?s)```json\s*(\[.*?\])\s*```", 1)
    inner = F.regexp_extract(answer, r"(?s)(\[\s*\{.*?\}\s*\])", 1)
    valid = lambda s: F.when((s != "") & F.try_parse_json(s).isNotNull() & F.ltrim(s).startswith("["), s)
    whole = F.when(F.try_parse_json(answer).isNotNull(), F.when(F.ltrim(answer).startswith("["), answer).otherwise("[]"))
    return F.coalesce(whole, F.when(fenced != "", F.coalesce(valid(fenced), F.lit("[]"))), valid(inner), F.lit("[]"))


def image_links(content: Column, asset_url: str) -> Column:
    """Markdown and <img> sources point at the asset URL by their name below output_images/; absolute ones stay."""
    local = r"(?!https?://|file:)(?:[^)\s\"']*/)?"
    made = F.regexp_replace(content, rf"(!\[[^\]]*\]\(){local}([^)\s/\"']+)\)", rf"$1{asset_url}/$2)")
    return F.regexp_replace(made, rf"(<img[^>]*src=[\"']){local}([^\"'/]+)([\"'])", rf"$1{asset_url}/$2$3")
