"""Cases of the findings of round 3."""

import collections
import datetime
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import near_dedup, packing, pieces
from millrace.operators import chunking, joins, keyword_index, long_texts, vector_index
from millrace.plans import registry
from millrace.sources import tables
from millrace.streaming import tool_calls


def test_query_blocks_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float((i * 7 + j * j) % 11 - 5) for j in range(8)]) for i in range(600)], "vec_id long, embedding array<double>")
    plans, best, block = [], vector_index._best, vector_index.BLOCK

    def seen(pairs, k):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return best(pairs, k)

    monkeypatch.setattr(vector_index, "_best", seen)
    want = None
    for size in (block, 7):  # one block a cell, and many
        monkeypatch.setattr(vector_index, "BLOCK", size)
        got = sorted(map(tuple, vector_index.nearest_each(rows.where("vec_id % 50 = 0"), vector_index.build(rows), 5).rows.collect()))
        want = want or got
        assert got == want and len(got) == 60
    assert len(plans) == 4 and all("SortMergeJoin [cell" in p for p in plans)


def test_cut_references_stay_as_in_sql(spark, tmp_path):
    pages = [(1, "u", "<p>a &amp; b &lt;i&gt; &amp"), (2, "u", "x &am"), (3, "u", "&copy; &ampere &#65;")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in registry.QUERIES["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "a & b <i> &amp", 2: "x &am", 3: "© &ampere &#65;"}


def _packed(lines, max_rows, max_chars):
    head, parts, part = lines[:2], [], []
    base = len("\n".join(head))
    chars = base
    for line in lines[2:]:
        if part and len(part) + 1 < max_rows and chars + 1 + len(line) >= max_chars:
            parts.append(part)
            part, chars = [], base
        part, chars = [*part, line], chars + 1 + len(line)
        if len(part) >= max_rows:
            parts.append(part)
            part, chars = [], base
    return [head + p for p in [*parts, *([part] if part else [])]] or [head]


@pytest.mark.parametrize(("rows", "most"), [(0, 3), (1, 1), (3000, 1), (2999, 4), (700, 1000)])
def test_table_parts_of_many_rows(spark, rows, most):
    lines = ["| k |", "| --- |", *[f"| {'x' * (i % 5)}{i} |" for i in range(rows)]]
    df = spark.createDataFrame([(lines,)], "table array<string>")
    for chars in (1 << 30, 40):
        made = df.select(chunking.table_parts(F.col("table"), most, chars).alias("parts"))
        assert made.first().parts == _packed(lines, most, chars)
        # the rows are cut off once, not again for every part
        assert made._jdf.queryExecution().optimizedPlan().toString().count("slice(table") <= 2


def test_workbooks_are_read_whole(spark, tmp_path):
    """More rows a sheet than the caps of an ingest, and parts of more characters."""
    n = 11_000
    parts = spark.range(n).select(F.col("id").alias("p_partkey"), F.repeat(F.lit("n"), 120).alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.when(F.col("id") % 2 == 0, 1).otherwise(40).alias("p_size"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = [r for r in registry.QUERIES["workbook_chunks"](spark, str(tmp_path)).collect() if r.p_brand != "none"]
    assert len(got) == 2 * -(-n // 2 // 80) and [r.chunk_index for r in sorted(got, key=lambda r: r.chunk_index)] == list(range(len(got)))
    assert sum(len(r.content.split("\n")) - 4 for r in got) == n


def test_approximate_count_of_no_user(spark, tmp_path):
    events = [("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 3)]
    spark.createDataFrame(events, "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    made = registry.QUERIES["sql_approx_distinct"](spark, str(tmp_path))
    assert sorted(map(str, made.collect())) == sorted(f"Row(event_type={t}, near=True)" for t in ("'a'", "'b'", "None"))
    # no sketch for each user
    by_user = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "keys=[event_type" in x and "user_id" in x.split("]")[0]]
    assert by_user and not any("approx_count_distinct" in x for x in by_user)


@pytest.mark.parametrize(("keys", "by"), [((), ()), (("u",), ()), ((), ("kind",)), (("u",), ("kind",))])
def test_counts_in_intervals_are_those_of_pairs(spark, keys, by):
    rng, t0 = random.Random(3), datetime.datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.03 else t0 + datetime.timedelta(seconds=rng.randrange(400))
    left = [(i, rng.choice([1, 2, 3, None]), at(), at()) for i in range(120)]
    right = [(rng.choice([1, 2, 2, 4, None]), rng.choice(["x", "y", None]), at()) for _ in range(900)]
    a, b = spark.createDataFrame(left, "id long, u long, start timestamp, stop timestamp"), spark.createDataFrame(right, "u long, kind string, at timestamp")
    want = collections.Counter()
    for i, u, start, stop in left:
        for v, kind, ts in right:
            if None not in (start, stop, ts) and start <= ts < stop and (not keys or u == v and u is not None):
                want[(i, *((kind,) if by else ()))] += 1
    got = joins.counts_in_intervals(a, b, "start", "stop", "at", ["id"], keys, by).collect()
    assert {tuple(r[:-1]): r.n for r in got} == want and len(got) == len(want)


def test_interval_queries_make_no_pairs(spark, sf, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("pairs of intervals and points are made")

    monkeypatch.setattr(joins, "points_in_intervals", pairs)
    for name in ("join_interval", "join_interval_keyless"):
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_small_workbooks_share_frames():
    books = [(f"{i}", bytearray(tables.workbook_bytes([("s", [["k"], [str(i)]])]) if i % 5 else b"no zip")) for i in range(60)]
    frames = []

    class Named:
        def mapInPandas(self, run, schema):
            frames.extend(run(iter([pd.DataFrame(books, columns=["path", "content"])])))
            return frames

        def select(self, *_):
            return self

    tables.read_workbooks(Named())
    assert len(frames) == 1 and len(frames[0]) == 48 * 2 + 12
    assert frames[0]["error"].notna().sum() == 12 and frames[0]["path"].tolist() == [f"{i}" for i in range(60) for _ in range(2 if i % 5 else 1)]


def test_shingles_free_what_encoding_kept():
    encoder = pieces.encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.encode(pa.array(["some words"]))
    assert pieces.encoder.cache_info().currsize
    list(near_dedup._signatures(iter([]), 5))
    assert not pieces.encoder.cache_info().currsize


def test_postings_are_made_without_a_shuffle(spark, monkeypatch):
    texts = ["the cat_1 the\u4e00\u9fffa \u4dff\ua000 x", "", None, "\u00e9a\u00e9 the", "\u5357", " ", "a\u5357the-a"] * 3
    rows = spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "file_id long, chunk_index int, content string").coalesce(1)
    want = collections.Counter((w, i // 2, i % 2, len(t)) for i, t in enumerate(texts) for w in re.findall("[a-z0-9_]+|[\u4e00-\u9fff]+", t or ""))
    for size in (1 << 20, 1):  # one block, and one a batch
        monkeypatch.setattr(keyword_index, "BLOCK", size)
        made = keyword_index.postings(rows)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.collect()
        assert collections.Counter({(r.word, h.file_id, h.chunk_index, h.length): h.n for r in got for h in r.hits}) == want
        assert all(r.chunks == len(r.hits) for r in got) and sum(r.chunks for r in got) == len(want)


def test_words_of_sliced_batches():
    texts = pa.array(["left out", "b c", "", "\u5357\u5357d", "e"])[1:]
    words, rows = keyword_index.words_of(texts)
    assert list(zip(words.to_pylist(), rows.tolist(), strict=True)) == [("b", 0), ("c", 0), ("\u5357\u5357", 2), ("d", 2), ("e", 3)]
    assert [len(x) for x in keyword_index.words_of(pa.array(["", ""]))] == [0, 0]


def test_calls_of_a_message_are_looked_up():
    rng, calls, want, rows = random.Random(5), [], [], []
    for seq in range(3000):
        name, run = rng.choice(["f", "g", None]), rng.choice([None, None, f"r{rng.randrange(40)}"])
        rows.append((seq, rng.choice(["on_tool_start", "on_tool_end", "on_tool_error"]), name, run, str(seq), seq))
    for seq, event, name, run, text, _ in rows:  # by a scan of all calls
        if event == "on_tool_start":
            calls.append([len(calls), run, name, False])
            want.append((len(calls) - 1, seq, run, name, event, None))
            continue
        call = next((c for c in calls if run is not None and c[1] == run), None)
        call = call or next((c for c in reversed(calls) if name is not None and c[2] == name and not c[3]), None)
        if call:
            call[3] = True
            want.append((call[0], seq, call[1], call[2], event, text))
    for cut in (0, 1000):  # at once, and from a state
        state = []
        n, made = tool_calls.folded(state, 0, rows[:cut])
        n, more = tool_calls.folded([c for c in state if not c[5] or c[2] is not None], n, rows[cut:])
        assert made + more == want and n == len(calls)


def test_headings_deal_blocks_and_no_lines(spark, monkeypatch):
    def dealt(*_, **__):
        raise AssertionError("lines are dealt to ranges one by one")

    monkeypatch.setattr(joins, "latest_before", dealt)
    # blocks need not begin at 0; chunks over many blocks, a block of many chunks, one without any, text before the first
    parts = [(1, 3, "before\n1 A\na\n"), (1, 4, "b\n\n"), (1, 7, "c\n2 B\n3 C\nd\n"), (1, 9, "e\n"), (2, 5, "no\n"), (2, 6, "heading \n"), (3, 0, "")]
    rows = spark.createDataFrame(parts, "doc long, block int, content string")
    got = long_texts.headings(long_texts.lines(rows)).select("doc", "chunk_index", "number", "content").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "1", "1 A\na\nb\n\nc"), (1, 1, "2", "2 B"), (1, 2, "3", "3 C\nd\ne"), (2, 0, "", "no\nheading"), (3, 0, "", "")]


def test_letters_are_lowered_as_python_does():
    letters = [c for c in map(chr, range(0x3000)) if re.match(f"[{pieces.LETTERS}]", c)] + ["一", "龥"]
    assert len(letters) > 400 and "".join(letters).isalpha() and unicodedata.is_normalized("NFC", "".join(letters)) and "Σ" not in letters
    assert pc.utf8_lower(pa.array(letters)).to_pylist() == [c.lower() for c in letters]


def test_words_go_to_the_model_once(monkeypatch):
    """More words than a cache of units holds, with closing marks and in both cases; then more than are remembered."""
    path, asked, symbols = public_tokenizers.path("word_bpe_49k.json"), [], pieces.symbols
    monkeypatch.setattr(pieces, "CACHE", 100)
    monkeypatch.setattr(pieces, "symbols", lambda piece: asked.append(piece) or symbols(piece))
    words = [f"{a}{b}{c}" for a in "aéñ" for b in "bcdfghklmn" for c in "aeiouäöüîô"]
    texts = pa.array([" ".join(words), " ".join(w.upper() + "?!" for w in words), "", " x1 <|endoftext|>a. ...", "Ók İki ΟΔΟΣ " + "long" * 40])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts.to_pylist(), add_special_tokens=False)]
    encoder = pieces.Encoder(path)

    def encoded():
        ids, at = encoder.encode(texts)
        return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]

    assert encoded() == want and encoded() == want
    assert all(n == 1 for w, n in collections.Counter(asked).items() if w in set(words))
    monkeypatch.setattr(pieces, "WORDS", 100)
    encoder.encode(pa.array(["only these remain"]))
    encoder.encode(pa.array(["and more"]))
    assert len(encoder.words.words) < 10 and encoded() == want


def test_distinct_ids_are_counted():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 300, 1000).astype("<u2"), rng.integers(0, 1 << 31, 50), np.zeros(7, "<u4"), np.zeros(0, "<u2")):
        for got, want in zip(packing.distinct(ids), np.unique(ids, return_counts=True), strict=True):
            assert got.tolist() == want.tolist()
