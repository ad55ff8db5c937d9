"""Rules that the tables do not exercise, against plain restatements of them."""

import datetime
import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import catalog, chunking, events, joins, keyword, keyword_index, long_texts, retrieval, sketches, sqlgate, table_functions, tools, vector_index, vectors
from millrace.sources import event_log, shared, tables
from millrace.streaming import folds, tool_calls


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


# -- text


@pytest.mark.parametrize("s", ["", "  a \t b\n", "　x  y\x1c", "Title: 、", "A.:;", None])
def test_titles_and_cells(spark, s):
    want = re.sub(r"[\.:;、，]+$", "", re.sub(r"\s+", " ", (s or "").strip().lower()))
    assert one(spark, T.normalize_title, s) == want
    assert one(spark, T.cell_text, s) == re.sub(r"\s+", " ", s or "").strip()


@pytest.mark.parametrize("s", ["", "a", "a\n", "a\r\nb\rc", "\n\n", "a\x0bb\x0cc\x85d e", "😀\n"])
def test_lines(spark, s):
    assert one(spark, T.split_lines, s) == s.splitlines()


@pytest.mark.parametrize(
    ("line", "entry"),
    [("1.2 Scope ..... 7", True), ("Appendix A Tables 12", True), ("Intro . . . . 3", True), ("Intro 3", False), ("..... 3", False), ("1.2 Scope", False), ("7", False), ("", False), ("appendix b - More 9", True)],
)
def test_toc_line(spark, line, entry):
    assert one(spark, T.is_toc_line, line) is entry


def test_html(spark):
    page = "<html><script>x<b></script><!-- c --><p>A&amp;B&nbsp;&lt;i&gt;</p> <style>q</style>\n&copy; é</html>"
    assert one(spark, T.html_to_text, page) == "A&B <i> © é"
    assert one(spark, lambda c: T.html_to_text(c, T.html_unescape), "<p>&#65;&eacute;</p>") == "Aé"


def test_json_array(spark):
    for answer, want in (('[{"a":1}]', '[{"a":1}]'), ('x ```json\n[{"a":2}]\n``` y', '[{"a":2}]'), ('say [ {"a":3} ] so', '[ {"a":3} ]'), ('{"a":1}', "[]"), ("no", "[]"), ("```json [bad ]```", "[]")):
        assert one(spark, T.json_array_text, answer) == want


def test_links_and_ids(spark):
    assert one(spark, lambda c: T.image_links(c, "/assets"), "![x](output_images/a.png) <img src='b/c.jpg'> ![y](http://h/z.png)") == "![x](/assets/a.png) <img src='/assets/c.jpg'> ![y](http://h/z.png)"
    assert [one(spark, lambda c: T.parse_external_id("kb", c), v) for v in ("kb-12", "7", "f-1")] == [12, 7, None]


# -- chunking


def windows(text, size=500, overlap=100):
    s, out, start = text.strip(), [], 0
    while s:
        out.append(s[start : start + size])
        if start + size >= len(s):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 900, 901, 1300, 1301])
def test_fixed_windows(spark, n):
    text = ("😀abc é" * 400)[:n]
    got = one(spark, chunking.fixed_windows, text)
    assert got == windows(text)
    assert "".join(w[: 400 if i < len(got) - 1 else None] for i, w in enumerate(got)) == text.strip()


def test_window_arguments():
    for make in (lambda: chunking.fixed_windows(F.lit("a"), 10, 10), lambda: long_texts.windows(None, 0, 0)):
        with pytest.raises(ValueError):
            make()


@pytest.mark.parametrize("size, overlap", [(40, 13), (40, 0), (7, 6)])
def test_windows_of_blocks(spark, size, overlap):
    """Documents over many blocks: blank ends of any length, blocks of blanks only, texts that end at a block's end."""
    rng = np.random.default_rng(size)
    texts = ["", " ", None, "x", "x" * 40, "x" * 41, " " * 130 + "a b" + "\t" * 90, "é😀" * 60 + "\n" * 40, *["".join(rng.choice(list("ab \n😀"), int(n))) for n in rng.integers(1, 400, 25)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = long_texts.windows(long_texts.blocks(docs, "id", size=40), size, overlap).collect()
    assert sorted((r.doc, r.chunk_index, r.content) for r in got) == [(i, n, w) for i, t in enumerate(texts) for n, w in enumerate(windows(t or "", size, overlap))]


def test_headings_of_lines(spark):
    """Chapters and appendices over blocks of few lines, as for whole texts; documents without headings are one chunk."""
    rng = np.random.default_rng(4)
    kinds = ["1 One", "2 Two", "1.1 Sub", "Appendix A - First", "3 Skipped", "text", "  ", "## **4 Four**", "Appendix B Second", "plain words", "2.1 Last \u2028 broken", "B. Letter"]
    texts = ["\n".join(rng.choice(kinds, int(n))) for n in rng.integers(1, 60, 30)] + ["no heading\nat all", "", "\n\n1 A\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keep = ["chunk_index", "number", "title", "path", "content"]
    for size in (1, 5):
        got = long_texts.headings(long_texts.lines(long_texts.line_blocks(docs, "id", size=size))).select(F.col("doc").alias("id"), *keep)
        assert rows_text(got) == rows_text(chunking.split_headings(docs, ["id"]).select("id", *keep))


def bounds_by_scan(lines, is_toc, is_noise, is_title):
    start = next((i for i, x in enumerate(lines) if is_title(x)), next((i for i, x in enumerate(lines) if is_toc(x)), None))
    if start is None or start + 1 >= len(lines):
        return None
    count, last, streak = 0, None, 0
    for j in range(start + 1, len(lines)):
        if is_toc(lines[j]):
            count, last, streak = count + 1, j, 0
            continue
        noise = is_noise(lines[j])
        if noise and count >= 3 and streak + 1 > 80 or not noise and (count < 3 or streak + 1 > 20):
            break
        streak += 1
    end = (start if last is None else last) + 1
    return None if end - start < 3 else (start, end)


def test_toc_bounds(spark):
    rng, cases = random.Random(3), []
    for _ in range(150):
        kinds = rng.choices("TTTNO", k=rng.randint(0, 12)) + ["N"] * rng.choice([0, 0, 19, 20, 21, 79, 80, 81]) + rng.choices("TNO", k=rng.randint(0, 6)) + ["O"] * rng.choice([0, 20, 21]) + rng.choices("TO", k=3)
        cases.append([*rng.choice([[], ["Contents"]]), *[{"T": f"{i} Title {i + 1}", "N": "page 3", "O": "plain words"}[k] for i, k in enumerate(kinds)]])
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, lines array<string>")
    got = {r["id"]: r["b"] and (r["b"]["first"], r["b"]["stop"]) for r in rows.select("id", chunking.toc_bounds(F.col("lines")).alias("b")).collect()}
    for i, lines in enumerate(cases):
        want = bounds_by_scan(lines, lambda x: "Title" in x, lambda x: x.startswith("page") or x == "Contents", lambda x: x == "Contents")
        assert got[i] == want, lines


def split(spark, text, f=chunking.split_headings):
    return [(r["number"], r["title"], r["content"]) for r in f(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("chunk_index").collect()]


def test_headings(spark):
    assert [c[0] for c in split(spark, "preamble\n1 A\nx\n1.1 B\ny\n2 C")] == ["1", "1.1", "2"]
    assert split(spark, "1. Title\nbody") == [("", "", "1. Title\nbody")]
    assert [c[:2] for c in split(spark, "10 apples\n## **1 Title**")] == [("10", "apples"), ("1", "Title")]
    text = "Appendix A - X\n1 P\n3 Q\n1.1 R\n2 S\n5 6 7\nI think so\n1 Next"
    assert [c[0] for c in split(spark, text)] == ["Appendix A", "Appendix A.1", "Appendix A.1.1", "Appendix A.2", "I", "I.1"]
    assert split(spark, "") == [("", "", "")]
    assert [c[0] for c in split(spark, "2 contents\n1 Intro ..... 7\n3-4 x\n2024-01-02 x")] == ["3", "2024"]


def test_numbers_without_a_parent(spark):
    for f in (chunking.split_headings, chunking.split_adaptive, chunking.split_document):
        assert [c[:2] for c in split(spark, "1.2 Orphan title\nbody", f)] == [("1.2", "Orphan title")]
    docs = spark.createDataFrame([(1, "1 A\n1.2.3 B\n2.1 C\nAppendix A - X\n99999999999999999999 Z\n9223372036854775807 P\n1 Q\n1.1 R\n3.1 S")], "id int, text string")
    made = chunking.split_headings(docs, ["id"]).orderBy("chunk_index").collect()
    assert [(r["number"], [p["number"] for p in r["path"]]) for r in made] == [
        ("1", ["1"]), ("1.2.3", ["1", "1.2.3"]), ("2.1", ["2.1"]), ("Appendix A", ["Appendix A"]), ("Appendix A.1", ["Appendix A", "Appendix A.1"]),
        ("Appendix A.1.1", ["Appendix A", "Appendix A.1", "Appendix A.1.1"]),
    ]


def test_many_headings(spark):
    """More headings than a block of the fold; the open appendix and the last number carry over."""
    text = "\n".join(["1 A", "Appendix C - D", *[f"{i} H" for i in range(1, 700)], "702 skipped", "700 T"])
    made = split(spark, text)
    assert [c[0] for c in made] == ["1", "Appendix C", *[f"Appendix C.{i}" for i in range(1, 701)]]


def test_model_headings(spark):
    answer = '```json\n[{"number": "1", "title": "Scope."}, {"number": "1", "title": " scope"}, {"number": "2", "title": " "}, {"title": "Scope"}, {"number": "2", "title": "Scope"}]\n```'
    assert [tuple(h) for h in one(spark, chunking.model_headings, answer)] == [("1", "Scope."), ("", "Scope"), ("2", "Scope")]
    assert one(spark, chunking.model_headings, "no list") == [] and one(spark, chunking.model_headings, None) == []


def test_heading_path_and_preamble(spark):
    docs = spark.createDataFrame([(1, "before\n1 A\n1.1 B\n1.1 C\n1.1.2 D")], "id int, text string")
    lines = T.split_lines(F.col("text"))
    made = docs.select(chunking.heading_chunks(lines, chunking.headings(lines), keep_preamble=True).alias("c")).first()["c"]
    assert made[0]["content"] == "before"
    assert [(p["number"], p["title"]) for p in made[-1]["path"]] == [("1", "A"), ("1.1", "C"), ("1.1.2", "D")]


def test_adaptive(spark):
    text = "Contents\n1 One ..... 2\n2 Two ..... 3\n3 Three ..... 4\n1 One\na\n2 Two\nb"
    made = split(spark, text, chunking.split_adaptive)
    assert made[0] == ("", "Contents", "Contents\n1 One  2\n2 Two  3\n3 Three  4")
    assert [c[0] for c in made[1:]] == ["1", "2"]


def parts_by_scan(body, head, max_rows, max_chars):
    out, rows = [], []
    for row in body:
        rows.append(row)
        if len(rows) >= max_rows:
            out.append(rows)
            rows = []
        elif len("\n".join(head + rows)) >= max_chars and len(rows) > 1:
            out.append(rows[:-1])
            rows = [row]
    return [head + r for r in out + ([rows] if rows else [])] or [head]


def test_table_parts(spark):
    rng, head = random.Random(5), ["| h |", "| --- |"]
    for max_rows, max_chars in ((3, 40), (80, 60), (1, 10), (4, 10**6)):
        cases = [["| " + "x" * rng.choice([1, 3, 9, 70]) + " |" for _ in range(n)] for n in (0, 1, 2, 5, 17, 80, 81)]
        rows = spark.createDataFrame([(i, head + c) for i, c in enumerate(cases)], "id int, lines array<string>")
        got = {r["id"]: [list(p) for p in r["p"]] for r in rows.select("id", chunking.table_parts(F.col("lines"), max_rows, max_chars).alias("p")).collect()}
        for i, body in enumerate(cases):
            assert got[i] == parts_by_scan(body, head, max_rows, max_chars)


# -- retrieval


def test_keyword(spark):
    rows = spark.createDataFrame([(1, "Réunion BIM bim a 指南"), (2, "union union union union x"), (3, "指南指南 bim"), (4, " ")], "file_id long, content string").withColumn("chunk_index", F.lit(0))
    assert spark.range(1).select(keyword.query_terms(F.lit("Réunion BIM bim a 指南 BIM"))).first()[0] == ["union", "BIM", "bim", "指南"]
    got = {r["file_id"]: r["score"] for r in keyword.scored(rows, "Réunion BIM bim a 指南").collect()}
    assert got == {1: 1 + 2 + 2 + 1 + 5.0, 2: 3.0, 3: 1 + 1 + 2.0}
    first = rows.where("file_id = 1").select("file_id", "chunk_index")
    assert [r["file_id"] for r in keyword.keyword_search(rows, "bim union", 5, first).orderBy("rank").collect()] == [2, 3]
    assert keyword.scored(rows, " ").count() == 0


WORDS = ["alpha", "beta", "gammas", "under", "thunder", "the", "then", "a1", "x_y", "指南", "南", "é", "İstanbul", "\u212aelvin"]


@pytest.fixture(scope="module")
def worded(spark):
    """Chunks of words that hold each other, of both scripts, with ties, blank and null contents."""
    rng = np.random.default_rng(7)
    rows = [(i // 3, i % 3, " ".join(rng.choice(WORDS, rng.integers(0, 25))) + rng.choice(["", "指南指南", " The Alpha under", "!"])) for i in range(400)]
    rows += [(900, 0, None), (901, 0, "  "), (902, 0, "the alpha"), (903, 0, "the alpha"), (904, 1, "THE ALPHA thealpha")]
    table = spark.createDataFrame(rows, "file_id long, chunk_index int, content string").withColumn("kb", F.col("file_id") % 3)
    table = shared.saved(table, "worded")
    plain = keyword_index.KeywordIndex.build(table.select("file_id", "chunk_index", "content"))
    return table, plain, keyword_index.KeywordIndex.of(keyword_index.postings(table, ["kb", "file_id", "chunk_index"]))


@pytest.mark.parametrize("query", ["the alpha", "The Alpha under", "under", "th", "a1 x_y 指南 gamma", "指", "kelvin istanbul", "zzz the", "zzz", " ", "e", "the then a1 alpha beta gammas under thunder", "é the"])
def test_keyword_index_equals_the_scan(worded, query):
    table, plain, keyed = worded
    shown = lambda rows: [(r["rank"], r["file_id"], r["chunk_index"], r["score"]) for r in rows.orderBy("rank").collect()]
    for k in (2, 1000):
        found = keyword_index.search(plain, table.select("file_id", "chunk_index", "content"), query, k)
        assert shown(found.hits) == shown(keyword.keyword_search(table, query, k))
    each = keyword_index.search(keyed, table, query, 2, by=("kb",)).hits.select("kb", "file_id", "chunk_index", "score", "rank")
    scan = retrieval.search_each(table, query, "kb", 2).select("kb", "file_id", "chunk_index", "score", "rank")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, scan.collect()))


def test_keyword_index_stops_early(spark):
    """Common terms add too little: their lists are read for candidates only, and few contents are compared."""
    rows = [(i, 0, "the of and " * 3 + ("rare rarer rarest " * 3 if i % 100 == 0 else "")) for i in range(2000)] + [(5000, 0, "rare rarer rarest the")]
    table = spark.createDataFrame(rows, "file_id long, chunk_index int, content string")
    query = "rare rarer rarest the of"
    found = keyword_index.search(keyword_index.KeywordIndex.build(table), table, query, 5)
    assert found.whole_lists == ["rarer", "rarest", "rare"][: len(found.whole_lists)] or set(found.whole_lists) <= {"rare", "rarer", "rarest"}
    assert found.compared <= 21
    assert [tuple(r) for r in found.hits.orderBy("rank").select("rank", "file_id", "score").collect()] == [tuple(r) for r in keyword.keyword_search(table, query, 5).orderBy("rank").select("rank", "file_id", "score").collect()]


def test_catalog_keeps_its_index(spark, tmp_path):
    """Chunks that are replaced, deleted or cleaned are found no more; those of other versions are."""
    c = catalog.Catalog(spark, f"file://{tmp_path}/kb", indexed=True)
    kb, other = c.create_kb("a"), c.create_kb("b")
    a, b = c.save_upload(kb, "a.pdf"), c.save_upload(kb, "b.pdf")
    chunk = lambda text: spark.createDataFrame([(0, text)], "chunk_index int, content string")
    hits = lambda query: sorted((r.kb_id, r.file_id, r["rank"], r.score, r.content) for r in c.keyword_search([kb, other], query).collect())
    assert hits("river") == []
    c.save_chunks(kb, a, chunk("the river bank"))
    c.save_chunks(kb, b, chunk("a river"))
    c.save_chunks(other, c.save_upload(other, "c.pdf"), chunk("riverbed"))
    assert hits("river") == [(1, 1, 2, 6.0, "the river bank"), (1, 2, 1, 6.0, "a river"), (2, 1, 1, 6.0, "riverbed")]
    c.save_chunks(kb, a, chunk("a lake"))
    c.delete_file(other, 1)
    assert hits("river") == [(1, 2, 1, 6.0, "a river")] and hits("lake") == [(1, 1, 1, 6.0, "a lake")]
    before = len(list((tmp_path / "kb/postings").glob("*/*")))
    assert c.clean(keep=1) > 0 and len(list((tmp_path / "kb/postings").glob("*/*"))) == before - 2
    assert hits("river lake") == [(1, 1, 1, 1.0, "a lake"), (1, 2, 2, 1.0, "a river")]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in vectors.nearest(rows, [3.0, 0.0], 5).orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (5, 0.707107), (2, 0.0), (3, -1.0)]
    assert vectors.nearest(rows, [0.0, 0.0]).count() == 0
    each = vectors.nearest_each(rows.where("vec_id in (1, 2)"), rows, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in each] == [(1, 4), (1, 5), (2, 1), (2, 3)]
    with pytest.raises(Exception, match="must have 3 dimensions"):
        vectors.checked_dimension(rows, 3).collect()
    unit = rows.select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v")).collect()
    assert all(abs(np.linalg.norm(r["v"]) - (r["vec_id"] != 2)) < 1e-12 for r in unit)


def clustered(spark, n, copies):
    """Vectors around a few directions, with zero vectors, copies of one vector, nulls and two labels."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(scale=0.05, size=8)).tolist(), i % 2) for i in range(n)]
    rows += [(n + i, base[0].tolist(), 0) for i in range(copies)] + [(n + copies, [0.0] * 8, 1), (n + copies + 1, [0.0] * 8, 0), (n + copies + 2, None, 0), (None, [1.0] * 8, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("n, copies, cells, k, within", [(600, 30, 24, 5, None), (600, 30, 24, 3, "label"), (40, 0, 3, 100, None), (1, 0, 5, 2, None), (300, 200, 1, 4, None)])
def test_cells_equal_all_pairs(spark, n, copies, cells, k, within):
    rows = clustered(spark, n, copies).cache()
    queries = rows.where("vec_id % 7 = 0 or vec_id >= " + str(n + copies))
    found = vector_index.nearest_each(queries, vector_index.build(rows, within=within, cells=cells), k, within=within)
    want = vectors.nearest_each(queries, rows, k, within=within)
    shown = lambda t: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in t.collect())
    assert shown(found.rows) == shown(want)
    assert found.read <= found.pairs and (cells < 24 or found.read < found.pairs / 2)


def test_cells_of_nothing(spark):
    none = clustered(spark, 5, 0).where("false")
    assert vector_index.build(none) is None
    assert vector_index.nearest_each(none, vector_index.build(clustered(spark, 5, 0)), 3).rows.count() == 0


def test_hybrid(spark):
    rows = spark.createDataFrame([(i, 0, f"alpha {'beta ' * (i % 4)}", [float(i), 1.0] if i < 3 else None) for i in range(9)], "file_id long, chunk_index int, content string, embedding array<double>")
    got = retrieval.hybrid_search(rows, "beta", [1.0, 0.0]).orderBy("position").collect()
    assert [r["source"] for r in got] == ["semantic"] * 3 + ["keyword"] * 4
    assert len({r["file_id"] for r in got}) == len(got)
    assert retrieval.hybrid_search(rows, "  ", [1.0, 0.0]).count() == 0


def test_rerank_keeps_the_given_order_where_the_scorer_fails(spark):
    hits = spark.createDataFrame([(1, 0, "a", 0, 2), (2, 0, "bbb", 0, 1), (3, 0, "", 1, 1)], "file_id long, chunk_index int, content string, source_rank int, rank int")

    def broken(content):
        raise RuntimeError("no model")

    order = lambda scorer: [r["file_id"] for r in retrieval.rerank(hits, scorer).orderBy("position").collect()]
    assert order(broken) == order(None) == [2, 1, 3]
    assert order(lambda content: -content.str.len().astype(float)) == [1, 2]
    assert [r["file_id"] for r in retrieval.rerank(hits.where("content = ''"), lambda c: c.str.len().astype(float)).collect()] == [3]


# -- catalog, SQL, events


def test_catalog_survives_a_write_that_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/kb"
    c = catalog.Catalog(spark, path)
    kb = c.create_kb("a")
    file_id = c.save_upload(kb, "one.pdf")
    chunks = spark.createDataFrame([(0, "p"), (1, "q")], "chunk_index int, content string")
    c.save_chunks(kb, file_id, chunks)
    with monkeypatch.context() as broken:
        broken.setattr(catalog.Catalog, "_commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        for change in (lambda: c.save_chunks(kb, file_id, chunks.limit(1)), lambda: c.create_kb("b"), lambda: c.delete_kb(kb), lambda: c.save_upload(kb, "two.pdf")):
            with pytest.raises(OSError):
                change()
    again = catalog.Catalog(spark, path)
    assert again.chunks(kb, file_id).count() == 2 and again.files(kb).first()["chunk_count"] == 2 and again.list_kbs().count() == 1
    assert again.create_kb("b") == 2 and again.save_upload(kb, "two.pdf") == 2
    late = again._state()
    again.update_kb(2, name="c")
    with pytest.raises(ValueError, match="meanwhile"):
        again._commit(late)
    for pointer in (tmp_path / "kb" / "pointers").iterdir():
        pointer.unlink()
    with pytest.raises(ValueError, match="no pointer"):
        again.list_kbs()


def test_ingest(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/kb")
    kb, embedder = c.create_kb("a"), vectors.HashEmbedder(8)
    c.save_upload(kb, "x/book.xlsx", tables.workbook_bytes([("S1", [["h", "k"], ["1", "a & b"]]), ("S2", [["h"], *[[str(i)] for i in range(81)]])]))
    c.save_upload(kb, "empty.xlsx", tables.workbook_bytes([("S", [])]))
    c.save_upload(kb, "paper.pdf", b"1 Scope\ntext\n1.1 Aim\nmore")
    c.save_upload(kb, "bad.pdf", b"\xff")
    assert c.ingest(kb, "book.xlsx", embedder=embedder) == 3
    parts = [r["content"] for r in c.chunks(kb, 1).collect()]
    assert parts[0] == "[Table] book\n[Sheet] S1\n| h | k |\n| --- | --- |\n| 1 | a & b |" and parts[2].endswith("| 80 |") and parts[1].count("\n") == 83
    assert c.ingest(kb, "empty.xlsx") == 1 and c.chunks(kb, 2).first()["content"].startswith("[Table] empty\n[ExcelEmpty] ")
    assert c.ingest(kb, "paper.pdf", bytes.decode, embedder) == 2
    assert [json.loads(r["metadata"])["number"] for r in c.chunks(kb, 3).collect()] == ["1", "1.1"]
    for name, error in (("bad.pdf", ValueError), ("none.pdf", FileNotFoundError)):
        with pytest.raises(error):
            c.ingest(kb, name, bytes.decode)
    every = c.all_chunks([kb])
    assert every.count() == 6 and {r["filename"] for r in every.collect()} == {"book.xlsx", "empty.xlsx", "paper.pdf"}
    extra = spark.createDataFrame([(3, "new", [1.0] * 8)], "chunk_index int, content string, embedding array<double>")
    assert c.add_vectors(kb, 1, extra) == 4
    with pytest.raises(Exception, match="dimensions"):
        c.add_vectors(kb, 1, extra.withColumn("embedding", F.array(F.lit(1.0))))
    assert c.clear_vectors(kb) == 6 and c.clear_vectors(kb) == 0 and c.all_chunks([kb]).count() == 7


def folders(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in tmp_path.glob("kb/*/*/*") if p.is_dir()} | {str(p.relative_to(tmp_path)) for p in tmp_path.glob("kb/kb/*")}


def test_bulk_ingest(spark, tmp_path):
    """Many uploads in one change: what is damaged keeps its state and has its error; a later upload starts over."""
    c = catalog.Catalog(spark, f"file://{tmp_path}/kb")
    kb = c.create_kb("a")
    book = lambda cell: tables.workbook_bytes([("S", [["h"], [cell]])])
    assert c.save_upload(kb, "old.xlsx", book("old")) == 1
    half = book("x" * 5000)
    broken = bytearray(book("y"))
    broken[60] ^= 255
    rows = [("in/a.xlsx", book("1")), ("b.xlsx", book("2")), ("old.xlsx", book("new")), ("half.xlsx", half[: len(half) // 2]), ("junk.xlsx", b"junk"), ("empty.xlsx", tables.workbook_bytes([("S", [])])), ("p.pdf", b"1 Scope\ntext"), ("bad.pdf", b"\xff"), ("b.xlsx", book("2"))]
    uploads = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "filename string, content binary")
    assert c.save_uploads(kb, uploads) == 8
    before = len(c.snapshots())
    errors = {r.filename: r.error for r in c.ingest_all(kb, bytes.decode, vectors.HashEmbedder(4)).collect()}
    assert set(errors) == {"half.xlsx", "junk.xlsx", "bad.pdf"} and errors["half.xlsx"].startswith("the workbook can't be read: BadZipFile") and errors["bad.pdf"].startswith("UnicodeDecodeError")
    assert len(c.snapshots()) == before + 1
    files = {r.filename: r for r in c.files(kb).collect()}
    assert [files[n].file_id for n in ("old.xlsx", "a.xlsx", "b.xlsx", "bad.pdf")] == [1, 2, 3, 4] and c.next_ids().first()["next_id"] == 9
    assert {n for n, r in files.items() if r.status == "done"} == {"old.xlsx", "a.xlsx", "b.xlsx", "empty.xlsx", "p.pdf"}
    got = {r.filename: (r.content.rsplit("\n", 1)[-1], len(r.embedding)) for r in c.all_chunks([kb]).collect()}
    assert got["old.xlsx"] == ("| new |", 4) and got["a.xlsx"] == ("| 1 |", 4) and got["p.pdf"][0] == "text" and got["empty.xlsx"][0].startswith("[ExcelEmpty]")
    assert c.chunks(kb, 2).first()["content"].endswith("| 1 |")
    assert c.ingest_all(kb, bytes.decode).count() == 3 and len(c.snapshots()) == before + 2
    assert c.delete_files(kb, spark.createDataFrame([(1,), (2,), (99,), (2,)], "file_id long")) == 2 and c.files(kb).count() == 6
    with pytest.raises(Exception, match="only .pdf"):
        c.save_uploads(kb, spark.createDataFrame([("x.exe", bytearray(b""))], "filename string, content binary"))
    assert c.save_uploads(kb, uploads.where("false")) == 0


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A change that another writer has overtaken is made again; its chunks are written once."""
    c, other = (catalog.Catalog(spark, f"file://{tmp_path}/kb") for _ in range(2))
    kb = c.create_kb("a")
    a, b = c.save_upload(kb, "a.pdf"), c.save_upload(kb, "b.pdf")
    chunks = spark.createDataFrame([(0, "p")], "chunk_index int, content string")
    commit, met = catalog.Catalog._commit, []

    def overtaken(self, state):
        if self is c and len(met) < 2:
            met.append(other.save_upload(kb, f"other{len(met)}.pdf"))
        commit(self, state)

    monkeypatch.setattr(catalog.Catalog, "_commit", overtaken)
    assert c.save_chunks(kb, a, chunks) == 1
    assert met == [3, 4] and {r.filename: r.status for r in c.files(kb).collect()} == {"a.pdf": "done", "b.pdf": "uploaded", "other0.pdf": "uploaded", "other1.pdf": "uploaded"}
    assert len(list((tmp_path / "kb/chunks/kb_id=1").iterdir())) == 1
    monkeypatch.setattr(catalog.Catalog, "_commit", lambda self, state: (_ for _ in ()).throw(catalog.ChangedMeanwhile("always")))
    with pytest.raises(catalog.ChangedMeanwhile):
        c.delete_file(kb, b)


def test_snapshots_and_clean(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/kb")
    kb = c.create_kb("a")
    a = c.save_upload(kb, "a.xlsx", tables.workbook_bytes([("S", [["h"], ["1"]])]))
    for text in ("one", "two", "three"):
        c.save_chunks(kb, a, spark.createDataFrame([(0, text)], "chunk_index int, content string"))
    numbers = c.snapshots()
    assert numbers == [1, 2, 3, 4, 5]
    at = lambda n: [r.content for r in catalog.Catalog(spark, c.path, n).chunks(kb, a).collect()]
    assert [at(n) for n in numbers[1:]] == [[], ["one"], ["two"], ["three"]]
    with pytest.raises(ValueError, match="can't be changed"):
        catalog.Catalog(spark, c.path, 3).create_kb("b")
    assert len(folders(tmp_path)) == 1 + 4 + 1 + 3  # collections, file lists, upload, chunks
    assert c.clean(keep=2) == 2 + 1 and c.snapshots() == [4, 5] and at(4) == ["two"] and at(5) == ["three"]
    with pytest.raises(ValueError, match="no snapshot"):
        at(3)
    c.delete_kb(kb)
    assert c.clean(keep=1) > 0 and folders(tmp_path) == {str(p.relative_to(tmp_path)) for p in tmp_path.glob("kb/kb/*")} and len(folders(tmp_path)) == 1
    assert c.clean(keep=1) == 0 and c.create_kb("b") == 1 and c.all_chunks([1]).count() == 0


def test_gate_reads_registered_tables_only(spark, sf, tmp_path):
    sqlgate.register(spark, sf, ("region",))
    path = f"{sf}/region.parquet"
    allowed = ("select count(*) as n from region", "with x as (select * from region) select count(*) as n from x", "select count(*) as n from REGION where r_name in (select r_name from region)", "select count(*) as n from range(5)")
    assert all(sqlgate.run_query(spark, q).first()["n"] == 5 for q in allowed)
    spark.sql(f"create table if not exists kept using parquet location 'file://{tmp_path}/kept' as select 1 as a")
    refused = (f"select * from parquet.`{path}`", f"select (select count(*) from parquet.`{path}`) as n", f"with x as (select * from parquet.`{path}`) select * from x", "select java_method('java.lang.System', 'getProperty', 'user.home')",
               "select `reflect`('java.lang.System', 'getProperty', 'user.home')", "select transform(r_name) using 'cat' as (x string) from region", "select * from kept", "with x as (select 1 as a) insert\ninto kept select * from x", f"select * from text.`{path}`")
    names = "== Analyzed Logical Plan =="
    refused += (
        f"SELECT '{names}' AS x, r_name FROM parquet.`{path}`", f"SELECT '{names}' AS m, a FROM (SELECT TRANSFORM(r_name) USING 'echo ran' AS (a string) FROM region)",
        f"SELECT r_name FROM IDENTIFIER('parquet.`{path}`')", "SELECT 'CTE [kept]' AS c, a FROM kept", "select identifier('reflect')('java.lang.System', 'getenv', 'HOME')", "select * from default.kept",
        "with kept as (select 1 as a) select * from (select * from spark_catalog.default.kept)", "with x as (select * from kept), kept as (select 1 as a) select * from x", "select * from (with kept as (select 1) select * from kept) join kept",
        "select * from region where exists (select * from kept)", "select * from region order by (select max(a) from kept)", "select max(r_name) over (order by (select a from kept)) from region", "select * from region, lateral (select * from kept)",
        "select transform(array(1), x -> reflect('java.lang.System', 'getenv', 'HOME'))", "select builtin.reflect('java.lang.System', 'getenv', 'HOME')", "select * from sql_keywords()", "select '${env:HOME}'",
        "with recursive r(n) as (select 1 union all select a from kept) select * from r", "select * from region version as of 1",
    )
    for query in refused:
        with pytest.raises(ValueError):
            sqlgate.run_query(spark, query)
    assert spark.table("kept").count() == 1
    for query in ("SELECT 'we reflect' AS n", f"select '{names}' as n", "with kept as (select 5 as n) select n from kept", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select max(n) as n from r",
                  "select n from region lateral view explode(array(5)) t as n", "select n from (values (5)) t(n) where n in (select count(*) from region)", "select x as n from region, lateral (select 5 as x)"):
        assert sqlgate.run_query(spark, query).count() >= 1
    assert sqlgate.open_database(spark, None) == sqlgate.NO_DATABASE and sqlgate.open_database(spark, f"file://{tmp_path}/none").startswith(sqlgate.MISSING_DATABASE) and sqlgate.open_database(spark, sf) is None
    spark.sql("drop table kept")
    assert sqlgate.query_result(spark, allowed[0]) == {"ok": True, "columns": ["n"], "rows": [[5]]} and not sqlgate.query_result(spark, "drop table x")["ok"]


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/kb")
    first, second = c.create_kb("a"), c.create_kb("b", "text")
    c.delete_kb(second)
    assert (first, second, c.create_kb("again")) == (1, 2, 2)
    a, b = c.save_upload(1, "x/../one.pdf"), c.save_upload(1, "two.xlsx")
    assert (a, b, c.save_upload(1, "one.pdf")) == (1, 2, 1)
    with pytest.raises(ValueError):
        c.save_upload(1, "three.exe")
    chunks = spark.createDataFrame([(0, "p", [1.0, 0.0]), (1, "q", None)], "chunk_index int, content string, embedding array<double>")
    c.save_chunks(1, b, chunks, dim=2)
    assert [(f["file_id"], f["chunk_count"], f["status"]) for f in c.files(1).collect()] == [(1, 0, "uploaded"), (2, 2, "done")]
    with pytest.raises(Exception, match="dimensions"):
        c.save_chunks(1, b, chunks, dim=3)
    assert c.chunks(1, b).count() == 2
    assert c.delete_vectors(1, file_id=b) == 1 and c.delete_vectors(1) == 0
    assert c.delete_file(1, b) and not c.delete_file(1, b) and c.chunks(1, b).count() == 0
    assert c.save_upload(1, "new.pdf") == 3
    c.update_kb(1, name="renamed")
    assert {(k["kb_id"], k["name"]) for k in c.list_kbs().collect()} == {(1, "renamed"), (2, "again")}
    assert c.delete_file_global(1) and not c.delete_file_global(99)


def test_paging(spark):
    files = spark.createDataFrame([(i, f"f{i}") for i in range(25)], "file_id long, filename string")
    assert [r["file_id"] for r in catalog.page(files, 2, 10).collect()] == [20, 21, 22, 23, 24]
    with pytest.raises(ValueError):
        catalog.page(files, -1)


def test_sql(spark):
    for q in ("", "delete from t", "select 1; select 2", "explain select 1", "with x as (select 1) delete\nfrom t"):
        verdict = one(spark, sqlgate.verdict, q)
        assert verdict == sqlgate.check_query(q)
    assert sqlgate.run_query(spark, " select 1 as a; ").first()["a"] == 1
    with pytest.raises(ValueError):
        sqlgate.run_query(spark, "select * from no_such_table")
    with pytest.raises(ValueError):
        sqlgate.run_query(spark, "with x as (select 1) delete\nfrom t")


def test_tool_calls(spark):
    rows = [(1, 1, "on_tool_end", "a", None, "x"), (1, 2, "on_tool_start", "a", "r1", None), (1, 3, "on_tool_start", "a", "r2", None), (1, 4, "on_tool_end", "a", None, '{"content": "c"}'),
            (1, 5, "on_tool_error", "a", "r1", "boom"), (1, 6, "on_tool_start", "b", "r3", None)]
    made = events.tool_calls(spark.createDataFrame(rows, "message_id long, seq int, event string, name string, run_id string, text string")).orderBy("position").collect()
    assert [(r["id"], r["state"], r["output"], r["error"]) for r in made] == [("r1", "error", None, "boom"), ("r2", "done", "c", None), ("r3", "open", None, None)]


def calls_by_scan(rows):
    """The fold of one message, event by event."""
    calls = []
    for _, seq, event, name, run, text in sorted(rows, key=lambda r: r[1]):
        if event == "on_tool_start":
            calls.append([run, name, "open", None, None])
            continue
        hit = next((c for c in calls if run is not None and c[0] == run), None)
        hit = hit or next((c for c in reversed(calls) if name is not None and c[1] == name and c[2] == "open"), None)
        if hit:
            failed = event == "on_tool_error"
            hit[2:] = ["error" if failed else "done", None if failed else text, (text or "Tool error") if failed else None]
    return [tuple(c) for c in calls]


def test_tool_calls_by_scan(spark):
    rng, rows = random.Random(9), []
    for message in range(60):
        for seq in rng.sample(range(1000), 40):
            kind = rng.choice(["on_tool_start", "on_tool_start", "on_tool_end", "on_tool_error"])
            rows.append((message, seq, kind, rng.choice(["a", "b", None]), rng.choice([None, None, *[f"r{i}" for i in range(12)]]), rng.choice(["x", "y"])))
    made = events.tool_calls(spark.createDataFrame(rows, "message_id long, seq int, event string, name string, run_id string, text string")).orderBy("message_id", "position").collect()
    for message in range(60):
        got = [(r["id"], r["name"], r["state"], r["output"], r["error"]) for r in made if r["message_id"] == message]
        assert got == calls_by_scan([r for r in rows if r[0] == message])


def test_event_kinds(spark):
    cases = [
        ("on_chat_model_stream", None, '{"chunk": {"content": "hi"}}', ("on_chat_model_stream", "hi", None, None, None)),
        ("on_chat_model_stream", None, '{"chunk": {"content": "", "tool_call_chunks": [{"args": "{"}]}}', ("on_chat_model_stream", "{", None, None, None)),
        ("on_chat_model_stream", None, '{"chunk": {"content": ""}}', None), ("on_llm_new_token", None, '{"token": ""}', ("on_llm_new_token", "", None, None, None)), ("on_llm_new_token", None, '{"token": 3}', None),
        ("on_llm_end", None, '{"output": {"content": ["a"]}}', ("on_llm_end", '["a"]', None, None, None)), ("on_chat_model_end", None, '{"output": {"content": null}}', None),
        ("on_tool_start", "t", "{}", ("on_tool_start", "{}", "t", "", None)), ("on_tool_start", "", "{}", None), ("on_tool_end", "t", '{"output": {"a": 1}}', ("on_tool_end", '{"a":1}', "t", "", None)),
        ("on_tool_error", "t", "{}", ("on_tool_error", None, "t", "", "")), ("error", None, '{"error": "e"}', ("error", None, None, None, "e")), ("error", None, '{"error": ""}', None), ("other", "t", "{}", None), (None, None, None, None),
    ]
    made = events.parse_events(spark.createDataFrame([(e, n, None, d) for e, n, d, _ in cases], "event string, name string, run_id string, data string"))
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str(w) for *_, w in cases if w)
    for value, want in ((None, ""), ("null", ""), ('"a"', "a"), ('["a", {"text": "b"}, {"no": 1}, 3]', "ab3"), ('{"a":1}', '{"a":1}'), ("7", "7")):
        assert one(spark, events.as_text, value) == want


def test_readable_text(spark):
    for chunk in ('{"messages": []}', '{"messages": null}', '{"messages": [1]}', "[]", "{}"):
        assert one(spark, events.readable_text, chunk) == ("" if chunk == "[]" else chunk.replace(" ", ""))
    cases = {'{"answer": "a", "content": "c"}': "a", '["x", {"preview": "p"}, null, {"title": "t"}, 3]': "x\np\nt\n3", "{bad}": "{bad}", "plain": "plain", '{"messages": [{"content": "m"}]}': "m"}
    for chunk, want in cases.items():
        assert one(spark, events.readable_text, chunk) == want
    assert one(spark, events.tool_arguments, json.dumps({"tool_call_chunks": [{"args": "{\"a\""}, {"args": ":1}"}, {"args": None}]})) == '{"a":1}'


def test_sources(spark, tmp_path):
    book = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(book.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "page.html").write_bytes("<p>caf\xe9</p>".encode("latin-1"))
    rows = tables.workbook_rows(tables.files(spark, str(tmp_path), "*.xlsx")).orderBy("row_no").collect()
    assert [(r["sheet"], r["row_no"], r["cells"]) for r in rows] == [("S", 1, ["head", "", "3"]), ("S", 3, ["x"])]
    page = tables.files(spark, str(tmp_path), "*.html").select(T.html_to_text(tables.decoded(F.col("content"))))
    assert page.first()[0] == "café"
    failed = tables.parsed(tables.files(spark, str(tmp_path), "*.html"), lambda data: data.decode("utf-8")).first()
    assert failed["text"] is None and failed["error"].startswith("UnicodeDecodeError")
    uploads = tables.uploads(spark.createDataFrame([("../x/a.pdf", "aGk=")], "name string, content_base64 string")).first()
    assert (uploads["filename"], bytes(uploads["content"]), uploads["size"]) == ("a.pdf", b"hi", 2)
    log = str(tmp_path / "log")
    tables.write_event_log(spark.createDataFrame([(1, "e", "n", "r", "{}")], tables.EVENT), log)
    assert tables.read_event_log(spark, log).count() == 1


def test_lines_and_lengths(spark, tmp_path):
    tables.write_text(spark.createDataFrame([("a\n",), ("b",)], "text string").coalesce(1), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["a", "b"]
    lines = spark.createDataFrame([('0:"hi"',), ('8:"tool"',), ('3:"bad: x"',), ("9:{}",), ("plain",), ("0:{",)], "value string")
    assert [tuple(r) for r in tables.protocol_lines(lines).collect()] == [("text", "hi"), ("tool", "tool"), ("error", "bad: x")]
    assert one(spark, T.utf16_length, "a😀é") == 4 and one(spark, T.listed, "ab\r\n\ncd" + "x" * 40) == "ab cd" + "x" * 23 + "..."


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_log_ranges_read_every_line_once(tmp_path, monkeypatch, size):
    """Ranges and reads of any size; empty lines, lines longer than a range, an unfinished last line."""
    rng = np.random.default_rng(size)
    lines = ["".join(rng.choice(list("aé\t{}"), int(n))) for n in rng.choice([0, 1, 5, 40, 200], 300)]
    data = "\n".join(lines).encode() + b"\nunfinished"
    (tmp_path / "a.log").write_bytes(data)
    monkeypatch.setattr(event_log, "RANGE", size)
    for read in (1, 3, 64, 1 << 20):
        if size == 1 and read == 1:
            continue
        monkeypatch.setattr(event_log, "READ", read)
        reader = event_log.LogReader(str(tmp_path))
        got = [(at, value) for p in reader.partitions() for b in reader.read(p) for at, value in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        assert [v for _, v in got] == [*lines, "unfinished"]
        assert all(data[at : at + len(v.encode())] == v.encode() for at, v in got)
        assert event_log._whole(str(tmp_path), "a.log", 0, len(data)) == len(data) - len("unfinished") == event_log._whole(str(tmp_path), "a.log", 9, len(data))


def test_log_stream_waits_for_the_end_of_a_line(spark, tmp_path):
    """A cut line comes whole in a later micro-batch; a second run goes on where the first ended."""
    event_log.register(spark)
    log = tmp_path / "log"
    log.mkdir()
    stream = tables.event_lines(spark.readStream.format("line_log").load(str(log))).select("ts", "event")
    read = lambda: sorted(tuple(r) for r in folds.run_to_table(stream, f"file://{tmp_path}/out").collect())
    (log / "a.log").write_bytes(b'{"ts": 1, "event": "a"}\nbad\n{"ts": 2, "ev')
    assert read() == [(1, "a")]
    with (log / "a.log").open("ab") as f:
        f.write(b'ent": "b"}\n{"ts": 3')
    (log / "b.log").write_bytes(b'{"ts": 9, "event": "z"}\n')
    (log / "draft-x").write_bytes(b'{"ts": 7, "event": "no"}\n')
    assert read() == [(1, "a"), (2, "b"), (9, "z")]
    assert read() == [(1, "a"), (2, "b"), (9, "z")]
    batch = spark.read.format("line_log").load(str(log))
    assert batch.count() == 5 and tables.event_lines(batch).count() == 3


def test_log_sink_commits_a_batch_once(spark, tmp_path):
    sink = event_log.LogStreamWriter(str(tmp_path))
    rows = lambda *values: iter([{"value": v} for v in values])
    first = [sink.write(rows("a", "b")), sink.write(rows()), sink.write(rows("c"))]
    sink.commit(first, 4)
    again = [sink.write(rows("a", "b", "c")), sink.write(rows())]
    sink.commit(again, 4)
    sink.abort([sink.write(rows("lost"))], 5)
    assert [p.name for p in tmp_path.iterdir()] == ["batch-000000000004-00000.log"] and (tmp_path / "batch-000000000004-00000.log").read_text() == "a\nb\nc\n"
    event_log.register(spark)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    (tmp_path / "in" / "x").write_text("1\n2\n")
    query = source.writeStream.format("line_log").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(str(tmp_path / "log"))
    query.awaitTermination()
    assert sorted(r.value for r in spark.read.format("line_log").load(str(tmp_path / "log")).collect()) == ["1", "2"]
    with pytest.raises(Exception):
        spark.range(1).selectExpr("'x' as value").write.format("line_log").mode("overwrite").save(str(tmp_path / "log"))


def test_stream_of_tool_calls(spark, tmp_path):
    """Calls over several micro-batches: ends by run, twice and by name, timers that let go, and the batch form's result."""
    def start(m, seq, name, run, t):
        return (m, seq, "on_tool_start", name, run, None, 10_000 + t)

    def end(m, seq, name, run, t, text="out", event="on_tool_end"):
        return (m, seq, event, name, run, text, 10_000 + t)

    batches = [
        [start(1, 1, "f", None, 0), start(1, 2, "f", "r", 1), start(2, 1, "g", None, 2), end(1, 3, "g", None, 3)],
        [end(1, 4, "f", None, 4, '{"content": "x"}'), end(1, 5, "g", "r", 5, None, "on_tool_error"), start(1, 6, "f", None, 5), end(1, 7, "f", None, 5)],
        [end(1, 8, "f", None, 6), start(3, 1, "h", None, 600)],
        [start(3, 2, "h", None, 2000), start(4, 1, "x", None, 4000)],
        [end(2, 2, "g", None, 4100)],
    ]
    schema = "message_id long, seq long, event string, name string, run_id string, text string, ts long"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    every = spark.createDataFrame(sum(batches, []), schema)
    stream = spark.readStream.schema(schema.replace("ts long", "ts timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    with folds.rocksdb(spark):
        versions = folds.run_to_table(tool_calls.stream_tool_calls(stream, late="1 second"), f"file://{tmp_path}/long")
        short = folds.run_to_table(tool_calls.stream_tool_calls(stream, expiry=300_000, late="1 second"), f"file://{tmp_path}/short")
    assert rows_text(tool_calls.last_calls(versions)) == rows_text(events.tool_calls(every))
    assert not versions.where("expired").count()
    gone = sorted((r.message_id, r.version) for r in short.where("expired").collect())
    assert (2, 1) in gone and (3, 1) in gone and (4, 1) not in gone
    assert [r.state for r in tool_calls.last_calls(short).where("message_id = 2").collect()] == ["open"]  # its end came too late


def rows_text(table):
    return sorted(str(tuple(r)) for r in table.collect())


def test_stream_keeps_open_windows(spark, tmp_path):
    for i, hours in enumerate((["00:10", "00:20", "01:05"], ["01:40", "01:50"])):
        rows = spark.createDataFrame([(f"2024-01-01 {h}:00", "view", 1.0) for h in hours], "ts string, event_type string, value double")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = folds.tumbling(stream, late="2 hours").select(F.date_format("window.start", "HH").alias("hour"), "event_type", "n")
    versions = folds.run_to_versions(made, f"{tmp_path}/out")
    got = {r.hour: r.n for r in events.last_versions(versions, ["hour", "event_type"], "n").collect()}
    assert got == {"00": 2, "01": 3}


# -- tools


def test_knowledge_tools(spark, tmp_path):
    c, embedder = catalog.Catalog(spark, f"file://{tmp_path}/kb"), vectors.HashEmbedder(64)
    one, two = c.create_kb("a"), c.create_kb("b")
    for kb, texts in ((one, ["river bank", "lake"]), (two, ["river delta"])):
        file_id = c.save_upload(kb, "x.pdf")
        c.save_chunks(kb, file_id, spark.createDataFrame([(i, t, '{"number": "1"}' if i else None) for i, t in enumerate(texts)], "chunk_index int, content string, metadata string"), embedder=embedder)
    single, both = tools.KnowledgeTools(c, [one], embedder), tools.KnowledgeTools(c, [one, 77, two], embedder)
    hits = json.loads(single.query("river"))
    assert [(h["file_id"], h["chunk_index"], h["preview"]) for h in hits][0] == (1, 0, "river bank") and "metadata" not in hits[0] and "kb_id" not in hits[0] and hits[0]["filename"] == "x.pdf"
    assert {(h["kb_id"], h["preview"]) for h in json.loads(both.query("river"))} == {(1, "river bank"), (1, "lake"), (2, "river delta")}
    assert single.query(" ") == "[]" and tools.KnowledgeTools(c, [one]).query("river") != "[]"
    assert single.files_meta([]) == tools.NO_IDS and json.loads(single.files_meta([1, 5, 1])) == [{"id": 1, "filename": "x.pdf", "chunk_count": 2, "status": "done"}]
    assert single.read_chunks([]) == tools.NO_CHUNKS
    read = json.loads(both.read_chunks([{"fileId": 1, "chunkIndex": 1}, {"file_id": "1", "chunk_index": 1}, {"fileId": None}, {"fileId": 9, "chunkIndex": 0}]))
    assert read == [{"file_id": 1, "chunk_index": 1, "filename": "x.pdf", "content": "lake", "metadata": '{"number": "1"}', "kb_id": 1}]
    assert json.loads(single.list_files(0, 5)) == [{"id": 1, "filename": "x.pdf", "chunk_count": 2}] and single.list_files(1, 5) == "[]"
    # a collection that can't be read is skipped, but a single one's failure is seen
    import shutil

    shutil.rmtree(next((tmp_path / "kb/files/1").iterdir()))
    for folder in (tmp_path / "kb/files/1").iterdir():
        shutil.rmtree(folder)
    assert {h["kb_id"] for h in json.loads(both.query("river"))} == {2}
    with pytest.raises(Exception):
        single.query("river")


def test_reranker_switch():
    scorer = lambda content: content.str.len()
    assert all(tools.default_scorer(scorer, {"KB_RERANK": v}) is scorer for v in ("1", "True", " yes "))
    assert all(tools.default_scorer(scorer, s) is None for s in ({}, {"KB_RERANK": "0"}, {"KB_RERANK": ""}))


def test_sql_tools(spark, sf):
    none = tools.SqlTools(spark, None)
    assert json.loads(none.run("select 1"))["error"] == sqlgate.NO_DATABASE and json.loads(none.check("select 1")) == {"ok": True} and not json.loads(none.check("drop table x"))["ok"]
    assert json.loads(tools.SqlTools(spark, f"{sf}/none").list_tables())["error"].startswith(sqlgate.MISSING_DATABASE)
    real = tools.SqlTools(spark, sf)
    assert {"nation", "region"} <= set(json.loads(real.list_tables())) and json.loads(real.schema("region, nope"))["nope"] == []
    assert json.loads(real.run("select r_name, date'2024-01-02' as d from region order by 1 limit 1")) == {"ok": True, "columns": ["r_name", "d"], "rows": [["AFRICA", "2024-01-02"]]}
    assert not json.loads(real.run("select * from parquet.`/x`"))["ok"]


# -- joins on time, sketches, table functions


@pytest.mark.parametrize("first, last", [(0, 0), (5, 4), (-3, 200), (63, 64), (64, 127), (1, 130), (-100, 100_000), (0, 64**3 * 3 + 5), (-(64**4), 64**4 * 2 + 9)])
def test_bins_cover_an_interval_once(spark, first, last):
    got = spark.range(1).select(joins.cover(F.lit(first).cast("long"), F.lit(last).cast("long"))).first()[0]
    spans = sorted((b.bin * 64**b.level, (b.bin + 1) * 64**b.level - 1) for b in got)
    assert len(spans) <= 2 * 64 * joins.LEVELS + 64 * 3
    if first > last:
        assert not spans
        return
    assert spans[0][0] == first and spans[-1][1] == last and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_points_in_intervals_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    stamp = lambda s: None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=float(s))
    spans = [(i, int(rng.integers(0, 3)), s := float(rng.integers(0, 5000)), s + float(rng.choice([0, 1, 59, 600, 90_000, -5]))) for i in range(120)] + [(500, 1, None, 5.0), (501, None, 0.0, 9e6)]
    points = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 9000))) for i in range(300)] + [(900, 0, None), (901, None, 1.0), (902, 1, 4_000_000.0)]
    left = spark.createDataFrame([(i, k, stamp(a), stamp(b)) for i, k, a, b in spans], "id long, k int, start timestamp, stop timestamp")
    right = spark.createDataFrame([(i, k, stamp(t)) for i, k, t in points], "id long, k int, at timestamp")
    for keys in ((), ("k",)):
        for width in (1, 45, 86_400):
            got = joins.points_in_intervals(left, right, "start", "stop", "at", width, keys).select("interval.id", F.col("point.id").alias("p")).collect()
            want = [(i, p) for i, k, a, b in spans for p, q, t in points if None not in (a, t) and a <= t < b and (not keys or (k is not None and k == q))]
            assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_latest_before_equals_a_scan(spark, parts):
    """Keys that fill many ranges, keys in one, ties in time, null keys and times."""
    rng = np.random.default_rng(parts)
    key = lambda: [None, 1, 1, 1, 1, 1, 2, 3][rng.integers(0, 8)]
    left = [(i, key(), None if rng.random() < 0.05 else int(rng.integers(0, 40))) for i in range(200)]
    right = [(1000 + i, key(), None if rng.random() < 0.05 else int(rng.integers(5, 40))) for i in range(40)] + [(7, 9, 1)]
    a, b = spark.createDataFrame(left, "id long, k int, t long"), spark.createDataFrame(right, "id long, k int, t long")
    got = joins.latest_before(a, b, "k", "t", "id", parts).collect()
    want = {(i, k, t): max(((u, j) for j, l, u in right if None not in (k, t, u) and l == k and u <= t), default=None) for i, k, t in left}
    assert len(got) == len(left) and all((r.latest and tuple(r.latest)) == want[r.id, r.k, r.t] for r in got)


def test_sketches_merge(spark):
    """A collection's bounds from its files', the exact counts within; a file written again replaces its own."""
    rows = spark.range(60_000).select((F.col("id") % 7).alias("file"), (F.col("id") % 20_000).alias("user"), F.sqrt("id").alias("value"), F.lit("kb").alias("kb"))
    files = sketches.of_files(rows, ["kb", "file"], F.col("user"), F.col("value"))
    low, high = sketches.distinct_bounds(F.col("distinct_sketch"))
    shown = lambda s: sketches.merged(s, ["kb"]).select("rows", low.alias("low"), high.alias("high"), *[c.alias(n) for r in (10, 50, 99) for c, n in zip(sketches.quantile_bounds(F.col("value_sketch"), r / 100), (f"a{r}", f"b{r}"))]).first()
    whole = shown(files)
    assert whole.rows == 60_000 and whole.low <= 20_000 <= whole.high and whole.high - whole.low < 4000
    assert all(whole[f"a{r}"] <= (600 * r) ** 0.5 <= whole[f"b{r}"] for r in (10, 50, 99))
    fresh = sketches.of_files(rows.where("file = 3").withColumn("user", F.col("user") + 100_000), ["kb", "file"], F.col("user"), F.col("value"))
    again = shown(sketches.replaced(files, fresh, ["kb", "file"]))
    exact = rows.select(F.when(F.col("file") == 3, F.col("user") + 100_000).otherwise(F.col("user")).alias("u")).distinct().count()
    assert again.rows == 60_000 and again.low <= exact <= again.high and exact > 20_000


def test_table_functions(spark):
    texts = ["", "  ", None, "x" * 500, " é" * 700, "[Sheet] A\n| a |\n\n[Sheet]  B b \n| c |", "one\n\ntwo\n" + "long " * 20]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("some_texts")
    names = table_functions.register(spark)
    run = lambda q: [tuple(r) for r in sqlgate.run_query(spark, q, names).collect()]
    got = run("SELECT id, chunk_index, content FROM some_texts, LATERAL split_text(text, 'fixed', 300, 50) ORDER BY id, chunk_index")
    assert got == [(i, n, w) for i, t in enumerate(texts) for n, w in enumerate(windows(t or "", 300, 50))]
    assert run("SELECT sheet, content FROM some_texts, LATERAL split_text(text, 'sheets') ORDER BY sheet") == [("A", "| a |"), ("B b", "| c |")]
    parts = run("SELECT line, content FROM some_texts, LATERAL split_text(text, 'lines', 12) WHERE id = 6 ORDER BY chunk_index")
    assert parts == [(0, "one\n\ntwo"), (3, "long " * 20)]
    assert sqlgate.run_query(spark, "SELECT * FROM some_texts, LATERAL split_text(text, 'lines')", names).columns == ["id", "text", "chunk_index", "content", "line"]
    for bad in ("SELECT * FROM some_texts, LATERAL split_text(text, text)", "SELECT * FROM some_texts, LATERAL split_text(text, 'other')"):
        with pytest.raises(ValueError):
            run(bad)
    with pytest.raises(ValueError):
        sqlgate.run_query(spark, "SELECT * FROM some_texts, LATERAL split_fixed(text)")
