"""Vector codes, line dedup and the filter audit against brute force."""

import collections
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, filter_audit, line_dedup, queries, vector_codes
from tests.llm.samples import blank_words, documents, embeddings, empty, labels, lowered, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


# 11


def plain_codes(rows, parts, entries, rounds, scale):
    """(vec_id, code, error) of every row and the codebooks, one distance at a time."""
    whole = [(i, [math.floor(x * scale) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(r for r in whole if r[0] is not None)
    if not first:
        return [], []
    dim = len(first[0][1])
    whole, width = [r for r in whole if len(r[1]) == dim], dim // parts
    first = [r for r in first if len(r[1]) == dim][:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    assign = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = collections.defaultdict(list)
            for _, v in whole:
                held[assign(cut(v)[p], book)[1]].append(cut(v)[p])
            for e, own in held.items():
                book[e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, v in whole:
        best = [assign(part, book) for part, book in zip(cut(v), books)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, [x for book in books for entry in book for x in entry]


@pytest.mark.parametrize("parts, entries, rounds", [(16, 64, 2), (4, 7, 3), (1, 1, 0), (2, 40, 1)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    table = embeddings(spark)
    books = vector_codes.train(table, parts, entries, rounds)
    made = vector_codes.label_errors(vector_codes.encode(table, books)).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    want, flat = plain_codes(rows, parts, entries, rounds, 256)
    assert books.entries.reshape(-1).tolist() == flat
    assert sorted(str((r.vec_id, r.code, r.error)) for r in made) == sorted(map(str, want))
    by_label = collections.Counter()
    for r in made:
        by_label[r.label] += r.error
    assert all(r.label_error == by_label[r.label] for r in made) and None in by_label


@pytest.mark.parametrize("width, most, n", [(4, 3, 64), (4, 60_000, 64), (1, 5, 200), (16, vector_codes.LARGEST - 1, 64), (3, 0, 64)])
def test_tree_finds_the_nearest_entry(width, most, n):
    """Ties, equal entries, points on the border of a ball, and the largest components."""
    rng = np.random.default_rng(width)
    book, points = rng.integers(-most, most + 1, (n, width)), rng.integers(-most, most + 1, (3000, width))
    points = np.concatenate([points, book, (book + np.roll(book, 1, 0)) // 2])
    code, distance = vector_codes.nearest(vector_codes.tree(book), book, points)
    all_distances = ((points[:, None] - book[None]) ** 2).sum(2)
    assert np.array_equal(code, all_distances.argmin(1)) and np.array_equal(distance, all_distances.min(1))


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error double, _n int"
    none = spark.createDataFrame([], schema)
    assert vector_codes.train(none) is None
    assert vector_codes.train(spark.createDataFrame([(1, None, 1, "", 0.0, 1), (2, [float("nan")] * 16, 1, "", 0.0, 1), (3, [], 1, "", 0.0, 1)], schema)) is None
    same = spark.createDataFrame([(1, [0.5] * 16, 1, "x", 1.0, 1)] * 9, schema)
    books = vector_codes.train(same)
    made = vector_codes.label_errors(vector_codes.encode(same, books)).collect()
    assert len(made) == 9 and {(r.code, r.error, r.label_error) for r in made} == {("00" * 16, 0, 0)}
    assert np.allclose(vector_codes.decode(pa.array([made[0].code]), books), 0.5, atol=1 / 256)
    with pytest.raises(ValueError):
        vector_codes.train(spark.createDataFrame([(1, [0.5] * 15, 1, "x", 1.0, 1)], schema))
    with pytest.raises(ValueError):
        vector_codes.train(spark.createDataFrame([(1, [1e30] * 16, 1, "x", 1.0, 1)], schema))


# 12


def plain_lines(held, least_length=40, least_documents=5):
    key = lambda line: lowered(line.strip(" \t\n\v\f\r"))
    found = collections.defaultdict(set)
    for r in held:
        for line in (r.text or "").split("\n"):
            found[key(line)].add(-1 if r.doc_id is None else r.doc_id)
    out = []
    for r in held:
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_length or len(found[key(x)]) < least_documents or r.doc_id == max(found[key(x)])]
        out.append((r.doc_id, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def line_rows():
    rng = np.random.default_rng(9)
    shared = [f"this line is shared by a number of documents {i}" for i in range(12)] + ["É" * 40, "é" * 39, "x" * 39, "short"]
    rows = []
    for i in range(60):
        lines = [shared[j] for j in rng.choice(len(shared), 5)] + [f"a line that is long enough but only here {i}"]
        lines = [x.upper() if rng.random() < 0.3 else f" \t{x}\r" if rng.random() < 0.3 else x for x in lines]
        rows.append((None if i % 13 == 5 else i // 2 if i < 20 else i, "\n".join(lines), "en", "s", 0))
    return rows + [(100, None, None, None, None), (101, "", None, None, None), (102, "\n\n", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("batches", [1, 2, 4, 9])
def test_lines_equal_brute_force(spark, docs, batches):
    for table in (spark.createDataFrame(line_rows(), DOCS), docs):
        made = line_dedup.deduplicated_lines(table, batches=batches).collect()
        got = [(r.doc.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in made]
        assert sorted(map(str, got)) == sorted(map(str, plain_lines(table.collect())))
        assert set(made[0].doc.asDict()) == set(table.columns) - {"text"}


def test_lines_joined_by_a_shuffle_and_in_salted_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    table = spark.createDataFrame(line_rows(), DOCS)
    made = line_dedup.deduplicated_lines(table).select("doc.doc_id", "n_lines", "n_dropped").collect()
    assert sorted(map(str, map(tuple, made))) == sorted(str(r[:3]) for r in plain_lines(table.collect()))


def test_runs_are_levelled(spark):
    """The runs after each batch: few tables, every key once a run, one keeper a key, no shuffle of a run."""
    rng = np.random.default_rng(3)
    with line_dedup.LineRuns(spark, fanout=3) as runs:
        first, count = {}, collections.Counter()
        for i in range(10):
            pairs = {(100 * i + int(d), int(k)) for d, k in zip(rng.integers(0, 20, 60), rng.integers(0, 50, 60))}
            runs.add(spark.createDataFrame([(d, k, -k) for d, k in pairs], "doc_id long, h0 long, h1 long"))
            own = collections.defaultdict(set)
            for d, k in pairs:
                own[k].add(d)
            for k, ids in own.items():
                first.setdefault(k, max(ids))
                count[k] += len(ids)
            assert all(len(level) < 3 for level in runs.levels)
            got = {r.h0: (r.n, r.keeper) for r in runs.totals().collect()}
            assert got == {k: (count[k], first[k]) for k in count}
        assert sum(map(len, runs.levels)) <= 4
        plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan or len(runs.runs()) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_no_lines(spark):
    assert line_dedup.deduplicated_lines(empty(spark)).count() == 0


# 13


def plain_audit(held, marks):
    words = {id(r): blank_words(r.text) for r in held}
    firsts = {}
    for r in held:
        if r.doc_id is not None:
            firsts[r.text or ""] = min(firsts.get(r.text or "", r.doc_id), r.doc_id)

    def fails(r):
        text, w = r.text or "", words[id(r)]
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": r.doc_id is not None and firsts[text] < r.doc_id,
        }

    good = {m.doc_id for m in marks if m.quality == 1}
    toxic = {m.doc_id for m in marks if m.toxic == 1}
    rows = [(r.source or "", fails(r), r.doc_id in good and r.doc_id is not None, r.doc_id in toxic and r.doc_id is not None) for r in held]
    out, shapley = [], collections.Counter()
    for part in sorted({r[0] for r in rows}):
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            everyone = list(alive)
            for step, f in enumerate(order, 1):
                gone, alive = [r for r in alive if r[1][f]], [r for r in alive if not r[1][f]]
                failing = [r for r in everyone if r[1][f]]
                shapley[part, f] += len(gone)
                only = sum(sum(r[1].values()) == 1 for r in failing)
                out.append((part, "".join(order), step, len(alive), len(gone), len(failing) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit_equals_brute_force(spark, docs):
    marks = labels(spark)
    made = filter_audit.audit(filter_audit.marked(filter_audit.failures(docs), marks))
    assert made.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = plain_audit(docs.collect(), marks.collect())
    assert rows_of(made) == sorted(map(str, want))
    assert any(r[7] for r in want) and any(r[8] for r in want)
    assert filter_audit.audit(filter_audit.marked(filter_audit.failures(empty(spark)), marks)).count() == 0


def test_audit_walks_every_state_once(spark, docs, monkeypatch):
    states = []
    count = filter_audit.Walk._count
    monkeypatch.setattr(filter_audit.Walk, "_count", lambda self, state, applied, rest: (states.append(applied), count(self, state, applied, rest)))
    filter_audit.audit(filter_audit.marked(filter_audit.failures(docs), labels(spark)))
    assert len(states) == len(set(states)) == 31  # the state after all five has no edge
    assert [len(s) for s in states[:5]] == [0, 1, 2, 3, 4]


def test_audit_of_other_filters(spark):
    """Three filters of the caller's own."""
    rows = spark.createDataFrame([("p", True, False, True, False, False), ("p", False, False, True, True, False), ("q", False, False, False, False, True)], "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    made = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, "XYZ").collect()}
    assert len(made) == 2 * 6 * 3
    assert made["p", "XYZ", 1].removed == 1 and made["p", "XYZ", 3].removed == 1 and made["p", "ZXY", 2].redundant == 1 and made["p", "ZXY", 1].good_lost == 1
    assert made["p", "XYZ", 3].shapley == 3 + 6 and made["p", "ZYX", 3].shapley == 3 and made["q", "XYZ", 3].kept == 1


# all


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_release_leaves_no_folder(name, spark, sf):
    from pathlib import Path

    common.release(spark)
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("*")) if shared.exists() else set()
    queries.QUERIES[name](spark, sf).count()
    common.release(spark)
    assert set(shared.glob("*")) <= before


def test_scopes_belong_to_threads(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    opened, ended = Event(), Event()

    def outer():
        with common.scratch(spark):
            table = common.saved(spark.range(2), "scope")
            opened.set()
            assert ended.wait(60)
            return table.count()  # the other thread's scope has ended, this one has not

    def inner():
        assert opened.wait(60)
        with common.scratch(spark):
            n = common.saved(spark.range(1), "scope").count()
        ended.set()
        return n

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(outer), pool.submit(inner)
        assert (first.result(90), second.result(90)) == (2, 1)
