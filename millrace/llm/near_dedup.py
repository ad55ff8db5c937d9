"""Near-duplicate groups by b-bit MinHash.

Each text's set of word shingles gives HASHES minima. Bands of minima deal texts into buckets; of every minimum two
low bits of a hash stay, packed into longs, and bit counts estimate the similarity of bucket mates, corrected for
chance agreement. Pairs that may reach the bound are confirmed on their full shingle sets, and links are closed into
connected components.

No bucket is expanded into all its pairs: texts with equal sets are one node; in each bucket the nodes are first
compared with one pivot only: its hub, the node whose buckets are the largest (the original of many edited copies).
Afterwards just those bucket mates are compared that are not yet in one component, block by block within a task: first
by their packed bits, then on full sets for those nodes that have a likely partner at all. So a large group of copies
makes a few rows a member and no link between groups is lost. At the default bands a pair at the bound itself shares
no bucket with probability 1.2e-7. Keys that many rows share (buckets, hubs, equal sets) are joined in salted parts.

Texts with fewer words than a shingle are one shingle of all their words; null texts and texts without words are empty
and linked with nothing. Rows without doc_id are linked with nothing either (component null, kept). Repeated rows get
equal results; an empty table gives an empty result; other columns of the input are not carried by
`near_duplicates`. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, pieces

BANDS, ROWS = 40, 5
#: Minima whose two low bits are packed, 32 to a long; the first BANDS * ROWS of them form the bands.
HASHES = 512
LONGS = HASHES // 32
#: How far below the bound an estimate may lie: 5.5 standard deviations of HASHES two-bit agreements at 0.8.
SLACK = 0.115
SIGNATURE = [f"s{i}" for i in range(LONGS)]
#: About how many nodes, and how many shingles of theirs, a block of bucket mates holds.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
WORDS_CACHED = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PARAMETERS = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = (_PARAMETERS[:HASHES] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
OFFSETS = (_PARAMETERS[HASHES:] >> np.uint64(32)).astype(np.uint32)[:, None]


class WordHashes(dict):
    """Hashes of words met before, for as long as a task lasts."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(self) >= WORDS_CACHED:
            self.clear()
        self[word] = value
        return value


def shingle_sets(texts: pa.StringArray, k: int, known: WordHashes) -> Iterator[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased."""
    if not len(texts):
        return
    units = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    codes, offsets = units.flatten().dictionary_encode(), units.offsets.to_numpy()
    distinct = codes.dictionary.to_pylist()
    hashes = np.fromiter(map(known.__getitem__, distinct), np.uint64, len(distinct))
    index = codes.indices.to_numpy()
    full = np.array([bool(w) for w in distinct], bool)[index] if len(index) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(full)])[offsets]  # blanks at a text's ends leave empty units
    words = hashes[index[full]] if len(index) else hashes
    for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
        n = stop - start
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        width = min(k, n)
        rolled = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[start + j : stop - width + 1 + j])
        yield np.unique(rolled)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(best, (low[i : i + 4096] * FACTORS + OFFSETS).min(axis=1), out=best)
    return best


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    pieces.forget()
    names, known = ["doc_id", "text_hash", "n_shingles", "k0", "k1", "bands", *SIGNATURE], WordHashes()
    places = np.arange(HASHES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        at = 0
        for texts in pieces.slices(batch.column(2)):
            keys, n, k0, k1 = [batch.column(i).slice(at, len(texts)) for i in (0, 1)], [], [], []
            low = np.empty((len(texts), HASHES), np.uint32)
            for i, s in enumerate(shingle_sets(texts, k, known)):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                k0.append(digest & (1 << 63) - 1)
                k1.append(digest >> 64 & (1 << 63) - 1)
                low[i] = minima(s)
            mixed = _mix(low.astype(np.uint64) + places)
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for r in range(ROWS):
                bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + mixed[:, r : BANDS * ROWS : ROWS])
            bits = (mixed >> np.uint64(62)).reshape(len(texts), LONGS, 32)
            packed = (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).reshape(-1)))
            columns = [*keys, pa.array(n, pa.int64()), pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(LONGS)]], names)
            at += len(texts)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, set size, a 126-bit key of the set, band hashes and the packed low bits of every row."""
    schema = "doc_id long, text_hash long, n_shingles long, k0 long, k1 long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return common.map_batches(rows, lambda batches: _signatures(batches, k), schema)


def estimate(a: str, b: str) -> Column:
    """Similarity from the agreement of two-bit minima: agreement is J + (1 - J) / 4."""
    differ = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return ((1 - differ / HASHES) - 0.25) / 0.75


def _meet(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (node, pivot) with the columns of both, those of the node as a_ and of the pivot as b_. A node has few
    pivots, a pivot may have many nodes. The pivots' sets have no bound that would allow a broadcast; the narrow pairs
    and counts are broadcast where their counted rows allow it, so that the wide columns are dealt by pivot only."""
    own = [c for c in nodes.columns if c != "node"]
    left = common.maybe_broadcast(pairs).join(nodes.select("node", *[F.col(c).alias(f"a_{c}") for c in own]), "node")
    counts = common.maybe_broadcast(common.saved(pairs.groupBy("pivot").agg(F.count("*").alias("_n")), "dedup-counts"))
    right = common.saved(counts.join(nodes.select(F.col("node").alias("pivot"), *[F.col(c).alias(f"b_{c}") for c in own]), "pivot"), "dedup-pivots")
    return common.salted_join(left, right.hint("merge"), ["pivot"], "node", "_n")


def full_sets(due: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, items) for every node of `due`: the sorted hashes of its shingles, made again from the texts that are
    needed only."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            at = 0
            for texts in pieces.slices(batch.column(1)):
                sets = list(shingle_sets(texts, k, known))
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
                keys = [pa.array([d & (1 << 63) - 1 for d in digests], pa.int64()), pa.array([d >> 64 & (1 << 63) - 1 for d in digests], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *keys, lists], ["id", "k0", "k1", "items"])
                at += len(texts)

    due = common.saved(nodes.select("node", "id", "k0", "k1").join(due, "node"), "dedup-due")
    ids = common.maybe_broadcast(due.select(F.col("id").alias("doc_id")).distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(ids, "doc_id", "left_semi")
    made = common.map_batches(rows, make, "id long, k0 long, k1 long, items array<long>")
    # these keys name a node as well, and the join has dealt the sets by them: no second shuffle
    sets = made.join(due, ["id", "k0", "k1"]).dropDuplicates(["id", "k0", "k1"]).select("node", "items")
    return common.saved(sets, "dedup-sets")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (node, pivot), as (a, b), whose full shingle sets are similar enough."""
    sets = full_sets(pairs.select(F.explode(F.array("node", "pivot")).alias("node")).distinct(), nodes, docs, k)
    both = F.size(F.array_intersect("a_items", "b_items"))
    either = F.size("a_items") + F.size("b_items") - both
    return _meet(pairs, sets).where(100 * both >= percent * either).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def _members(blocks: pa.ListScalar) -> dict[str, np.ndarray | pa.Array]:
    """Columns of the members of one or two blocks, by node."""
    held = blocks.values.flatten()
    order = np.argsort(held.field("node").to_numpy(), kind="stable")
    return {f.name: (a if pa.types.is_list(f.type) else a.to_numpy()) for f, a in ((f, held.field(f.name).take(pa.array(order))) for f in held.type)}


def _likely_later(m: dict, signs: np.ndarray, i: int, percent: int) -> np.ndarray:
    """The members after i, of other components, that may be similar enough to it, the likeliest first."""
    n, root = m["n"], m["root"]
    later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
    later = later[100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i])]
    x = signs[later] ^ signs[i]
    agree = 1 - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64) / HASHES
    guess = (agree - 0.25) / 0.75
    near = guess >= percent / 100 - SLACK
    return later[near][np.argsort(-guess[near], kind="stable")]


def _with_partner(m: dict, percent: int) -> np.ndarray:
    """The nodes that have a likely partner in another component."""
    signs, due = np.stack([m[c].view(np.uint64) for c in SIGNATURE], 1), np.zeros(len(m["node"]), bool)
    for i in range(len(due) - 1):
        later = _likely_later(m, signs, i, percent)
        due[later] = True
        due[i] |= len(later) > 0
    return m["node"][due]


def _shared_sizes(m: dict, i: int, others: np.ndarray) -> np.ndarray:
    """How many shingles the set of member i shares with each of the others."""
    values, ends = m["values"], m["ends"]
    own, sizes = values[ends[i] : ends[i + 1]], ends[others + 1] - ends[others]
    starts = np.cumsum(sizes) - sizes
    asked = values[np.repeat(ends[others] - starts, sizes) + np.arange(sizes.sum())]
    found = own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked
    return np.add.reduceat(found, starts, dtype=np.int64)


def _joining(m: dict, percent: int) -> list[tuple[int, int]]:
    """Links that join components: the full sets of likely pairs that are not joined yet are compared, those of one
    member with all others at once."""
    signs, node, root = np.stack([m[c].view(np.uint64) for c in SIGNATURE], 1), m["node"], m["root"]
    m |= {"values": m["items"].flatten().to_numpy().view(np.uint64), "ends": np.concatenate([[0], np.cumsum(pc.list_value_length(m["items"]).to_numpy())])}
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := above.get(x, x)) != x:
            x = up
        return x

    out = []
    for i in range(len(node) - 1):
        later = _likely_later(m, signs, i, percent)
        own = find(int(root[i]))
        later = later[np.array([find(r) != own for r in root[later].tolist()], bool)]
        if not len(later):
            continue
        both = _shared_sizes(m, i, later)
        sizes = np.diff(m["ends"])
        for j in later[100 * both >= percent * (sizes[i] + sizes[later] - both)].tolist():
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[j])))
    return out


def _block_pairs(members: DataFrame) -> DataFrame:
    """(blocks): for every group `first` of the rows, each block of its members with itself or with a later block, as an
    array of one or two arrays of members. Blocks hold about BLOCK_NODES members or BLOCK_SHINGLES shingles, so there are
    as many rows as there are small groups, and for a large one the square of its blocks."""
    size = F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)
    # each of these groups fills a block at least
    large = members.groupBy("first").agg(F.ceil(size).cast("int").alias("_blocks")).where("_blocks > 1")
    large = common.maybe_broadcast(common.saved(large, "dedup-large"))
    dealt = members.join(large, "first", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    packed = dealt.groupBy("first", "_blocks", block.alias("_block")).agg(F.collect_list(F.struct(*[c for c in members.columns if c != "first"])).alias("held"))
    single = packed.where("_blocks = 1").select(F.array("held").alias("blocks"))
    other = packed.where("_blocks > 1").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pairs = other.groupBy("first", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j")).agg(F.collect_list("held").alias("blocks"))
    return single.unionByName(pairs.select("blocks"))


def join_mates(placed: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between bucket mates of different components, for rows (band, node, root, size).

    Buckets with one smallest node form a group, so a node that shares many bands with the same mates is in few groups.
    Pairs of blocks of a group are one task's work whose result is at most a link for each node: the number of rows
    grows with the nodes, not with the pairs.
    """
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("first"), F.count("*").alias("size")).where("x <> y")
    mixed = common.saved(mixed.select("band", "first", "size"), "dedup-mixed")
    members = common.salted_join(placed, mixed, ["band"], "node", "size").select("first", "node", "root").distinct()
    signed = common.saved(members.join(nodes.select("node", "n", *SIGNATURE), "node"), "dedup-open")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_with_partner(_members(blocks), percent), pa.int64())], ["node"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column(0):
                found = _joining(_members(blocks), percent)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    due = common.saved(common.map_batches(_block_pairs(signed), partners, "node long").distinct(), "dedup-partners")
    sets = full_sets(due, nodes, docs, k)
    return common.map_batches(_block_pairs(signed.join(sets.hint("merge"), "node")), links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge (a, b), root the smallest node of its connected component: alternating
    large and small stars until the edges are stars and stay so."""
    edges = common.saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "stars")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == state or not now["n"]:
            break
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = common.saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars-least")
        large = common.salted_join(both.where("v > u"), least, ["u"], "v", "n").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = common.saved(large, "stars-large")
        least = common.saved(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "stars-least")
        # every smaller neighbour but the smallest, and the node itself, move to the smallest
        moved = common.salted_join(large, least, ["b"], "a", "n").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = common.saved(moved.union(least.select(F.col("m").alias("a"), "b")).distinct(), "stars")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _hubs(shared: DataFrame) -> DataFrame:
    """(band, hub, size) for the buckets in rows (band, node, size): the hub is the node whose buckets are the largest."""
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    chosen = shared.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("size"))
    return chosen.select("band", F.col("hub.node").alias("hub"), "size")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the smallest doc_id of the group, and the group (null: linked with nothing)."""
    made = common.saved(signatures(docs, k), "dedup-signatures")
    linkable = made.where("n_shingles > 0 and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("bands", *SIGNATURE)]
    nodes = linkable.groupBy("k0", "k1").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"), *firsts)
    nodes = common.saved(nodes.withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")

    rows = nodes.select("node", F.explode("bands").alias("band"))
    sizes = common.saved(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.col("size")), "dedup-sizes")
    shared = common.saved(common.salted_join(rows, sizes, ["band"], "node", "n"), "dedup-buckets")
    met = common.salted_join(shared.select("band", "node"), common.saved(_hubs(shared), "dedup-hubs"), ["band"], "node", "size")
    pairs = common.saved(met.select("node", F.col("hub").alias("pivot")).where("node <> pivot").distinct(), "dedup-met")
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    likely = (100 * small >= percent * large) & (estimate("a_", "b_") >= percent / 100 - SLACK)
    pairs = common.saved(_meet(pairs, nodes.select("node", "n", *SIGNATURE)).where(likely).select("node", "pivot"), "dedup-pairs")
    links = common.saved(confirm(pairs, nodes, docs, k, percent), "dedup-links")
    roots = common.saved(components(links), "dedup-roots")

    # bucket mates that are not in one component yet
    placed = shared.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    more = common.saved(join_mates(placed, nodes, docs, k, percent), "dedup-more")
    if more.limit(1).count():
        roots = common.saved(components(links.union(more)), "dedup-roots")

    smallest = nodes.select("node", "id", "k0", "k1", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = common.saved(smallest, "dedup-placed")
    groups = common.saved(smallest.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "dedup-groups")
    by_set = common.saved(common.salted_join(smallest, groups, ["root"], "node", "n").select("k0", "k1", "root", "component_id", "rows"), "dedup-sets-placed")
    keys = ["doc_id", "text_hash", "n_shingles"]
    linked = common.salted_join(linkable.select(*keys, "k0", "k1"), by_set, ["k0", "k1"], "doc_id", "rows")
    alone = made.where("n_shingles = 0 or doc_id is null").select(*keys, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.select(*keys, "component_id", "root").union(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept for every row."""
    with common.scratch(docs.sparkSession):
        rows = _grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id")
        return common.saved(rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates", lasting=True)


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The input with one row of every group: that of the smallest doc_id, and of several such rows the one with the
    smallest text hash. Rows that are linked with nothing stay: without doc_id all, else one for each doc_id and text."""
    with common.scratch(docs.sparkSession):
        # rows are known by doc_id and text, so two texts under one doc_id are told apart
        decided = common.saved(_grouped(docs, k, percent).where("doc_id is not null").select("doc_id", "text_hash", "root"), "dedup-decided")
        first = F.min(F.struct("doc_id", "text_hash"))
        kept = common.saved(decided.where("root is not null").groupBy("root").agg(first.alias("first"), F.count("*").alias("n")), "dedup-first")
        named = common.salted_join(decided.where("root is not null"), kept, ["root"], "doc_id", "n")
        gone = named.where(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash").distinct()
        gone = common.saved(gone.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "dedup-gone", lasting=True)
        again = decided.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    # the input stays in one struct, so its columns can have any names
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))
    hashed = docs.select(row.alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    stay = hashed.join(common.maybe_broadcast(gone), (F.col("own_id") == F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_anti")
    if again:
        stay = stay.where("own_id is not null").dropDuplicates(["own_id", "own_hash"]).unionByName(stay.where("own_id is null"))
    return stay.select("row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), k=2)


#: Prefix filter: two sets at 0.8 or more share one of the (n - ceil(0.8 n) + 1) rarest shingles of each.
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS items FROM t),
nodes AS MATERIALIZED (SELECT row_number() OVER () AS node, min(doc_id) AS id, items, len(items) AS n FROM sets WHERE doc_id IS NOT NULL AND len(items) > 0 GROUP BY items),
e AS MATERIALIZED (SELECT node, n, unnest(items) AS item FROM nodes),
often AS (SELECT item, count(*) AS df FROM e GROUP BY item),
ranked AS (SELECT node, n, item, row_number() OVER (PARTITION BY node ORDER BY df, item) AS place FROM e JOIN often USING (item)),
rare AS MATERIALIZED (SELECT node, n, item FROM ranked WHERE place <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM rare a JOIN rare b ON a.item = b.item AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
sized AS (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.items, y.items)) AS both_have FROM pairs JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b),
links AS MATERIALIZED (SELECT a, b FROM sized WHERE 100 * both_have >= 80 * (n - both_have)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node WHERE reach.root < ways.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
placed AS (SELECT node, items, min(id) OVER (PARTITION BY root) AS least_id FROM roots JOIN nodes USING (node))
SELECT doc_id, len(sets.items)::BIGINT AS n_shingles, coalesce(least_id, doc_id)::BIGINT AS component_id,
       doc_id IS NOT DISTINCT FROM coalesce(least_id, doc_id) AS kept
FROM sets LEFT JOIN placed ON placed.items = sets.items AND doc_id IS NOT NULL
"""
