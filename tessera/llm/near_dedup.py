"""Near-dedup: circulant MinHash signatures, banding, candidate groups, exact Jaccard within them in blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, filled, hash_words, mixed, ragged, rolling, slices, stored, word_array, word_ids

SHINGLE = 5
#: Bands x rows. A pair of similarity 0.8 is missed with probability (1 - 0.8^4)^28 = 4e-7, one of 0.85 with 1e-9.
BANDS, ROWS = 28, 4
#: Members of a candidate group that one task compares with each other or with those of another block.
BLOCK = 2048
#: Up to this many rows (16 bytes each) are broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 2_000_000


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct word shingles, ascending, and where each text's start.

    A text of fewer words has its whole sequence as one shingle; one without words has none."""
    words, first = word_array(texts)
    number, distinct = word_ids(words)
    h = hash_words(distinct)[number]
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    run = rolling(h, size)
    flat = run[ragged(first[:-1], many)] if len(run) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), many)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        whole = np.array([mixed(np.array([int.from_bytes(hashlib.blake2b(h[a : a + k].tobytes(), digest_size=8).digest(), "little")], np.uint64))[0] for a, k in zip(first[few], n[few])], np.uint64)
        flat, doc = np.concatenate([flat, whole]), np.concatenate([doc, few])
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    flat, doc = flat[new], doc[new]
    return flat, np.searchsorted(doc, np.arange(len(n) + 1))


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(flat: np.ndarray, starts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: the first permutation sigma places an element on a circle of 2^32,
    coordinate k is the smallest pi(sigma + k) of a set, pi being the second permutation shifted by k."""
    place = (mixed(flat ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    sizes = np.diff(starts)
    out = np.empty((len(sizes), size), np.uint32)
    step = 1 << 15  # elements at a time, so that they stay in the cache
    cut = 0
    while cut < len(sizes):
        end = max(cut + 1, int(np.searchsorted(starts, starts[cut] + step, "right")) - 1)
        part, at = place[starts[cut] : starts[end]], starts[cut:end] - starts[cut]
        for k in range(size):
            out[cut:end, k] = np.minimum.reduceat(_pi(part + np.uint32(k)), at)
        cut = end
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _sketch(batches):
    for part in slices(batches):
        flat, at = shingles(filled(part.column("text")))
        n = np.diff(at)
        full = np.flatnonzero(n)
        starts = np.concatenate([at[full], at[-1:]])
        rows = bands(signatures(flat, starts)) if len(full) else np.empty((0, BANDS), np.int64)
        digest = [None] * len(n)
        for k in full.tolist():
            digest[k] = hashlib.blake2b(flat[at[k] : at[k + 1]].tobytes(), digest_size=16).digest()
        lengths = np.zeros(len(n), np.int32)
        lengths[full] = BANDS
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), lists], names=["doc_id", "text_key", "n_shingles", "digest", "bands"]
        )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (node, root), root the smallest node; alternating large and small
    stars until nothing changes. Only minima and joins, so a node with many edges is split like any skewed key."""
    spark = edges.sparkSession
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = stored(small.distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one that it is linked with through links among these sets."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(flat)]]))
    common = np.zeros((m, m), np.float32)
    # elements of few sets: all their pairs; of many: a matrix product
    for f in range(2, min(16, m) + 1):
        at = first[count == f]
        if len(at):
            who = owner[at[:, None] + np.arange(f)]
            for i in range(f):
                for j in range(i + 1, f):
                    np.add.at(common, (who[:, i], who[:, j]), 1)
    common += common.T
    wide = np.flatnonzero(count > 16)
    step = max(64, (1 << 23) // m)
    for i in range(0, len(wide), step):
        own = wide[i : i + step]
        hold = np.zeros((m, len(own)), np.float32)
        hold[owner[ragged(first[own], count[own])], np.repeat(np.arange(len(own)), count[own])] = 1
        common += hold @ hold.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        low = np.where(linked, label[None, :], m).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(table: pa.Table, percent: int) -> pa.Table:
    table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
    node = table.column("node").to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    label = _links(sets, percent)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": node[moved], "v": node[label[moved]]})


def text_key(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classes(sketch: DataFrame) -> DataFrame:
    """A row for each distinct set: digest, the row that stands for it (id, key) and a 64-bit number (node) that no
    other class has: the digest's hash, hashed again while two classes share one."""
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    made = sketch.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("r"))
    made = stored(made.select("digest", "r.id", "r.key", F.xxhash64("digest").alias("node")), "classes")
    while not (shared := made.groupBy("node").count().where("count > 1").select("node", F.lit(True).alias("twice"))).isEmpty():
        node = F.when(F.col("twice"), F.xxhash64("node", "digest")).otherwise(F.col("node"))
        made = stored(made.join(shared, "node", "left").select("digest", "id", "key", node.alias("node")), "classes")
    return made


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of 5-word shingles (A-Z lower-cased) satisfy
    100 * intersection >= percent * union. Returns a row per document: id, n_shingles, component_id (the smallest
    id reachable, itself included), kept (whether that is its own) and text_key (tells rows of one id apart).

    1. Signatures: 112 circulant MinHash coordinates in 28 bands of 4. Documents with one set form a class,
       represented by one of its rows with the smallest id, so exact copies never meet in a band.
    2. Candidate groups: each band links its representatives to the smallest of them (one edge a member, never
       all pairs); groups are the components of these edges, so every pair that shares a band is in one group.
    3. Exact verification on full sets of 64-bit shingle hashes: a task compares all members of a group, or
       two blocks of 2048 where it is larger, by set intersections in numpy, and emits a forest (at most one
       edge a member). No pair of a group is skipped and none is emitted.
    4. Components of the verified links.

    Null, empty and blank texts have no shingles and are linked with nothing. A row's place depends on its own
    text, whatever its id: rows of one id with different texts may stand in different components. Repeated rows
    are equal sets; both keep the id. Null ids are larger than any other: in a component that has an id, their
    rows go; in one that has none, component_id is null and the rows of one text (that of the smallest hash)
    stay. An empty table gives an empty result; other columns are ignored. Everything between the steps is
    written to the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), ascii_lower(F.col(text_col)).alias("text"))
    sketch = stored(rows.mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"), "sketch")
    classes = _classes(sketch)
    # the representatives' bands; repeated rows collapse in the distinct edges
    own = sketch.where("digest IS NOT NULL").join(classes, "digest").where("doc_id <=> id AND text_key = key").select("node", F.explode("bands").alias("band"))
    own = stored(own, "bands")
    hubs = own.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("band", "hub")
    edges = own.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    groups = components(edges)
    member = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    member = member.join(size, "root").join(classes, "node")
    member = stored(member.select("node", "root", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "id", "key"), "members")
    few = member.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(member) if few else member, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))

    def sets(batches):
        for part in slices(batches):
            flat, at = shingles(filled(part.column("text")))
            data = [flat[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), part.column("blocks"), pa.array(data, pa.binary())], names=["node", "root", "blocks", "shingles"])

    full = met.select("node", "root", "blocks", "text").mapInArrow(sets, "node long, root long, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    full = full.withColumn("b", block).select("node", "root", "shingles", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    tasks = full.groupBy("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    # a representative's row repeated in the table comes twice; it links to itself, which changes nothing
    links = tasks.applyInArrow(lambda t: _compare(t, percent), "u long, v long")
    found = components(links)
    linked = found.union(found.select(F.col("root").alias("node"), "root").distinct()).join(classes, "node")
    ends = linked.groupBy("root").agg(F.min("id").alias("low"), F.min("key").alias("least"))
    linked = linked.select("node", "root").join(ends, "root").select("node", "low", "least", F.lit(True).alias("linked"))
    named = classes.join(linked, "node", "left").select("digest", F.when(F.col("linked"), F.col("low")).otherwise(F.col("id")).alias("low"), F.coalesce("least", "key").alias("least"))
    out = sketch.join(named, "digest", "left")
    alone = F.col("digest").isNull()
    kept = F.when(alone, True).when(F.col("low").isNull(), F.col("text_key") == F.col("least")).otherwise(F.col("doc_id").eqNullSafe(F.col("low")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"), kept.alias("kept"), "text_key")


def brute_force(rows: list[tuple[int, str | None]], percent: int) -> list[tuple[int, int, int, bool]]:
    """The same on a small list, by all pairs of sets of word tuples."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(upper).encode().split()
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        met: dict[int, int] = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    smallest: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)] = min((x for x in (doc, smallest.get(find(i))) if x is not None), default=None)
    return [(doc, len(s), smallest[find(i)], doc == smallest[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]
