"""Near copies by SimHash: candidates from fingerprints and their strongest bits, exact similarity of word shingles, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafuse.llm import simhash
from terrafuse.llm.common import cut, give_back, slices, tidy
from terrafuse.operators.graph import connected_components

SHINGLE = 5
#: Least similarity of near copies, as a ratio of whole numbers.
LEAST = (4, 5)
SEED = 42
#: A SimHash of ROTATIONS * 64 words of 64 bits: signs of the set's shingles along random directions. The last two words are the
#: fingerprint. Of each other word the strongest bit (its number and sign) is one of WORDS parts of a key, and each set has KEYS keys.
ROTATIONS, WORDS, KEYS = 6, 3, 116
#: Sets of similarity 0.8 have a word's strongest bit in common with probability 0.44 or more (measured), so that no key of a pair is equal
#: with probability (1 - 0.44 ** WORDS) ** KEYS = 3e-5. Their 128 bits of fingerprint differ in 19.3 +- 4.1 bits, unlike ones in 64 +- 5.7.
DISTANCE = 40
#: Keys are joined in so many passes, each of which frees its shuffle.
PASSES = 4
#: Sets are compared in blocks of about this many shingles together; a component of more candidates is dealt out.
GRAMS = 1 << 20
#: Keys of more than BLOCK sets, as one in SAMPLE of them tells, are dealt out in pairs of blocks; at most HOT_KEYS, whose blocks are broadcast.
BLOCK, SAMPLE, HOT_KEYS = 2048, 16, 10_000

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 63, ROTATIONS, np.uint64)
_ODD = _RNG.integers(0, 1 << 63, ROTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNS = _RNG.choice(np.array([-1, 1], np.float32), (ROTATIONS, 2, 64, 64))
_HADAMARD = reduce(np.kron, [np.array([[1, 1], [1, -1]], np.float32)] * 6)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `shingle` lower-cased words; a shorter text is one run, one without words none."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)], np.uint64))


def projections(grams: list[np.ndarray], rotation: int) -> np.ndarray:
    """64 words of 64 sums for each set: its shingles along random directions, whose signs are the bits of its SimHash.

    Shingles are hashed to 4096 signed counters, which random signs and Hadamard transforms of rows, columns and rows again turn into the sums.
    """
    flat = (np.concatenate(grams) ^ _FLIP[rotation]) * _ODD[rotation]
    at = np.repeat(np.arange(len(grams)) << 12, [len(g) for g in grams]) + (flat >> np.uint64(52)).astype(np.int64)
    x = np.bincount(at, 1.0 - 2.0 * ((flat >> np.uint64(51)) & np.uint64(1)), len(grams) << 12).astype(np.float32).reshape(-1, 64, 64)
    return (_HADAMARD @ ((x @ _HADAMARD) * _SIGNS[rotation, 0])) * _SIGNS[rotation, 1] @ _HADAMARD


def sketches(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys (KEYS a set, 21 bits each) and the fingerprint (two words) of each set."""
    codes, prints = [], []
    for lo in range(0, len(grams), 256):
        parts = []
        for r in range(ROTATIONS):
            x = projections(grams[lo : lo + 256], r)
            top = np.abs(x).argmax(axis=2)
            parts.append(top * 2 + (np.take_along_axis(x, top[:, :, None], 2)[:, :, 0] < 0))
        codes.append(np.concatenate(parts, axis=1)[:, : WORDS * KEYS].reshape(-1, KEYS, WORDS) @ (128 ** np.arange(WORDS)))
        prints.append(np.packbits(x[:, -2:] > 0, axis=2).reshape(-1, 16).view(np.uint64))
    return np.concatenate([np.empty((0, KEYS), np.int64), *codes]), np.concatenate([np.empty((0, 2), np.uint64), *prints])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def _nodes(grams: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in grams], np.uint64).view(np.int64))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            grams = [shingles(t) for t in part.column("text").to_pylist()]
            keys, prints = sketches(grams)
            ends = pa.array(np.arange(len(grams) + 1, dtype=np.int32) * KEYS)
            lists = pa.ListArray.from_arrays(ends, pa.array(keys.astype(np.int32).ravel()))
            f0, f1 = (pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(2))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _nodes(grams), pa.array([len(g) for g in grams], pa.int64()), f0, f1, lists], ["doc_id", "node", "n", "f0", "f1", "keys"])
    give_back()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            grams = [shingles(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_nodes(grams), _lists(grams)], ["node", "items"])
    give_back()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("a"), batch.column("b"))]
        of = lambda k, i: ends[k][1][ends[k][0][i] : ends[k][0][i + 1]]
        common = np.fromiter((len(np.intersect1d(of(0, i), of(1, i), assume_unique=True)) for i in range(len(batch))), np.int64, len(batch))
        every = np.array([len(of(0, i)) + len(of(1, i)) for i in range(len(batch))], np.int64) - common
        yield pa.RecordBatch.from_arrays(
            [batch.column("u"), batch.column("v"), pa.array(common * LEAST[1] >= every * LEAST[0]), pa.array(1 - common / np.maximum(every, 1))],
            ["u", "v", "alike", "d"],
        )
    give_back()


def judge(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, alike, d) of pairs (u, v): whether their sets reach the similarity, and their Jaccard distance."""
    # written down, so that the joins deal out both sides anew and can split a node with very many pairs
    pairs = cut(pairs.distinct())
    side = lambda n, s: sets.select(F.col("node").alias(n), F.col("items").alias(s))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")
    return cut(both.mapInArrow(_judged, "u long, v long, alike boolean, d double"))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the ordered rows (equal in the named columns), with the edges between groups."""
    held: list[pa.RecordBatch] = []

    def starts(rows) -> np.ndarray:
        changed = np.zeros(rows.num_rows, bool)
        changed[:1] = True
        for name in names:
            column = rows.column(name).to_numpy() if isinstance(rows, pa.Table) else rows.column(name).to_numpy(zero_copy_only=False)
            changed[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(changed)

    def out() -> Iterator[tuple[pa.Table, np.ndarray]]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield rows, np.r_[starts(rows), rows.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts(batch)[-1])
        if last:
            held.append(batch.slice(0, last))
        if last or (held and any(held[-1].column(n)[-1] != batch.column(n)[0] for n in names)):
            yield from out()
            held = []
        held.append(batch.slice(last))
    yield from out()


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= DISTANCE


def _close(batches: Iterator[pa.RecordBatch], small: int = 96) -> Iterator[pa.RecordBatch]:
    """Links that join what fingerprints within DISTANCE join in each group."""
    for rows, edge in _groups(batches, ["key", "i", "j"]):
        node = rows.column("node").to_numpy().view(np.uint64)
        prints = np.stack([rows.column(f).to_numpy().view(np.uint64) for f in ("f0", "f1")], axis=1)
        size, found = np.diff(edge), [(node[:0], node[:0])]
        for g in np.flatnonzero(size > small):
            rest, queue = np.arange(edge[g], edge[g + 1]), []
            while len(rest):
                if not queue:
                    queue, rest = [rest[0]], rest[1:]
                u = queue.pop()
                near = _near(prints[rest], prints[u])
                if near.any():
                    found.append((np.full(int(near.sum()), node[u]), node[rest[near]]))
                    queue.extend(rest[near])
                    rest = rest[~near]
        little = (size <= small) & (size > 1)
        end, at = np.repeat(edge[1:], size), np.flatnonzero(np.repeat(little, size))
        for step in range(1, int(size[little].max(initial=1))):
            at = at[at + step < end[at]]
            near = at[_near(prints[at], prints[at + step])]
            found.append((node[near], node[near + step]))
        u, v = simhash._forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    give_back()


def candidates(nodes: DataFrame, passes: int = PASSES) -> DataFrame:
    """Links (u, v) that connect all sets (node, f0, f1, keys) whose pairs are to be compared.

    They are the pairs whose first words of fingerprint lie within op1's distance, all of which its pigeonring search finds, and the pairs within
    DISTANCE bits that share a key: at similarity 0.8 most fingerprints differ in more bits than any exact search of them can allow.
    """
    firsts = cut(nodes.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("node")))
    ring = simhash.close_links(firsts)
    name = lambda end: firsts.select(F.col("fp").alias(end), F.col("node").alias(f"n{end}"))
    ring = ring.distinct().join(name("u"), "u").join(name("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    same = nodes.select("node", F.col("f0").alias("fp")).join(firsts.withColumnRenamed("node", "u"), "fp").where("u <> node").select("u", F.col("node").alias("v"))
    found, each = [cut(ring.union(same))], -(-KEYS // passes)
    for lo in range(0, KEYS, each):
        tidy(nodes.sparkSession)
        keyed = nodes.select("node", "f0", "f1", F.posexplode(F.slice("keys", lo + 1, each)).alias("pos", "code"))
        keyed = keyed.select((F.col("pos").cast("long") * (1 << 7 * WORDS) + F.col("code")).alias("key"), "node", "f0", "f1")
        hot = keyed.where(F.pmod("node", F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > BLOCK)
        hot = hot.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key", F.ceil(F.col("n") * SAMPLE / BLOCK).cast("int").alias("blocks"))
        rows = keyed.join(F.broadcast(cut(hot)), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "f0", "f1")
        found.append(cut(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_close, "u long, v long").distinct()))
    return reduce(DataFrame.union, found)


def _of_group(node: np.ndarray, part: np.ndarray, guest: np.ndarray, ends: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of similar sets that join what all similar pairs of different parts join; with guests, of pairs of a guest and one that is none."""
    ids = np.unique(items, return_inverse=True)[1]
    mark, size = np.zeros(int(ids.max(initial=-1)) + 1, bool), np.diff(ends)

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(size[rows]) - size[rows]
        return ids[np.repeat(ends[rows] - starts, size[rows]) + np.arange(int(size[rows].sum()))], starts

    def alike(u: int, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mark[ids[ends[u] : ends[u + 1]]] = True
        common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[ids[ends[u] : ends[u + 1]]] = False
        return rows[common * LEAST[1] >= (size[u] + size[rows] - common) * LEAST[0]]

    if guest.any():
        rest = np.flatnonzero(~guest)
        got = gather(rest)
        for u in np.flatnonzero(guest) if len(rest) else ():
            near = alike(u, rest, *got)
            near = near[part[near] != part[u]]
            yield from ((int(node[u]), int(node[x])) for x in near[np.unique(part[near], return_index=True)[1]])
        return
    rest, queue, got = np.arange(len(node)), [], None
    while len(rest):
        if not queue:
            own = part[rest] == part[rest[0]]
            queue, rest, got = list(rest[own]), rest[~own], None
            continue
        u = queue.pop()
        got = got or gather(rest)
        near = alike(u, rest, *got)
        if len(near):
            reached, firsts = np.unique(part[near], return_index=True)
            yield from ((int(node[u]), int(node[x])) for x in near[firsts])
            moved = np.isin(part[rest], reached)
            queue.extend(rest[moved])
            rest, got = rest[~moved], None


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, edge in _groups(batches, ["component", "block"]):
        node, part, guest = (rows.column(c).to_numpy() for c in ("node", "part", "guest"))
        lists = rows.column("items").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends, items, found = lists.offsets.to_numpy(), lists.values.to_numpy(), []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                found += _of_group(node[a:b], part[a:b], guest[a:b], ends[a : b + 1] - ends[a], items[ends[a] : ends[b]])
        u, v = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    give_back()


def links(members: DataFrame, small: int | None = None) -> DataFrame:
    """Links (u, v) that connect exactly the sets (component, node, items) that all similar pairs within a component connect.

    A component of up to GRAMS shingles (and `small` sets, if given) is one group. A larger one is dealt out in blocks, first at random again and
    again, as long as that halves what is not joined to the component's largest part; what is then left is compared with every block.
    """
    sizes = members.groupBy("component").agg(F.sum(F.size("items")).alias("grams"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("grams") / GRAMS), F.ceil(F.col("n") / small) if small else F.lit(1)).cast("int")
    large = cut(sizes.select("component", blocks.alias("blocks")).where("blocks > 1"))  # at most one for each GRAMS of all shingles
    rows = members.join(F.broadcast(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = lambda df, salt: df.withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int"))

    def compared(df: DataFrame) -> DataFrame:
        df = df.select("component", "block", "node", "part", "guest", "items").repartition("component", "block").sortWithinPartitions("component", "block")
        return cut(df.mapInArrow(_linked, "u long, v long"))

    found, before = compared(dealt(rows.withColumn("part", F.col("node")).withColumn("guest", F.lit(False)), 0)), None
    if large.isEmpty():
        return found
    crowd = members.join(F.broadcast(large), "component")
    for salt in count(1):
        parts = connected_components(found).withColumnRenamed("component", "part")
        named = cut(crowd.select("component", "blocks", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
        largest = named.groupBy("component", "part").count().groupBy("component").agg(F.max(F.struct("count", "part")).alias("b"))
        off = named.join(F.broadcast(largest.select("component", F.col("b.part").alias("top"))), "component").withColumn("guest", F.col("part") != F.col("top"))
        off = cut(off.drop("top"))
        left = off.where("guest").count()
        if not left:
            return found
        open_ = off.join(F.broadcast(off.where("guest").select("component").distinct()), "component", "left_semi")
        sets = members.select("node", "items")
        if before is None or 2 * left <= before:
            before, again = left, dealt(open_.withColumn("guest", F.lit(False)), salt).join(sets, "node")
            found = cut(found.union(compared(again)))
            continue
        hosts = dealt(open_.withColumn("guest", F.lit(False)), salt)
        guests = open_.where("guest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return cut(found.union(compared(hosts.unionByName(guests).join(sets, "node"))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int | None = None) -> DataFrame:
    """docs with one document, that of the smallest id, of each component of texts with five-word similarity 0.8 or more.

    Candidates come from SimHash fingerprints and keys of their strongest bits, and all pairs of a component of candidates are compared by
    their exact Jaccard similarity. Texts of the same shingles are one node; so are those without words. Rows whose id is
    null stay; rows that repeat an id are one document.
    """
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    seen = cut(rows.mapInArrow(_sketched, f"doc_id {id_type}, node long, n long, f0 long, f1 long, keys array<int>"))
    repeats = not seen.groupBy("doc_id").count().where("count > 1").isEmpty()
    firsts = seen.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "f0", "f1", "keys")])
    nodes = cut(firsts)
    del seen, firsts
    near = connected_components(candidates(nodes.where("n > 0")))
    named = cut(nodes.select("node", "first_id").join(near, "node", "left"))
    del nodes
    tidy(docs.sparkSession)
    compared = named.where("component is not null")
    sets = rows.join(compared.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_whole, "node long, items array<long>")
    members = cut(sets.join(compared.select("node", "component"), "node").dropDuplicates(["node"]).select("component", "node", "items"))
    parts = connected_components(links(members, small)).withColumnRenamed("component", "part")
    labelled = named.select("node", "first_id").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    keep = cut(labelled.groupBy("part").agg(F.min("first_id").alias(id_col)).select(id_col).distinct())
    del members, named, labelled, parts
    tidy(docs.sparkSession)
    known = docs.where(docs[id_col].isNotNull())
    kept = known.join(keep, id_col, "left_semi")
    if repeats:
        kept = kept.dropDuplicates([id_col])
    return kept.select(docs.columns).unionByName(docs.where(docs[id_col].isNull()))
