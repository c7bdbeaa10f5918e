"""SimHash near-duplicates: pigeonring candidate search and connected components of close fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.llm.common import cut, give_back, hot_join, slices, table
from terrafuse.operators.graph import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
#: Segments of the ring, and how many of them the chain behind a join key spans. Ten segments and
#: chains of four give 20 keys of about 19 bits; chains of seven give 90 keys of about 32 bits, for
#: corpora of more than some hundred million distinct fingerprints. Both find every link.
SEGMENTS = 10
CHAIN, LONG_CHAIN = 4, 7
#: From so many distinct fingerprints on the longer chain is taken, unless one is asked for: shorter keys would be crowded.
CROWDED = 1 << 26
#: Fingerprints that share a key are compared in blocks of this many; larger groups are cut in
#: blocks, and every pair of blocks is a group of its own.
BLOCK = 2048

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for null texts and texts without words."""
    return int(_fingerprint((text or "").encode(), shingle))


def _fingerprint(raw: bytes, shingle: int) -> np.uint64:
    # bytes.split() parts at exactly the six separators of the word definition
    words = raw.translate(_LOWER).split()
    if not words:
        return np.uint64(0)
    n = max(1, len(words) - shingle + 1)
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, _HASHES_AT_ONCE):
        part = words[lo : lo + _HASHES_AT_ONCE + shingle - 1]
        joined, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part]).tolist()
        starts = [0, *ends[:-1]]
        h = np.fromiter(
            (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(shingle, len(part)) - 1 :], strict=False)),
            np.uint64,
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                out = np.fromiter((_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed long."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


class Ring:
    """Segments of the 64 bits on a ring, and the keys that a pair within the distance must share.

    If two fingerprints differ in at most t bits, some rotation of the m segment distances has all
    its prefix sums within l * t / m (pigeonring principle). Along the first `chain` segments of
    that rotation most segments must be equal; each way of choosing the unequal ones gives a key of
    the equal ones, and a pair within the distance shares at least one key.
    """

    def __init__(self, distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN):
        if not 0 <= distance < segments <= BITS or not 1 <= chain <= segments:
            raise ValueError("need 0 <= distance < segments <= 64 and 1 <= chain <= segments")
        self.distance, self.segments = distance, segments
        edges = [i * BITS // segments for i in range(segments + 1)]
        self.spans = [(edges[i], edges[i + 1] - edges[i]) for i in range(segments)]
        budget = [(n * distance) // segments for n in range(segments + 1)]
        odd = [
            set(c)
            for k in range(budget[chain] + 1)
            for c in combinations(range(chain), k)
            if all(sum(p < n for p in c) <= budget[n] for n in range(1, chain + 1))
        ]
        odd = [c for c in odd if not any(c < d for d in odd)]
        self.keys = [(s, [(s + p) % segments for p in range(chain) if p not in c]) for s in range(segments) for c in odd]
        if max(sum(self.spans[i][1] for i in kept) for _, kept in self.keys) > 48:
            raise ValueError("a key must fit 48 bits: use a shorter chain")
        whole = [((1 << w) - 1) << o for o, w in self.spans]
        #: masks[start, n - 1]: the bits of the first n segments from start
        self.masks = np.array(
            [[sum(whole[(s + j) % segments] for j in range(n)) for n in range(1, segments + 1)] for s in range(segments)], np.uint64
        )
        self.budget = np.array(budget[1:], np.uint8)
        self.start = np.array([s for s, _ in self.keys], np.int64)

    def key_columns(self, fp: Column) -> Column:
        """Array of the join keys of a fingerprint: the key's number over its bits."""
        out = []
        for number, (_, kept) in enumerate(self.keys):
            key, at = F.lit(number << 48).cast("long"), 0
            for i in kept:
                offset, width = self.spans[i]
                piece = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
                key, at = key.bitwiseOR(F.shiftleft(piece, at)), at + width
            out.append(key)
        return F.array(*out)

    def close(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Indices of the pairs that pass the chain from their start segment and lie within the distance."""
        x, at = a ^ b, np.arange(len(a))
        for n in range(self.segments):  # the last chain is the whole ring: the full Hamming check
            ok = np.bitwise_count(x & self.masks[start, n]) <= self.budget[n]
            if not ok.all():
                x, start, at = x[ok], start[ok], at[ok]
        return at


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) that join the same fingerprints as u-v do."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != (hop := new[new])).any():
            new = hop
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(ring: Ring, small: int = 96):
    """Links between the fingerprints of each group; rows come ordered by group."""

    def of_large(fps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
        rest, found, queue = fps[1:], [], [fps[0]]
        while len(rest) or queue:
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            u = queue.pop()
            near = np.zeros(len(rest), bool)
            near[ring.close(np.full(len(rest), u), rest, np.full(len(rest), start))] = True
            if near.any():
                found.append((np.full(int(near.sum()), u), rest[near]))
                queue.extend(rest[near])
                rest = rest[~near]
            if not len(rest):
                break
        return found

    def of_rows(key: np.ndarray, group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        size = np.diff(edge)
        found = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        number = key >> 48
        for i in np.flatnonzero(size > small):
            found += of_large(np.unique(fp[edge[i] : edge[i + 1]]), int(ring.start[number[edge[i]]]))
        little = (size <= small) & (size > 1)
        end = np.repeat(edge[1:], size)
        at = np.flatnonzero(np.repeat(little, size))
        for step in range(1, int(size[little].max(initial=1))):
            at = at[at + step < end[at]]
            near = ring.close(fp[at], fp[at + step], ring.start[number[at]])
            found.append((fp[at[near]], fp[at[near] + step]))
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        return _forest(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            key, i, j, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "fp"))
            now = (key, np.stack([key, i, j], axis=1), fp.view(np.uint64))
            now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(now[0]):
                continue
            same = (now[1] == now[1][-1]).all(axis=1)
            cut_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = tuple(x[cut_at:] for x in now)
            if cut_at:
                yield links(tuple(x[:cut_at] for x in now))
        if held is not None and len(held[0]):
            yield links(held)

    def links(rows) -> pa.RecordBatch:
        key, group, fp = rows
        change = np.r_[True, (group[1:] != group[:-1]).any(axis=1)]
        u, v = of_rows(key, np.cumsum(change), fp)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def close_links(fps: DataFrame, ring: Ring | None = None, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints (column fp, distinct) that links within the distance connect.

    Inside a group that shares a key only a spanning forest of its links is returned, so a large
    group of near copies does not give all its pairs. A group of over `block` members is dealt out in
    blocks: each pair of blocks is one group, so no group has over 2 * block members or so and no
    pair is left out.
    """
    ring = ring or Ring()
    keyed = fps.select("fp", F.explode(ring.key_columns(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    large = large.select("key", F.ceil(F.col("count") / block).alias("blocks"))
    rows = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_links(ring), "u long, v long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
    chain: int | None = None,
) -> DataFrame:
    """Every document's fingerprint and the smallest id of its group of near copies.

    Groups are the components of fingerprints that differ in at most `distance` bits. Null and blank
    texts have fingerprint 0 and are linked like any other. Documents of the same fingerprint are
    one node, so exact copies cost no pairs. Repeated rows come back repeated; a null id never names
    a group unless the group has no other. Other columns are not read. The chain (None: chosen by the number of
    distinct fingerprints) sets the length of the join keys and never the links.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    ring = Ring(distance, segments, chain or (CHAIN if nodes.count() < CROWDED else LONG_CHAIN))
    parts = connected_components(close_links(nodes, ring))
    labels = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("part"))
    labels = cut(labels)
    # one component may hold most fingerprints, and one fingerprint most documents
    firsts = cut(labels.groupBy("part").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    named = cut(hot_join(labels.drop("first_id"), firsts, "part").select("fp", "copies", "component_id"))
    return hot_join(fps, named, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id.

    Rows whose id is null cannot be told apart and stay. Rows that repeat an id count as one document;
    one row of them stays.
    """
    found = cut(near_duplicates(docs, id_col, text_col).where("doc_id = component_id").groupBy("doc_id").count())
    keep = found.select(F.col("doc_id").alias(id_col))
    kept = docs.where(docs[id_col].isNotNull()).join(keep, id_col, "left_semi")
    if not found.where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.select(docs.columns).unionByName(docs.where(docs[id_col].isNull()))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
