"""Mixing sources to target weights: token weights raked to marginals, then calibrated sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafuse.llm.common import cut, fresh, give_back, slices, table, words_of

MARGINS = ("source", "lang", "topic")
#: Targets of a margin without given weights: each value's share of tokens to this power. Below 1 lifts the rare ones.
TEMPERATURES = {"source": 0.8, "lang": 0.6, "topic": 0.9}
#: Share of all tokens to sample.
FRACTION = 0.5
SEED = 23
ROUNDS, TOLERANCE = 200, 1e-8
#: Up to so many cells are raked in the driver's memory (a few MB); more by the same steps as a table.
DRIVER_CELLS = 100_000
NONE = "(none)"
#: Topics of a language, the size of the hashed term vectors that they are clusters of, and the rounds of the clustering at most.
TOPICS, TERMS, TOPIC_ROUNDS = 4, 512, 12
#: One in the fixed point of vectors that are summed up.
FIXED = 1 << 24


def _term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed terms (a row a text, as float32) and the number of words of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts.fill_null(""))))
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    bucket = np.fromiter((xxhash.xxh32_intdigest(w, SEED) % TERMS for w in names), np.int64, len(names))
    real = np.fromiter((bool(w) for w in names), bool, len(names))
    at = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    row, at = row[real[at]], at[real[at]]
    counts = np.bincount(row * TERMS + bucket[at], minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
    return counts.astype(np.float32), np.bincount(row, minlength=len(texts))


@dataclass
class Topics:
    """Clusters of hashed terms of one language: weights of the terms and the clusters' centers."""

    weights: np.ndarray
    centers: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return (self.vectors(counts) @ self.centers.T).argmax(axis=1)


def topic_numbers(models: dict[str, Topics], langs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The topic of each text among those of its language (0 for a language without a model); -1 for a text without words."""
    out = np.zeros(len(counts), np.int64)
    for lang in set(langs):
        at = np.flatnonzero(langs == lang)
        if lang in models and len(at):
            out[at] = models[lang].of(counts[at])
    return np.where(counts.any(axis=1), out, -1)


def _packed(counts: np.ndarray) -> pa.Array:
    """The terms of each text that are there, as count * TERMS + term in eight bytes each."""
    row, col = np.nonzero(counts)
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(counts)))] * 8
    values = counts[row, col].astype(np.uint64) * np.uint64(TERMS) + col.astype(np.uint64)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _unpacked(terms: pa.Array) -> np.ndarray:
    values = np.frombuffer(b"".join(terms.to_pylist()), np.uint64).astype(np.int64)
    counts = np.zeros((len(terms), TERMS), np.float32)
    counts[np.repeat(np.arange(len(terms)), pc.binary_length(terms).to_numpy() // 8), values % TERMS] = values // TERMS
    return counts


def _counted(rows: DataFrame, read: str, terms: str, tokens: str) -> DataFrame:
    """rows with the terms and the number of words of the text in the column read, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                counts, n = _term_counts(part.column(read))
                rest = part.drop_columns([read])
                yield pa.RecordBatch.from_arrays([*rest.columns, _packed(counts), pa.array(n, pa.int64())], [*rest.schema.names, terms, tokens])
        give_back()

    fields = [*rows.drop(read).schema.fields, T.StructField(terms, T.BinaryType()), T.StructField(tokens, T.LongType())]
    return rows.mapInArrow(run, T.StructType([T.StructField(x.name, x.dataType) for x in fields]))


def _totals(vectors: DataFrame, models: dict[str, Topics], step: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language, over all its texts (h, lang, terms) with words: a text that is drawn, sums and numbers of texts by topic.

    Without a model the sums are the numbers of texts that hold a term. With one they are those of the vectors in fixed point, which come out the same
    in any order, and a text is drawn the likelier the less it is like the centers.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, len(batch), 2048)):
                langs, counts = np.array(part.column("lang").to_pylist(), object), _unpacked(part.column("terms"))
                h = part.column("h").to_numpy().view(np.uint64) ^ np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                race = -np.log(((h >> np.uint64(11)) + 1.0) / ((1 << 53) + 2.0))
                real = counts.any(axis=1)
                for lang in set(langs[real]):
                    at = np.flatnonzero(real & (langs == lang))
                    if lang in models:
                        x = models[lang].vectors(counts[at])
                        near = x @ models[lang].centers.T
                        own, key = near.argmax(axis=1), race[at] / (np.maximum(1 - near.max(axis=1), 0) ** 2 + 1e-12)
                        values = np.rint(x * float(FIXED)).astype(float)
                    else:
                        own, key, values = np.zeros(len(at), int), race[at], (counts[at] > 0).astype(float)
                    belongs = (own[None, :] == np.arange(TOPICS)[:, None]).astype(float)
                    sums, n = (belongs @ values).astype(np.int64).ravel(), belongs.sum(axis=1).astype(np.int64)
                    first = int(key.argmin())
                    best = (float(key[first]), part.column("terms")[int(at[first])].as_py())
                    old = found.get(lang)
                    found[lang] = [best, sums, n] if old is None else [min(old[0], best), old[1] + sums, old[2] + n]
        rows = [(lang, *best, sums, n) for lang, (best, sums, n) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)
        give_back()

    def merged(table: pa.Table) -> pa.Table:
        best = min(zip(table["race"].to_pylist(), table["drawn"].to_pylist(), strict=True))
        sums, n = (np.sum([x.values.to_numpy() for x in table[c]], axis=0) for c in ("sums", "n"))
        return pa.table([pa.array(list(c), k) for c, k in zip(([table["lang"][0].as_py()], [best[0]], [best[1]], [sums], [n]), kinds, strict=True)], names)

    names, kinds = ["lang", "race", "drawn", "sums", "n"], [pa.string(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    kind = "lang string, race double, drawn binary, sums array<long>, n array<long>"
    got = vectors.select("h", "lang", "terms").mapInArrow(partial, kind).groupBy("lang").applyInArrow(merged, kind).collect()
    return {r.lang: (_unpacked(pa.array([bytes(r.drawn)])), np.array(r.sums).reshape(TOPICS, TERMS), np.array(r.n)) for r in got}


def _fitted(vectors: DataFrame) -> dict[str, Topics]:
    """Topics of each language by spherical k-means of all its texts (h, lang, terms); numbered from the largest cluster on."""
    models, most = {}, {}
    for lang, (drawn, held, n) in _totals(vectors, {}, 0).items():
        weights = np.log((1 + n.sum()) / (1 + held.sum(axis=0))).astype(np.float32) + np.float32(1e-3)
        models[lang] = Topics(weights, np.empty((0, TERMS), np.float32))
        models[lang].centers = models[lang].vectors(drawn)
        most[lang] = max(1, min(TOPICS, int(n.sum()) // 8))
    for step in range(1, max(most.values(), default=1)):  # the next center is drawn among what is unlike the ones so far
        for lang, (drawn, _, _) in _totals(vectors, models, step).items():
            if len(models[lang].centers) < most[lang]:
                models[lang].centers = np.concatenate([models[lang].centers, models[lang].vectors(drawn)])
    sizes: dict[str, np.ndarray] = {}
    for _ in range(TOPIC_ROUNDS if models else 0):
        moved = False
        for lang, (_, sums, n) in _totals(vectors, models, 0).items():
            old, k = models[lang].centers, len(models[lang].centers)
            unit = sums[:k] / np.maximum(np.linalg.norm(sums[:k].astype(float), axis=1, keepdims=True), 1e-12)
            models[lang].centers = np.where((sums[:k] != 0).any(axis=1, keepdims=True), unit, old).astype(np.float32)
            moved |= not np.array_equal(models[lang].centers, old)
            sizes[lang] = n[:k]
        if not moved:
            break
    for lang, n in sizes.items():
        models[lang].centers = models[lang].centers[np.argsort(-n, kind="stable")]
    return models


def fit_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Topics]:
    """Topics of each language from all documents; repeated rows count as often as they come.

    Topics are parted by language, whose words would else be the clusters, and a topic margin would only repeat the language's.
    Texts are read once, for their term vectors; of these only totals by language and topic (16 KB each) come to the driver.
    """
    text = docs[text_col].cast("string")
    rows = docs.select(_drawn_by(docs[id_col], text), F.coalesce(docs[lang_col].cast("string"), F.lit(NONE)).alias("lang"), text.alias("text"))
    return _fitted(cut(_counted(rows, "text", "terms", "tokens")))


def _drawn_by(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("string"), text, F.lit(SEED + 1)).alias("h")


@dataclass
class Calibration:
    """Cells (source, lang, topic) with their sampling probabilities, and whether they are few enough to broadcast."""

    cells: DataFrame
    small: bool


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], total: float) -> np.ndarray:
    """Expected tokens of each cell: proportional fitting to the targets' shares of `total`, at most what the cell has.

    cells holds the index of each cell's value in each margin. A step scales the cells of every value of one margin
    to its target; a cell at its bound stays there and the others take over what it lacks, as far as they can.
    """
    w = tokens * min(1.0, total / max(tokens.sum(), 1e-300))
    for _ in range(ROUNDS):
        before = w
        for m, share in enumerate(targets):
            own, want = cells[:, m], share * total
            at_bound = w >= tokens * (1 - 1e-12)
            full = np.bincount(own, np.where(at_bound, w, 0), len(share))
            free = np.bincount(own, np.where(at_bound, 0, w), len(share))
            have = full + free
            down = want < have
            scale = np.where(down, want / np.maximum(have, 1e-300), np.where(free > 0, (want - full) / np.maximum(free, 1e-300), 1.0))
            w = np.minimum(np.where(down[own] | ~at_bound, w * scale[own], w), tokens)
        if np.allclose(w, before, rtol=TOLERANCE, atol=0):
            break
    return w


def tempered(tokens: dict, power: float) -> dict:
    total = sum(v**power for v in tokens.values() if v > 0)
    return {k: (v**power / total if v > 0 else 0.0) for k, v in tokens.items()}


def _rake_table(cells: DataFrame, targets: dict[str, dict] | None, fraction: float) -> DataFrame:
    """rake() for many cells, by the same steps to the same tolerance: every step is a grouped sum and a join on one margin."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * fraction
    w = cut(cells.withColumn("w", F.col("tokens") * F.lit(float(min(1.0, fraction)))))
    shares = {}
    for m in MARGINS:
        values = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
        if (targets or {}).get(m):
            given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], "name string, x double")
            values = values.join(given, F.col(m) == F.col("name"), "left").select(m, F.coalesce("x", F.lit(0.0)).alias("x"))
        else:
            values = values.select(m, F.when(F.col("t") > 0, F.pow("t", F.lit(TEMPERATURES[m]))).otherwise(0.0).alias("x"))
        whole = max(float(values.agg(F.sum("x")).first()[0] or 0), 1e-300)
        shares[m] = cut(values.select(m, (F.col("x") / whole * total).alias("want")))

    for _ in range(ROUNDS):
        w = w.withColumn("before", F.col("w"))
        for m in MARGINS:
            bound, have, free = F.col("w") >= F.col("tokens") * (1 - 1e-12), F.col("full") + F.col("free"), F.col("free")
            sums = w.groupBy(m).agg(F.sum(F.when(bound, F.col("w")).otherwise(0.0)).alias("full"), F.sum(F.when(bound, 0.0).otherwise(F.col("w"))).alias("free"))
            sums = sums.join(shares[m], m).withColumn("down", F.col("want") < have)
            scale = F.when(F.col("down"), F.col("want") / F.greatest(have, F.lit(1e-300))).otherwise(F.when(free > 0, (F.col("want") - F.col("full")) / F.greatest(free, F.lit(1e-300))).otherwise(1.0))
            scaled = F.least(F.when(F.col("down") | ~bound, F.col("w") * F.col("scale")).otherwise(F.col("w")), F.col("tokens").cast("double"))
            w = cut(w.join(sums.select(m, "down", scale.alias("scale")), m).withColumn("w", scaled).drop("down", "scale"))
        if w.where(F.abs(F.col("w") - F.col("before")) > TOLERANCE * F.abs("before")).isEmpty():
            break
    return w


def calibrate(keyed: DataFrame, targets: dict[str, dict] | None = None, fraction: float = FRACTION, driver_cells: int = DRIVER_CELLS) -> Calibration:
    """Sampling probabilities of the cells of rows (source, lang, topic, tokens).

    targets gives weights by margin, which count in proportion to their sum over the values that are there; a value that
    it leaves out has weight 0. A margin without targets gets tempered shares.
    """
    cells = keyed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    got = cells.limit(driver_cells + 1).toPandas()
    kind = "source string, lang string, topic string, probability double"
    if len(got) > driver_cells:
        raked = _rake_table(cut(cells), targets, fraction)
        return Calibration(raked.select(*MARGINS, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(fraction)).alias("probability")), False)
    got = got.sort_values(list(MARGINS)).reset_index(drop=True)
    tokens = got["tokens"].to_numpy(float)
    index, shares = [], []
    for m in MARGINS:
        names, own = np.unique(got[m].to_numpy(str), return_inverse=True) if len(got) else (np.empty(0, str), np.empty(0, int))
        given = (targets or {}).get(m) or tempered(dict(zip(names, np.bincount(own, tokens, len(names)), strict=True)), TEMPERATURES[m])
        given = {str(k): float(v) for k, v in given.items()}
        share = np.array([given.get(str(x), 0.0) for x in names])
        index.append(own)
        shares.append(share / max(share.sum(), 1e-300))
    w = rake(np.stack(index, axis=1), tokens, shares, fraction * tokens.sum()) if len(got) else tokens
    p = np.where(tokens > 0, w / np.maximum(tokens, 1e-300), fraction)
    rows = [(*map(str, key), float(x)) for key, x in zip(got[list(MARGINS)].itertuples(index=False), p, strict=True)]
    return Calibration(keyed.sparkSession.createDataFrame(rows, kind), True)


def sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict] | None = None,
    fraction: float = FRACTION,
    seed: int = SEED,
    whole: bool = False,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """Documents drawn by calibrated probabilities: doc_id, source, lang, topic, tokens, probability; or docs' own columns (whole).

    The tokens of (source, lang, topic) cells are raked to the margins' targets; a document is drawn
    if a hash of its id and text falls below its cell's probability, so draws are independent of
    each other, of the partitioning and of retries. Expected sampled tokens meet the targets as far as the
    tokens there allow. Without a topic column topics are clusters
    of hashed terms within a language, fitted on all documents.
    Nulls are the value "(none)" of their margin, and so is the topic of a text without words; a null or blank text has no tokens
    and is drawn with its cell (with `fraction` if the whole cell has none). Repeated rows share their draw. No rows give no rows.
    """
    own = [fresh(docs, f"mix_{m}") for m in (*MARGINS, "tokens", "draw")]
    o_source, o_lang, o_topic, o_tokens, o_draw = own
    text = docs[text_col].cast("string")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    # 53 bits of the hash as a number from 0 to 1
    draw = F.shiftrightunsigned(F.xxhash64(docs[id_col].cast("string"), text, F.lit(seed)), 11) / float(1 << 53)
    keys = [name(docs[source_col]).alias(o_source), name(docs[lang_col]).alias(o_lang), draw.alias(o_draw)]
    carried = [docs[c] for c in docs.columns] if whole else [docs[id_col]]
    if topic is not None:
        tagged = docs.select(*carried, *keys, name(topic).alias(o_topic), F.size(words_of(text)).cast("long").alias(o_tokens))
    else:
        read, terms, h = (fresh(docs, f"mix_{x}") for x in ("text", "terms", "h"))
        # written down: every text is read once, for its cell and for its draw
        vectors = cut(_counted(docs.select(*carried, *keys, _drawn_by(docs[id_col], text).alias(h), text.alias(read)), read, terms, o_tokens))
        models = _fitted(vectors.select(F.col(h).alias("h"), F.col(o_lang).alias("lang"), F.col(terms).alias("terms")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array([*(f"t{i}" for i in range(TOPICS)), NONE])
            for batch in batches:
                for part in (batch.slice(at, 2048) for at in range(0, len(batch), 2048)):
                    topics = topic_numbers(models, np.array(part.column(o_lang).to_pylist(), object), _unpacked(part.column(terms)))
                    rest = part.drop_columns([terms, h] if h in part.schema.names else [terms])
                    yield pa.RecordBatch.from_arrays([*rest.columns, names.take(pa.array(np.where(topics < 0, len(names) - 1, topics)))], [*rest.schema.names, o_topic])
            give_back()

        def with_topic(rows: DataFrame) -> DataFrame:
            kinds = [*rows.drop(terms, h).schema.fields, T.StructField(o_topic, T.StringType())]
            return rows.mapInArrow(run, T.StructType([T.StructField(x.name, x.dataType) for x in kinds]))

        tagged, keyed = with_topic(vectors), with_topic(vectors.select(o_source, o_lang, terms, o_tokens))
    if topic is not None:
        tagged = keyed = cut(tagged)
    cells = calibrate(keyed.select(*[F.col(n).alias(m) for n, m in zip(own, (*MARGINS, "tokens"), strict=False)]), targets, fraction, driver_cells)
    probability = fresh(tagged, "probability")
    side = cells.cells.select(*[F.col(m).alias(n) for m, n in zip(MARGINS, own, strict=False)], F.col("probability").alias(probability))
    joined = tagged.join(F.broadcast(side) if cells.small else side, own[:3]).where(F.col(o_draw) < F.col(probability))
    if whole:
        return joined.select(docs.columns)
    return joined.select(F.col(id_col).alias("doc_id"), *[F.col(n).alias(m) for n, m in zip(own, (*MARGINS, "tokens"), strict=False)], F.col(probability).alias("probability"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"))
