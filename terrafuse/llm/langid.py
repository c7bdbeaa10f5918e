"""Language ID by prediction by partial matching: byte context trees with escapes, one per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafuse.llm.common import fresh, give_back, slices, table

UNDETERMINED = "und"
ORDER = 4
#: Labelled documents that a model is fitted on, for each language and in all, and the code points of one at most: of a longer
#: text a run that its hash chooses.
ROWS_PER_LANGUAGE, ROWS, MOST_CHARS = 400, 8000, 1 << 14
#: Texts are scored in slices of about this many bytes, each of which takes some fifty bytes of memory.
SLICE = 1 << 20


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the `order` bytes before it (zeros before a text's start) as one integer, and the texts' ends."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    return _grams(data, np.cumsum([0, *map(len, texts)]), order)


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[: max(0, len(data) - k)].astype(np.uint64) << np.uint64(8 * k)
    starts, size = bounds[:-1], np.diff(bounds)
    for k in range(order):  # contexts end at the start of their text
        at = starts[size > k] + k
        out[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return out, bounds[1:]


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Ppm:
    """Frozen byte statistics of several languages and the code lengths that they give.

    A byte is coded in its longest context that the language has seen, as count / (total + distinct);
    a byte that is new there costs an escape of distinct / (total + distinct) and is coded one
    order lower, where the bytes seen in the longer context are excluded from all counts; below order
    0 the bytes never seen share the rest evenly. So the probabilities of the 256 bytes sum to one in every context.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.languages = order, sorted(texts)
        found = [grams_of(texts[x], order)[0] for x in self.languages]
        self.keys, self.counts, self.contexts, self.total, self.distinct, self.excluded = [], [], [], [], [], []
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            each = [np.unique(g & mask, return_counts=True) for g in found]
            keys = np.unique(np.concatenate([np.zeros(1, np.uint64), *(u for u, _ in each)]))
            counts = np.zeros((len(keys), len(found)))
            for i, (u, n) in enumerate(each):
                counts[np.searchsorted(keys, u), i] = n
            contexts, inside = np.unique(keys >> np.uint64(8), return_inverse=True)
            lower = counts
            if k:
                lower = self.counts[-1][_look_up(self.keys[-1], keys & (mask >> np.uint64(8)))[0]]
            sums = [np.zeros((len(contexts), len(found))) for _ in range(3)]
            for out, value in zip(sums, (counts, counts > 0, np.where(counts > 0, lower, 0)), strict=True):
                np.add.at(out, inside, value)
            self.keys.append(keys)
            self.counts.append(counts)
            self.contexts.append(contexts)
            for kept, out in zip((self.total, self.distinct, self.excluded), sums, strict=True):
                kept.append(out)
        self.known = self.keys[-1]
        self.cost = self.code_length(self.known)
        self.width = max(10, int(4 * len(self.known) - 1).bit_length())
        self.slot = np.full(1 << self.width, -1, np.int32)
        self.slot[self._hash(self.known)] = np.arange(len(self.known), dtype=np.int32)

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.width)).astype(np.int64)

    def code_length(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the bytes before it, in every language."""
        shape = (len(grams), len(self.languages))
        bits, open_ = np.zeros(shape), np.ones(shape, bool)
        out_total, out_distinct = np.zeros(shape), np.zeros(shape)
        for k in range(self.order, -1, -1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            at, seen = _look_up(self.contexts[k], (grams & mask) >> np.uint64(8))
            there = seen[:, None] & (self.total[k][at] > 0)
            new = self.distinct[k][at] - out_distinct
            whole = self.total[k][at] - out_total + new
            i, same = _look_up(self.keys[k], grams & mask)
            count = np.where(same[:, None], self.counts[k][i], 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = there & open_ & (count > 0)
                miss = there & open_ & (count == 0) & (whole > 0)
                bits += np.where(hit, np.log2(whole / count), 0) + np.where(miss, np.log2(whole / new), 0)
            open_ &= ~hit
            out_total = np.where(there, self.excluded[k][at], 0)
            out_distinct = np.where(there, self.distinct[k][at], 0)
        return bits + np.where(open_, np.log2(np.maximum(256 - out_distinct, 1)), 0)

    def text_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each whole text in every language; text i is data[bounds[i]:bounds[i + 1]]."""
        grams, _ = _grams(data, bounds, self.order)
        at = self.slot[self._hash(grams)]
        missed = np.flatnonzero((at < 0) | (self.known[at] != grams))
        other, back = np.unique(grams[missed], return_inverse=True)
        slow = self.code_length(other) if len(other) else None
        out = np.empty((len(bounds) - 1, len(self.languages)))
        for i in range(len(self.languages)):
            cost = self.cost[at, i]
            if slow is not None:
                cost[missed] = slow[back, i]
            upto = np.r_[0.0, np.cumsum(cost, dtype=np.float64)]
            out[:, i] = upto[bounds[1:]] - upto[bounds[:-1]]
        return out

    def predict(self, texts: pa.Array, determined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language (-1 if undetermined) and its posterior under equal priors."""
        if not self.languages or not len(texts):
            return np.full(len(texts), -1), np.zeros(len(texts))
        raw = [x.encode() for x in texts.fill_null("").to_pylist()]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bits = self.text_lengths(data, np.cumsum([0, *map(len, raw)]))
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        return np.where(determined, best, -1), np.where(determined, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    rows: int = ROWS,
) -> Ppm:
    """A model of every language in lang_col, from documents outside the held-out fold.

    The classifier is fitted on a bounded sample: at most rows_per_language different documents a language and
    `rows` in all, those with the smallest hash of id and text, and MOST_CHARS of each. Rows without id, text or language
    don't count, and a document that repeats counts once.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    source = source.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    hashed = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11))
    # different documents, so that one that repeats very often does not thin out its language
    sizes = source.groupBy("lang").agg(F.approx_count_distinct(hashed, 0.03).alias("n"))
    counts = {r.lang: r.n for r in sizes.orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return Ppm({}, order)
    each, ring = max(1, min(rows_per_language, rows // len(counts))), 1 << 30
    bound = docs.sparkSession.createDataFrame([(k, int(ring * min(1.0, 1.4 * each / n)) + 1) for k, n in counts.items()], "lang string, below long")
    # the bounds are at most `rows` rows
    drawn = source.join(F.broadcast(bound), "lang").withColumn("hashed", hashed).where(F.pmod("hashed", F.lit(ring)) < F.col("below"))
    over = F.greatest(F.length("text") - MOST_CHARS, F.lit(0))
    part = F.substring("text", F.pmod("hashed", over + 1).cast("int") + 1, F.lit(MOST_CHARS))
    single = drawn.select("lang", "hashed", part.alias("text")).groupBy("lang", "hashed").agg(F.min("text").alias("text"))
    kept = single.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hashed", F.lit(ring)), "hashed"))).where(F.col("place") <= each)
    texts: dict[str, list] = {}
    for r in kept.select("lang", "place", "text").collect():
        texts.setdefault(r.lang, []).append((r.place, r.text))
    model = Ppm({k: [t.encode() for _, t in sorted(v)] for k, v in texts.items()}, order)
    give_back()
    return model


def identify(docs: DataFrame, model: Ppm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Texts that are null or have no letter, and all texts if nothing could be learned, are "und" with
    score 0. Ties go to the language that sorts first. Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                best, score = model.predict(part.column("text"), part.column("letters").to_numpy(zero_copy_only=False))
                named = names.take(pa.array(np.where(best < 0, len(model.languages), best)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), named, pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    text = docs[text_col].cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), letters.alias("letters"), held_out(docs[id_col]).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Ppm, least_score: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those whose language stays undetermined or scores below least_score; a null language is filled in."""
    letters = fresh(docs, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                best, score = model.predict(part.column(text_col), part.column(letters).to_numpy(zero_copy_only=False))
                kept = pa.array((best >= 0) & (score >= least_score))
                named = names.take(pa.array(np.where(best < 0, len(model.languages), best)))
                lang = part.schema.get_field_index(lang_col)
                out = part.set_column(lang, part.schema.field(lang_col), pc.coalesce(part.column(lang_col), named.cast(part.schema.field(lang_col).type)))
                yield out.drop_columns([letters]).filter(kept)
        give_back()

    return docs.withColumn(letters, F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
