"""Packing into training sequences: vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.llm.common import give_back, slices, table


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


#: Documents are packed in windows of this many rests; what a window leaves open goes into the next one.
WINDOW = 512


def best_fit(demand: np.ndarray, room: np.ndarray, limits: np.ndarray) -> int:
    """Index of the example that fits the room in every dimension and has the largest dot product with it; -1 if none fits."""
    fits = np.flatnonzero((demand <= room).all(axis=1))
    if not len(fits):
        return -1
    return int(fits[np.argmax((demand[fits] / limits) @ (room / limits))])


def place(demand: np.ndarray, limits: Limits) -> np.ndarray:
    """Bin of each whole example (rows of tokens, segments, loss tokens); -1 for one that no bin can hold."""
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    bins, left, number = np.full(len(demand), -1), np.flatnonzero((demand <= most).all(axis=1)), 0
    while len(left):
        room, rest = most.copy(), demand[left].astype(float)
        taken = np.zeros(len(left), bool)
        while (i := best_fit(np.where(taken[:, None], np.inf, rest), room, most)) >= 0:
            taken[i], room = True, room - rest[i]
        bins[left[taken]] = number
        left, number = left[~taken], number + 1
    return bins


@dataclass
class Rests:
    """Pieces that wait for a sequence: document, first token, ids."""

    doc: list = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    total: list[int] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        self.doc.append(doc)
        self.start.append(start)
        self.total.append(total)
        self.ids.append(ids)

    def __len__(self) -> int:
        return len(self.doc)


class Packer:
    """Packs pieces of documents that may be cut anywhere.

    Each sequence takes the piece with the largest dot product of demand and room, again and again;
    when none fits whole, the largest one left is cut to fill the rest. A sequence that cannot be
    filled so keeps its largest power of two of tokens, which needs no padding, and what is over waits for the next.
    """

    def __init__(self, limits: Limits, first_sequence: int, with_ids: bool):
        if limits.tokens < 1 or limits.segments < 1 or limits.loss_tokens < 1:
            raise ValueError("limits must be positive")
        self.limits, self.next, self.with_ids = limits, first_sequence, with_ids
        self.size = min(limits.tokens, limits.loss_tokens)  # every token of a document bears loss
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.rows: list[tuple] = []
        self.rests = Rests()

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, ids))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        for start in range(0, total, self.size):
            piece = ids[start : start + self.size]
            if len(piece) == self.size:
                self.close([(doc, start, total, piece)])
            else:
                self.rests.add(doc, start, total, piece)
        if len(self.rests) >= WINDOW:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        """Close sequences of what waits: all of it at the last, else as long as half a window is there to choose from."""
        r = self.rests
        n = np.array([len(x) for x in r.ids], float)
        demand = np.stack([n, np.ones_like(n), n], axis=1) if len(n) else np.empty((0, 3))
        open_ = np.ones(len(n), bool)
        count = len(n)
        while count > (0 if last else WINDOW // 2):
            room, pieces = self.most.copy(), []
            while room.min() > 0 and count:
                i = best_fit(demand, room, self.most) if room[1] > 1 or not (demand[open_, 0] > min(room[0], room[2])).any() else -1
                ids = None
                if i < 0:  # none fits whole: cut the largest
                    i = int(np.argmax(np.where(open_, demand[:, 0], -1)))
                    take = int(min(room[0], room[2]))
                    if demand[i, 0] > take:
                        ids = r.ids[i][:take]
                        pieces.append((r.doc[i], r.start[i], r.total[i], ids))
                        r.ids[i], r.start[i] = r.ids[i][take:], r.start[i] + take
                        demand[i, 0] = demand[i, 2] = len(r.ids[i])
                if ids is None:
                    ids = r.ids[i]
                    pieces.append((r.doc[i], r.start[i], r.total[i], ids))
                    demand[i], open_[i], count = np.inf, False, count - 1
                room -= (len(ids), 1, len(ids))
            fill = sum(len(p[3]) for p in pieces)
            keep = self.limits.tokens if fill == self.limits.tokens else 1 << (fill.bit_length() - 1)
            kept, over, at = [], [], 0
            for doc, start, total, ids in pieces:
                here = max(0, min(len(ids), keep - at))
                at += len(ids)
                if here:
                    kept.append((doc, start, total, ids[:here]))
                if here < len(ids):
                    over.append((doc, start + here, total, ids[here:]))
            self.close(kept)
            for piece in over:
                r.add(*piece)
            if over:
                more = np.array([[len(p[3]), 1, len(p[3])] for p in over], float)
                demand, open_, count = np.concatenate([demand, more]), np.r_[open_, np.ones(len(over), bool)], count + len(over)
        left = Rests()
        for i in np.flatnonzero(open_):
            left.add(r.doc[i], r.start[i], r.total[i], r.ids[i])
        self.rests = left

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        doc, start, length, crc, total, seq, offset, ids = zip(*self.rows, strict=True) if self.rows else ([],) * 8
        self.rows = []
        cols = [pa.array(doc, id_type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, offset))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            ends = np.cumsum([0, *length]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)


#: Normalizer and pre-tokenizer of tokenizers that fold case and whose tokens never cross white space (fixed values of the format).
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


#: What a model may say besides its vocabulary, merges and suffix for `Merges` to give its ids.
PLAIN_BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def byte_signs() -> list[str]:
    """The characters that stand for bytes: a byte's sign is itself if it can be printed, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Byte-pair merging of many pre-tokens at once: always the pair of lowest rank, of equal ones the leftmost, as the model itself does.

    Pre-tokens of one length are the columns of a matrix. A step merges one pair in each column, which so gets to the
    next smaller length and joins those that had it from the start; columns without a pair are done.
    """

    LONGEST = 64
    NONE = (1 << 25) - 1  # rank of what is no pair: ranks and positions share 31 bits
    FREE = np.uint64(2**64 - 1)

    def __init__(self, model: dict):
        vocab, signs, end = model["vocab"], byte_signs(), model["end_of_word_suffix"] or ""
        self.byte = np.array([vocab[c] for c in signs] + [vocab[c + end] for c in signs], np.int32)  # from 256 on, last bytes of pre-tokens
        rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(model["merges"])}
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self.base = np.uint64(max(vocab.values()) + 1)
        pairs, ranks = np.array(list(rank), np.uint64).reshape(-1, 2), np.array(list(rank.values()), np.int32)
        # an open hash table of the pairs, at most a quarter full
        bits = (4 * len(ranks) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, self.FREE), np.full(1 << bits, self.NONE, np.int32)
        keys = pairs[:, 0] * self.base + pairs[:, 1]
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == self.FREE]
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[left]] == keys[left]
            self.ranks[slot[left[placed]]] = ranks[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self.mask
        self.of_bytes = self.rank(np.repeat(self.byte[:256], 512), np.tile(self.byte, 256))

    @staticmethod
    def can(model: dict) -> bool:
        if any(model.get(k) != v for k, v in PLAIN_BPE.items()) or len(model["merges"]) >= Merges.NONE:
            return False
        end = model["end_of_word_suffix"] or ""
        return all(c in model["vocab"] and c + end in model["vocab"] for c in byte_signs())

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * self.base + right.astype(np.uint64)
        slot = self.slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.ranks[slot], np.int32(self.NONE))
        more = np.flatnonzero((there != keys) & (there != self.FREE))
        while len(more):
            slot[more] = at = (slot[more] + 1) & self.mask
            there = self.keys[at]
            hit = there == keys[more]
            found[more[hit]] = self.ranks[at[hit]]
            more = more[~hit & (there != self.FREE)]
        return found

    def __call__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all of them; pre-token i is the 1 to LONGEST bytes of data from start[i] on."""
        code = data.astype(np.int32)
        code[start + size - 1] += 256
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], np.arange(self.LONGEST + 2))
        longest = int(size.max(initial=0))
        who, ids, rank = np.empty(0, np.int64), np.empty((longest, 0), np.int32), np.empty((max(longest - 1, 0), 0), np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(longest, 0, -1):
            row = np.arange(n, dtype=np.int32)[:, None]
            own = order[bounds[n] : bounds[n + 1]]
            if len(own):
                c = code[start[own] + row]
                who, ids = np.concatenate([who, own]), np.concatenate([ids, self.byte[c]], axis=1)
                rank = np.concatenate([rank, self.of_bytes[c[:-1] * 512 + c[1:]]], axis=1)
            if n == 1:
                done.append((who, ids))
                break
            best = ((rank << 6) | row[:-1]).min(axis=0, initial=self.NONE << 6)
            ends = best == self.NONE << 6
            if ends.any():
                done.append((who[ends], ids[:, ends]))
                who, ids, rank, best = who[~ends], ids[:, ~ends], rank[:, ~ends], best[~ends]
            at, new = best & 63, self.made[best >> 6]
            before = row[:-1] < at
            ids = np.where(before, ids[:-1], ids[1:])
            ids[at, np.arange(len(at))] = new
            rank = np.where(before[:-1], rank[:-1], rank[1:])
            i = np.flatnonzero(at > 0)
            rank[at[i] - 1, i] = self.rank(ids[at[i] - 1, i], new[i])
            i = np.flatnonzero(at < n - 2)
            rank[at[i], i] = self.rank(new[i], ids[at[i] + 1, i])
        number = np.zeros(len(size), np.int64)
        for who, ids in done:
            number[who] = len(ids)
        first = np.cumsum(number) - number
        flat = np.empty(int(number.sum()), np.int32)
        for who, ids in done:
            flat[first[who] + np.arange(len(ids))[:, None]] = ids
        return number, flat


class WordIds:
    """Token ids of whole texts, equal to those of the plain tokenizer.

    With a tokenizer that is known to fold case and to part words each distinct word of a slice is encoded once. Words of
    plain characters are merged together here. The others go to the tokenizer in long lines, parted by a mark, whose id then
    tells where each word's ids end, and are kept up to a number. Texts that hold a special token's string, and all texts
    of other tokenizers, are encoded whole.
    """

    MARK = "\x01"
    LINE = 512
    #: Printable ASCII without the apostrophe, which contractions are cut at, and Latin letters that are a normal form already and have one lower case.
    PLAIN = "^[!-&(-~\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*$"
    #: Kinds of bytes in plain words: 0 of letters, 1 digits, 2 others.
    KIND = np.array([0 if b >= 128 or chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(256)], np.uint8)

    def __init__(self, path: str, end_id: int, cached: int = 200_000):
        from tokenizers import Tokenizer

        # one core to a task: the tokenizer's own threads would contend with the other tasks'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.plain = Tokenizer.from_file(path)
        self.end_id, self.cached = np.array([end_id], np.int32), cached
        rules = json.loads(self.plain.to_str())
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.by_word = (rules["normalizer"], rules["pre_tokenizer"]) == BY_WORD and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"])
        if not self.by_word:
            return
        self.merges = Merges(rules["model"]) if Merges.can(rules["model"]) else None
        # words are lower-cased before, which may make a special token's string of another one: here these are ordinary text
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.mark_id,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and how many each has."""
        lines = [f" {self.MARK} ".join([*words[i : i + self.LINE], ""]) for i in range(0, len(words), self.LINE)]
        found = self.tokenizer.encode_batch(lines, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.int32), *(np.array(x.ids, np.int32) for x in found)])
        at = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(np.r_[-1, at]) - 1

    def learn(self, words: list[str]) -> None:
        plain, odd = [], []
        for w in words:
            (odd if self.MARK in w else plain).append(w)
        ids, sizes = self.encode(plain)
        alone = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch(odd, add_special_tokens=False)]
        for w in (*plain, *odd):
            self.known[w] = len(self.known)
        self.size = np.concatenate([self.size, sizes, np.array([len(x) for x in alone], np.int64)])
        self.flat = np.concatenate([self.flat, ids, *alone])

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are plain and short enough, how many ids each of these has, and all of them."""
        if self.merges is None:
            return np.zeros(len(words), bool), np.empty(0, np.int64), np.empty(0, np.int32)
        words = words.cast(pa.string())  # offsets of 32 bits
        can = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        texts = pc.utf8_lower(words.filter(pa.array(can)))  # which may take more bytes
        short = pc.less_equal(pc.binary_length(texts), Merges.LONGEST).to_numpy(zero_copy_only=False)
        if not short.all():
            can[can], texts = short, texts.filter(pa.array(short))
        ends = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())].astype(np.int64)
        first = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : first + ends[-1]]
        # pre-tokens are runs of letters, runs of other signs, and single digits
        kind = self.KIND[data]
        starts = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 1)][: len(data)]
        starts[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(starts)
        number, ids = self.merges(data, start, np.diff(np.r_[start, len(data)]))
        upto = np.r_[0, np.cumsum(number)][np.searchsorted(start, ends)]
        return can, np.diff(upto), ids

    def whole(self, text: str | None) -> np.ndarray:
        return np.array([*self.plain.encode(text or "", add_special_tokens=False).ids, *self.end_id], np.int32)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.by_word:
            yield from map(self.whole, texts.to_pylist())
            return
        odd = np.zeros(len(texts), bool)
        for mark in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        apart = {int(i): self.whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        if apart:
            texts = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        for i, ids in enumerate(self._of_words(texts)):
            yield apart.get(i, ids)

    def _of_words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        coded = words.flatten().dictionary_encode()
        can, size, flat = self.merged(coded.dictionary)
        distinct = coded.dictionary.filter(pa.array(~can)).to_pylist()
        if len(self.known) + len(distinct) > self.cached:
            self.forget()
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        sizes = np.concatenate([size, self.size])
        flat = np.concatenate([flat, self.flat])
        first = np.cumsum(sizes) - sizes
        place = np.empty(len(can), np.int64)
        place[can] = np.arange(len(size))
        place[~can] = len(size) + np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        row = place[coded.indices.to_numpy(zero_copy_only=False)]
        n = sizes[row]
        ends = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(first[row] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.concatenate([ids[a:b], self.end_id])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    limits: Limits = Limits(),  # noqa: B008
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every partition packs its own documents as they stream by, so nothing is shuffled and no group is
    gathered; sequence ids start at the partition number times 2**40. A null or blank text is the end
    id alone. Repeated rows are packed as often as they come, a null id as a null. Columns besides the
    two are not read. `tokenizer` is a path that every executor can open (None: the installed one).
    """
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer or default_tokenizer(), end_id)
        packer, arrow_type = Packer(limits, TaskContext.get().partitionId() << 40, with_ids), None
        for batch in batches:
            arrow_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    packer.add(doc, ids)
                yield packer.batch(arrow_type)
        if arrow_type is not None:
            packer.pack(last=True)
            yield packer.batch(arrow_type)
        del encode, packer
        give_back()

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack_examples(
    examples: DataFrame,
    id_col: str,
    tokens_col: str,
    loss_col: str,
    limits: Limits = Limits(),  # noqa: B008
    window: int = 4096,
) -> DataFrame:
    """(id, sequence_id, offset, tokens, loss_tokens) of instruction examples, which are never cut.

    An example is one segment. Each partition places windows of its examples under all three limits
    at once. An example over a limit, or with a null or negative count, has a null sequence and offset.
    """
    id_type = dict(examples.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, window):
                part = batch.slice(at, window)
                n, loss = (pc.fill_null(part.column(c), -1).to_numpy(zero_copy_only=False) for c in ("tokens", "loss_tokens"))
                bad = (n < 0) | (loss < 0)
                demand = np.stack([np.where(bad, limits.tokens + 1, n), np.ones_like(n), np.maximum(loss, 0)], axis=1)
                bins = place(demand, limits)
                order = np.argsort(bins, kind="stable")
                upto = np.cumsum(n[order]) - n[order]
                start = np.r_[True, bins[order][1:] != bins[order][:-1]]
                offset = np.empty(len(n), np.int64)
                offset[order] = upto - upto[np.maximum.accumulate(np.where(start, np.arange(len(n)), 0))]
                mask = bins < 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(bins + first, pa.int64(), mask=mask), pa.array(offset, pa.int64(), mask=mask), part.column("tokens"), part.column("loss_tokens")],
                    ["id", "sequence_id", "offset", "tokens", "loss_tokens"],
                )
                first += int(bins.max(initial=-1)) + 1

    rows = examples.select(
        examples[id_col].alias("id"), examples[tokens_col].cast("long").alias("tokens"), examples[loss_col].cast("long").alias("loss_tokens")
    )
    return rows.mapInArrow(run, f"id {id_type}, sequence_id long, offset long, tokens long, loss_tokens long")


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
