"""Token counts under a unigram vocabulary: forward scores shared along the prefixes of a trie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.llm.common import give_back, slices, table

#: Stands for the white space before a pre-token.
SPACE = "▁"
#: A byte of a character that no piece covers costs this much more than the worst piece.
BYTE_PENALTY = 10.0
#: From this depth on a node that only one pre-token reaches is followed by itself, from its ancestors' scores.
DEEP = 64


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Pieces of a sentencepiece model with unigram log-probabilities.

    The public model is a merge list without probabilities, so a piece's rank r stands for its
    frequency by Zipf's law: ln p = -ln((r + 1) * H), H being the harmonic number of the vocabulary's size.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.fsum(1 / (r + 1) for r in range(len(plain)))
    return {model.id_to_piece(i): -math.log((r + 1) * total) for r, i in enumerate(plain)}


class Trie:
    """Best segmentations of distinct pre-tokens: a trie built level by level, with the forward score and count of every node.

    A node's score is the best over all pieces that end in it, of the score of the node where the
    piece begins plus the piece's own; of equal scores the one with fewer tokens counts. Each node
    stands for a prefix that some pre-tokens share, and is computed once for all of them.
    Pieces are found by rolling hashes of a node's last characters and then compared by character.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 22

    def __init__(self, pieces: dict[str, float]):
        self.byte = min(pieces.values(), default=0.0) - BYTE_PENALTY
        self.pieces = pieces
        self.most = max(map(len, pieces), default=1)
        names = sorted(pieces)
        self.size = np.array([len(p) for p in names], np.int64)
        self.score = np.array([pieces[p] for p in names])
        #: last character first, zeros beyond the start
        self.chars = np.zeros((len(names), self.most), np.uint32)
        for row, p in zip(self.chars, names, strict=True):
            row[: len(p)] = [ord(c) for c in reversed(p)]
        hashes = np.array([self._hash(p) for p in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self._bucket(self.hashes)] = True

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.BITS)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the distinct pre-tokens; an empty one has none."""
        out = np.zeros(len(words), np.int64)
        order = sorted((i for i, w in enumerate(words) if w), key=words.__getitem__)
        if not order:
            return out
        order = np.array(order)
        text = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(words[i]) for i in order])
        start = np.cumsum(size) - size
        # level 0 is the root; of the last levels each node keeps its ancestors, hashes and last characters
        rows, node = np.arange(len(order)), np.zeros(len(order), np.int64)
        levels = [(np.zeros(1), np.zeros(1, np.int64))]
        k = self.most
        hashes, last, above = np.zeros((1, k + 1), np.uint64), np.zeros((1, k), np.uint32), np.zeros((1, k + 1), np.int64)
        depth = 0
        while len(rows):
            ch = text[start[rows] + depth]
            depth += 1
            # words are sorted, so those that share a prefix stand together
            new = np.r_[True, (node[1:] != node[:-1]) | (ch[1:] != ch[:-1])]
            parent, c = node[new], ch[new]
            node = np.cumsum(new) - 1
            value = c.astype(np.uint64) + np.uint64(1)
            hashes = np.concatenate([np.zeros((len(c), 1), np.uint64), hashes[parent, :-1] * self.BASE + value[:, None]], axis=1)
            last = np.concatenate([c[:, None], last[parent, :-1]], axis=1)
            above = np.concatenate([np.arange(len(c))[:, None], above[parent, :-1]], axis=1)
            levels.append(self._level(depth, c, hashes, last, above, levels))
            levels[: max(0, depth - k)] = [None] * max(0, depth - k)
            ends = size[rows] == depth
            out[order[rows[ends]]] = levels[-1][1][node[ends]]
            rows, node = rows[~ends], node[~ends]
            if depth >= DEEP and len(rows):
                lone = np.bincount(node)[node] == 1
                for r, x in zip(rows[lone], node[lone], strict=True):
                    back = range(min(depth, k), -1, -1)
                    state = [[float(levels[depth - j][0][above[x, j]]) for j in back], [int(levels[depth - j][1][above[x, j]]) for j in back]]
                    out[order[r]] = self.follow(words[order[r]], depth, *state)
                rows, node = rows[~lone], node[~lone]
        return out

    def _level(self, depth: int, c: np.ndarray, hashes: np.ndarray, last: np.ndarray, above: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of one level's nodes."""
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        score, count = levels[-1][0][above[:, 1]] + width * self.byte, levels[-1][1][above[:, 1]] + width
        most = min(depth, self.most)
        i, k = np.nonzero(self.maybe[self._bucket(hashes[:, 1 : most + 1])])
        h = hashes[i, k + 1]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        piece = self.of_hash[at] if len(self.hashes) else at
        sure = (self.hashes[at] == h) & (self.size[piece] == k + 1) if len(self.hashes) else np.zeros(len(i), bool)
        i, k, piece = i[sure], k[sure], piece[sure]
        inside = np.arange(self.most) <= k[:, None]
        same = ((last[i] == self.chars[piece]) | ~inside).all(axis=1)
        i, k, piece = i[same], k[same] + 1, piece[same]
        for n in range(1, most + 1):  # a node has one piece of each length at most
            own = k == n
            if own.any():
                j, p = i[own], piece[own]
                from_score, from_count = levels[depth - n]
                s, t = from_score[above[j, n]] + self.score[p], from_count[above[j, n]] + 1
                better = (s > score[j]) | ((s == score[j]) & (t < count[j]))
                score[j[better]], count[j[better]] = s[better], t[better]
        return score, count

    def follow(self, word: str, depth: int, scores: list[float], counts: list[int]) -> int:
        """Tokens of a word whose first `depth` characters are scored: the last ones' scores and counts, oldest first."""
        for n in range(depth + 1, len(word) + 1):
            size = len(word[n - 1].encode("utf-8", "surrogatepass"))
            best, fewest = scores[-1] + size * self.byte, counts[-1] + size
            for k in range(1, min(n, self.most) + 1):
                p = self.pieces.get(word[n - k : n])
                if p is not None:
                    s, t = scores[-k] + p, counts[-k] + 1
                    if s > best or (s == best and t < fewest):
                        best, fewest = s, t
            scores.append(best)
            counts.append(fewest)
        return counts[-1]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: dict[str, float] | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_words (pre-tokens, parted at ASCII white space) and n_tokens of every whole text.

    Each task counts its own documents: the distinct pre-tokens of a slice are inserted once, and
    the counts at their terminal nodes are summed up for the texts. Null and blank texts have no tokens. Repeated rows are counted as often as they come;
    other columns are not read. `path` is a sentencepiece model that every executor can open (None: the installed one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces if pieces is not None else vocabulary(path))
        for batch in batches:
            for part in slices(batch, "text"):
                words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(part.column("text").fill_null("")))
                coded = words.flatten().dictionary_encode()
                each = trie.counts([SPACE + w if w else "" for w in coded.dictionary.to_pylist()])
                real = np.array([bool(w) for w in coded.dictionary.to_pylist()], np.int64)
                at = coded.indices.to_numpy(zero_copy_only=False)
                bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
                sums = [np.r_[0, np.cumsum(x[at] if len(at) else np.empty(0, np.int64))] for x in (real, each)]
                counts = [pa.array((s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64)) for s in sums]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts], ["doc_id", "n_words", "n_tokens"])
        give_back()

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public model has merge ranks and no probabilities: the column scores says what stands in for them."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("scores", F.lit("rank by Zipf's law"))
