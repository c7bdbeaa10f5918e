"""Language ID, token counts, packing and quality rules against brute force."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafuse.llm import langid, packing, quality, tokencount

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "two words"), (5, "x" * 5000), (6, "é ü\x1c 12'st <|endoftext|> \x01 a\x01b")]


def odd_documents(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "z") for i, t in ODD], "doc_id long, text string, lang string, source string, n_words long, letters string")


class BrutePpm:
    """Prediction by partial matching, straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            padded = bytes(order) + t
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.seen[padded[i - k : i]][padded[i]] += 1

    def probability(self, context, byte):
        p, out = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = {s: n for s, n in self.seen.get(context[len(context) - k :], {}).items()}
            if not counts:
                continue
            # what is new here: the distinct bytes left, as what escapes to the next order
            left = {s: n for s, n in counts.items() if s not in out}
            total = sum(left.values()) + len(left)
            if byte in left:
                return p * left[byte] / total
            if total:
                p *= len(left) / total
            out |= set(counts)
        return p / (256 - len(out))

    def bits(self, text):
        padded = bytes(self.order) + text
        return -sum(math.log2(self.probability(padded[i - self.order : i], padded[i])) for i in range(self.order, len(padded)))


def test_code_lengths_are_exact():
    texts = {"a": [b"abracadabra", b"bar cab", b""], "b": ["zèle été".encode(), b"zzz"]}
    model = langid.Ppm(texts, 3)
    brute = {k: BrutePpm(v, 3) for k, v in texts.items()}
    probes = [b"", b"a", b"abracadabra", "été bar".encode(), bytes(range(256)), b"zzzzzzab"]
    data, bounds = np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)])
    got = model.text_lengths(data, bounds)
    want = np.array([[brute[k].bits(p) for k in model.languages] for p in probes])
    assert got == pytest.approx(want, rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    model = langid.Ppm({"a": [b"abracadabra" * 3 + b" cab"]}, 2)
    for context in (b"ab", b"ra", b"zz", b"\0\0", b"az"):
        grams = np.array([context[0] << 16 | context[1] << 8 | s for s in range(256)], np.uint64)
        assert np.exp2(-model.code_length(grams)).sum() == pytest.approx(1)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(DOCS)
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_fit_reads_a_bounded_sample_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_CHARS", 50)
    rows = [(1, "same words again " * 40, "aa")] * 500 + [(i, f"other text number {i} " * 9, "bb") for i in range(2, 60)] + [(99, None, "cc"), (None, "x", "dd"), (77, "y", None)]
    seen = {}
    monkeypatch.setattr(langid, "Ppm", lambda texts, order: seen.update(texts))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=10)
    assert {k: len(v) for k, v in seen.items()} == {"aa": 1, "bb": 10}
    assert all(len(t) == 50 for v in seen.values() for t in v)


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    model = langid.fit(spark.read.parquet(DOCS))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ODD)
    assert Counter(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3)) == {True: 3}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = langid.keep_identified(docs, model, least_score=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 3
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


PIECES = {"▁": -5.0, "▁a": -1.0, "▁ab": -1.5, "b": -2.0, "bc": -1.0, "c": -2.0, "abc": -0.5, "cc": -2.0, "é": -3.0}


def brute_tokens(word, pieces):
    worst = min(pieces.values()) - tokencount.BYTE_PENALTY
    best = [(0.0, 0)]
    for n in range(1, len(word) + 1):
        size = len(word[n - 1].encode())
        options = [(best[n - 1][0] + size * worst, -(-best[n - 1][1] + size))]
        options += [(best[i][0] + pieces[word[i:n]], -(-best[i][1] + 1)) for i in range(n) if word[i:n] in pieces]
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcéz▁", min_size=1, max_size=12), min_size=1, max_size=12))
def test_trie_counts_equal_brute_force(words):
    words = sorted({"▁" + w for w in words} | {""}, key=hash)
    assert tokencount.Trie(PIECES).counts(words).tolist() == [brute_tokens(w, PIECES) for w in words]


def test_long_pretokens_and_odd_vocabularies(monkeypatch):
    words = ["▁" + "abcc" * 200, "▁abc", "▁\U0001f600é"]
    assert tokencount.Trie(PIECES).counts(words).tolist() == [brute_tokens(w, PIECES) for w in words]
    assert tokencount.Trie({}).counts(["ab", "é"]).tolist() == [2, 2]
    words += ["▁" + "abcc" * 60 + "b", "▁" + "abcc" * 60 + "cc", "▁" + "abcc" * 60, "▁b" * 50]
    assert tokencount.Trie(PIECES).counts(words).tolist() == [brute_tokens(w, PIECES) for w in words]
    monkeypatch.setattr(tokencount, "DEEP", 2)
    assert tokencount.Trie(PIECES).counts(words).tolist() == [brute_tokens(w, PIECES) for w in words]


def test_token_counts_of_documents(spark):
    docs = spark.read.parquet(DOCS)
    pieces = tokencount.vocabulary()
    texts = {r.doc_id: r.text for r in docs.collect()}
    memo = {}
    for r in tokencount.count_tokens(docs).limit(40).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert r.n_words == len(words)
        for w in set(words) - set(memo):
            memo[w] = brute_tokens("▁" + w, pieces)
        assert r.n_tokens == sum(memo[w] for w in words)
    got = tokencount.count_tokens(odd_documents(spark), pieces=PIECES).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2, 3))
    assert tokencount.count_tokens(docs.where("false")).count() == 0


def check_pieces(rows, texts, limits, padding_allowed=0, path=None):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path or packing.default_tokenizer())
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= min(limits.tokens, limits.loss_tokens) and len(own) <= limits.segments
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    assert padding <= padding_allowed


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=3), packing.Limits(tokens=128, segments=8, loss_tokens=100)])
def test_packing_round_trip(spark, limits):
    docs = spark.read.parquet(DOCS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack_documents(docs, limits=limits).collect()
    allowed = 0 if limits.loss_tokens >= limits.tokens else 10**9
    check_pieces(rows, texts, limits, allowed)


def test_packing_odd_rows(spark):
    df = odd_documents(spark)
    once = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(once, with_ids=True).collect()
    check_pieces(rows, {r.doc_id: r.text for r in once.collect()}, packing.Limits())
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(df).where("start = 0").count() == len(ODD)
    assert packing.pack_documents(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_and_other_tokenizers(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = dict(enumerate(["a<|endoftext|>b C", "<|STARTOFTEXT|> x", "<|startoftext|>", "Plain  Words\n\twith CASE", "<|", None, "It's 42 don't\u00a0x \u0130I"]))
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer=path).collect()
    check_pieces(rows, texts, packing.Limits(), path=path)


def word_texts(seed, signs, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices(signs, k=rng.randint(1, 20))) for _ in range(n * 10)] + ["a" * 70, "\u023a" * 33, "!" * 64, "12345", "ab.$$$,c"]
    return ["  ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]


def test_plain_words_are_merged_without_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    texts = word_texts(3, [*map(chr, range(0x41, 0x7F)), "the", "ing", "re", "\xe9", "\xdc", "\u0151", "..", "$$"])
    texts = [t.replace("a" * 70, "a" * 60).replace("\u023a" * 33, "\u023a" * 21) for t in texts]
    ids = packing.WordIds(path, 1)
    ids.tokenizer = ids.model = None  # no word is left to it
    plain = Tokenizer.from_file(path)
    for kind in (pa.string(), pa.large_string()):
        assert [x.tolist() for x in ids(pa.array(texts, kind))] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@pytest.mark.parametrize("model", [{}, {"ignore_merges": True}, {"end_of_word_suffix": None, "merges": [["t", "h"], ["a", "a"], ["aa", "a"], ["h", "e"], ["th", "e"]]}])
def test_words_get_the_ids_of_the_plain_tokenizer(tmp_path, model):
    from tokenizers import Tokenizer

    rules = json.loads(Path(packing.default_tokenizer()).read_text())
    rules["model"] |= model
    (path := tmp_path / "t.json").write_text(json.dumps(rules))
    plain = Tokenizer.from_file(str(path))
    every = [chr(c) for c in range(0x250)]
    texts = [*every, *(f"ab{c}cd.{c} {c}{c}" for c in every), *word_texts(5, [*every[0x21:], "the", "a", "\u03a3", "\u0301", "\u4e2d", "\U0001f600", "'s"]), "", None]
    got = [x.tolist() for x in packing.WordIds(str(path), 1, cached=500)(pa.array(texts))]
    assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_examples_stay_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(n), int(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 700, 900))] + [(900, 5000, 1), (901, None, 1), (902, 5, 1500), (903, -1, 0)]
    limits = packing.Limits(tokens=2048, segments=6, loss_tokens=1200)
    got = packing.pack_examples(spark.createDataFrame(rows, "k long, n long, m long").coalesce(2), "k", "n", "m", limits).collect()
    assert {r.id for r in got if r.sequence_id is None} == {900, 901, 902, 903}
    bins = defaultdict(list)
    for r in got:
        if r.sequence_id is not None:
            bins[r.sequence_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.tokens for r in own[:-1])]))
        assert sum(r.tokens for r in own) <= 2048 and len(own) <= 6 and sum(r.loss_tokens for r in own) <= 1200
    least = max(sum(r.tokens for r in got if r.sequence_id is not None) / 2048, 900 / 6)
    assert len(bins) <= 1.25 * least + 2


def brute_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    texts = ["a b c a b c", "a a a a", "a b a b a", "x y z\nx y z\n\n \nq", "#*$ %& |<> \U0001f600é", "l\n\nl\n \n l", "a b", "a b c", None, "", "w " * 500, "p q r s p q t p q r"]
    df = spark.createDataFrame([(i, t, "h", 9) for i, t in enumerate(texts)], "doc_id long, text string, source string, host long")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measures(df).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)}


def test_measures_beyond_packed_positions(spark, monkeypatch):
    monkeypatch.setattr(quality, "_POSITION_BITS", 4)
    text = "a b c " * 10 + " ".join(f"w{i}" for i in range(40)) + " a b c"
    got = quality.measures(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    assert got.n_repeat_words == brute_measures(text)[4]


def test_bad_hosts_fail_and_small_ones_are_drawn_to_the_mean(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "#" * 9 + " " + " ".join(f"w{i}" for i in range(80))
    rows = [(h * 1000 + i, good if i % 20 else "short", f"good{h}") for h in range(10) for i in range(60)]
    rows += [(20000 + i, bad, "bad") for i in range(60)] + [(30000, good, None), (30001, "short", "tiny")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept != got[i].base_failed for i, _, h in rows if h and h.startswith("good"))
    assert not any(got[20000 + i].kept or got[20000 + i].base_failed for i in range(60))
    assert got[30000].kept and not got[30001].kept
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(empty).count() == 0


def test_host_verdicts_decide_and_agree_with_the_sql(spark):
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(4)
    good = " ".join(f"w{i}" for i in range(80))
    rows = []
    for h, (size, rate) in enumerate([(300, 0.1), (200, 0.08), (400, 0.12), (250, 0.7), (60, 0.55), (5, 1.0), (2000, 0.1), (40, 0.3)]):
        rows += [(len(rows) + i, "short text" if rng.random() < rate else good, f"h{h}") for i in range(size)]
    df = pd.DataFrame([*rows, (len(rows), good, None), (len(rows), None, None)], columns=["doc_id", "text", "source"])
    got = {tuple(r) for r in quality.judge(spark.createDataFrame(list(df.itertuples(index=False, name=None)), "doc_id long, text string, source string")).collect()}
    con = duckdb.connect()
    con.register("documents", df)
    assert got == set(con.sql(quality.ORACLE_SQL).fetchall())
    hosts = dict(zip(df.doc_id, df.source, strict=True))
    dropped = {hosts[r[0]] for r in got if not r[6] and not r[7]}
    assert dropped == {"h3", "h4"}
