"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.llm.common import cut, fresh, let, table

# The patterns and least lengths of the base kinds.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
# a run shorter than the least length fails, and so does every later start in it
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Strings that the battery looks at, and the encodings that it infers, first fit first. A string may stand right after '=',
#: as the values of name=value and of query strings do.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[A-Za-z])([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
)
CELLS = 5
#: Length classes of the false-discovery control, by their least length.
LENGTHS = (20, 32, 64)
#: Largest share of ordinary strings among those reported, and the p-value below which no string is reported.
RATE, LEAST_P = 0.1, 0.01
#: p-values count in steps of one in so many.
STEPS = 1000
MARK = "[SECRET]"
#: A text with spans is redacted in pieces of so many code points.
PIECE = 4096


def running_total(values: Column, block: int = 64) -> Column:
    """Sums of all earlier elements, for each element of an array; in blocks, so the work stays near linear."""
    zero = F.lit(0)
    total = lambda a: F.aggregate(a, zero, lambda n, x: n + x)
    inside = lambda base, a: F.transform(a, lambda x, i: base + total(F.slice(a, F.lit(1), i)))

    def of(a: Column) -> Column:
        numbers = F.sequence(zero, F.floor((F.size(a) - 1) / block).cast("int"))
        parts = F.transform(numbers, lambda c: F.slice(a, c * block + 1, F.lit(block)))
        by_part = lambda ps, sums: F.flatten(F.transform(ps, lambda p, c: let(total(F.slice(sums, F.lit(1), c)), lambda base: inside(base, p))))
        return let(parts, lambda ps: let(F.transform(ps, total), lambda sums: by_part(ps, sums)))

    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(of(a)))


def found(text: Column, pattern: str, kind: int, maybe: Column | None = None) -> Column:
    """Array of (start, kind, end, body) of the leftmost non-overlapping matches, in code points."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>")

    def of(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(F.transform(gaps, lambda x: F.length(x)), F.transform(hits, lambda x: F.length(x)), lambda g, n: F.struct(g.alias("gap"), n.alias("size")))

        def placed(p: Column) -> Column:
            before = running_total(F.transform(p, lambda x: x.gap + x.size))
            start = F.zip_with(before, p, lambda b, x: b + x.gap)
            return F.zip_with(start, hits, lambda s, h: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(h)).alias("end"), h.alias("body")))

        return let(pairs, placed)

    sure = text.rlike(pattern) if maybe is None else maybe & text.rlike(pattern)
    return F.when(sure, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    assign = found(text, ASSIGN, 0, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    value = lambda s: F.length(F.regexp_extract(s.body, ASSIGN, 2))
    return F.filter(assign, lambda s: value(s) >= ASSIGN_LEAST), found(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))), found(text, HEX, 2)


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal Z (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    # Coefficients of the published approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    return let(1 / (1 + p * x), lambda t: t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * F.exp(-x * x))


def battery(body: Column) -> Column:
    """p-value of "these are random draws from the alphabet of the inferred encoding"; null if no encoding fits.

    Fisher's sum of three p-values: chi-squared of five alphabet cells, runs above and below the
    middle of the alphabet, and the lag-1 serial correlation. All come from sums of one pass over the characters.
    """
    sums = ("n", "up", "runs", "total", "squares", "lag", *(f"c{b}" for b in range(1, CELLS)))

    def of_encoding(s: Column, alphabet: str) -> Column:
        size = len(alphabet)
        digits = F.transform(F.slice(F.split(s, ""), F.lit(1), F.length(s)), lambda c: F.position(c, F.lit(alphabet)) - 1)
        edges = [-(-b * size // CELLS) for b in range(CELLS + 1)]
        start = F.struct(*[F.lit(0).cast("long").alias(x) for x in sums], F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        one = lambda cond: F.when(cond, 1).otherwise(0).cast("long")
        high = lambda x: x >= size // 2

        def step(a: Column, x: Column) -> Column:
            begun = a["last"] >= 0
            added = {
                "n": F.lit(1).cast("long"), "up": one(high(x)), "runs": one(~begun | (high(x) != high(a["last"]))), "total": x.cast("long"),
                "squares": (x * x).cast("long"), "lag": F.when(begun, x * a["last"]).otherwise(0).cast("long"), **{f"c{b}": one(x >= edges[b]) for b in range(1, CELLS)},
            }
            return F.struct(*[(a[k] + added[k]).alias(k) for k in sums], F.when(begun, a["first"]).otherwise(x).alias("first"), x.alias("last"))

        def of(t: Column) -> Column:
            n, up, runs = (t[k].cast("double") for k in ("n", "up", "runs"))
            above = [n, *(t[f"c{b}"].cast("double") for b in range(1, CELLS)), F.lit(0.0)]
            chi = F.lit(0.0)
            for b in range(CELLS):
                want = n * ((edges[b + 1] - edges[b]) / size)
                chi = chi + (above[b] - above[b + 1] - want) * (above[b] - above[b + 1] - want) / want
            uniform = let(chi, lambda x: F.exp(-x / 2) * (1 + x / 2))
            expected = 2 * up * (n - up) / n + 1
            spread = let(expected, lambda m: (m - 1) * (m - 2) / (n - 1))
            by_runs = let(spread, lambda v: F.when(v > 0, two_sided((runs - expected) / F.sqrt(v))).otherwise(F.lit(0.0)))
            mean = t["total"] / n
            var = t["squares"] - n * mean * mean
            lag = t["lag"] - mean * (2 * t["total"] - t["first"] - t["last"]) + (n - 1) * mean * mean
            serial = let(var, lambda v: F.when(v > 1e-9, two_sided((n * lag / v + 1) / F.sqrt(n))).otherwise(F.lit(0.0)))
            half = F.aggregate(F.array(uniform, by_runs, serial), F.lit(0.0), lambda a, p: a - F.ln(F.greatest(p, F.lit(1e-15))))
            return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        return let(F.aggregate(digits, start, step), of)

    plain = F.translate(F.rtrim(body, F.lit("=")), "-_", "+/")

    def pick(s: Column) -> Column:
        out = F
        for name, shape, alphabet in ENCODINGS:
            out = out.when(s.rlike(shape), of_encoding(F.lower(s) if name in ("hex", "base36") else s, alphabet))
        return out

    return let(plain, pick)


def candidates(text: Column, base: Column) -> Column:
    """Spans of the battery that no base span overlaps, each with the p-value of its string."""
    tested = F.transform(found(text, CANDIDATE, 3), lambda s: F.struct(s.start, s.kind, s.end, (s.end - s.start).alias("size"), battery(s.body).alias("p")))
    free = lambda s: s.p.isNotNull() & ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end))
    return F.filter(tested, free)


def _class(size: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS[1:], 1):
        out = F.when(size >= least, i).otherwise(out)
    return out


def limits(candidate_rows: DataFrame, rate: float = RATE) -> list[float]:
    """The p-value from which strings are reported as random, for each length class (2.0: none are).

    p-values of random strings are uniform, those of ordinary text lie near zero. So twice the number of
    strings above one half (and one more) tells how many are random, and what is above a limit beyond the random
    ones' part and two standard errors of it is ordinary. The limit is the least one, LEAST_P at the lowest, at which
    ordinary strings are at most `rate` of those reported. Each class is controlled by itself, since short strings have little
    power and would else hide behind long ones. p-values count in whole steps, rounded down.
    """
    steps = F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS)).cast("int")
    counts = candidate_rows.where("p is not null").groupBy(_class(F.col("size")).alias("class"), steps.alias("step")).count().collect()  # LENGTHS x STEPS rows at most
    out = []
    for k in range(len(LENGTHS)):
        own = {r.step: r["count"] for r in counts if r["class"] == k}
        random = 2 * (sum(n for s, n in own.items() if 2 * s >= STEPS) + 1)
        best, above = 2.0, 0
        for s in range(STEPS, int(LEAST_P * STEPS) - 1, -1):
            above += own.get(s, 0)
            if own.get(s) and above - (random + 2 * math.sqrt(random)) * (1 - s / STEPS) <= rate * above:
                best = s / STEPS
        out.append(best)
    return out


def with_secrets(docs: DataFrame, name: str, text_col: str = "text", rate: float = RATE, kept: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (None: all) with one of all spans (start, kind, end), ordered by start and kind.

    Spans of the battery are the candidates whose p-value is at least the limit of their length class. Each text is scanned
    once: what was found is written down in the shared folder, and the limits and the spans both come from there.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    inner = fresh(docs, "_found")
    joined = lambda t: let(F.concat(*base_spans(t)), lambda base: F.struct(base.alias("base"), candidates(t, base).alias("random")))
    bare = lambda s: F.struct(s.start, s.kind, s.end)
    slim = lambda f: F.struct(F.transform(f.base, bare).alias("base"), f.random.alias("random"))
    seen = cut(docs.select(*[docs[c] for c in (docs.columns if kept is None else kept)], let(joined(text), slim).alias(inner)))
    at = limits(seen.select(F.explode(f"{inner}.random").alias("c")).select("c.size", "c.p"), rate)
    cut_at = lambda s: F.element_at(F.array(*[F.lit(x) for x in at]), _class(s["size"]) + 1)
    both = lambda f: F.array_sort(F.concat(f.base, F.transform(F.filter(f.random, lambda s: F.floor(s.p * STEPS) / STEPS >= cut_at(s)), bare)))
    return seen.withColumn(name, let(F.col(inner), both)).drop(inner)


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans and all spans of every document.

    A null or blank text has no spans: counts 0, the digest of the empty string and an empty span
    string. Repeated rows are scanned as often as they come. Columns besides the two are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = with_secrets(rows, "all_spans", kept=["doc_id"])
    count = lambda k: F.size(F.filter("all_spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("all_spans", lambda s: s.kind < 3)
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"),
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark in place of each run of overlapping spans; in pieces, so that the work stays near linear in the text."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(a: Column, s: Column) -> Column:
        goes_on = s.start < a["end"]
        last = F.struct(F.element_at(a["done"], -1).start.alias("start"), F.greatest(a["end"], s.end).alias("end"))
        longer = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(last))
        done = F.when(goes_on, longer).otherwise(F.concat(a["done"], F.array(F.struct(s.start.alias("start"), s.end.alias("end")))))
        return F.struct(done.alias("done"), F.greatest(a["end"], s.end).alias("end"))

    def of(runs: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            base = i * PIECE

            def cleaned(own: Column) -> Column:
                part = lambda m, j: let(
                    F.coalesce(F.get(own, j - 1).end - base, F.lit(0)),
                    lambda before: F.concat(F.substring(c, before + 1, F.greatest(m.start - base - before, F.lit(0))), F.when(m.start >= base, F.lit(mark)).otherwise("")),
                )
                rest = F.substring(c, F.element_at(own, -1).end - base + 1, F.lit(PIECE))
                return F.when(F.size(own) == 0, c).otherwise(F.concat(F.array_join(F.transform(own, part), ""), F.when(F.element_at(own, -1).end - base < PIECE, rest).otherwise("")))

            return let(F.filter(runs, lambda m: (m.start < base + PIECE) & (m.end > base)), cleaned)

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), piece), "")

    merged = F.aggregate(spans, F.struct(none.alias("done"), F.lit(0).alias("end")), merge, lambda a: a["done"])
    return let(merged, of)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = MARK) -> DataFrame:
    """docs with every secret span replaced by a mark; overlapping spans give one mark, and length_col follows the text.

    Null texts stay null, texts without a span as they are, and repeated rows repeated.
    """
    name = fresh(docs, "_spans")
    rows = with_secrets(docs, name, text_col)
    text = F.col(text_col)
    out = rows.withColumn(text_col, F.when(F.size(name) > 0, _without(text, F.col(name), mark)).otherwise(text)).drop(name)
    if length_col and length_col in out.columns:
        kind = dict(docs.dtypes)[length_col]
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.select(docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
