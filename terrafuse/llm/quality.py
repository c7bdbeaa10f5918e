"""Quality rules with verdicts on hosts: failure rates by domain, shrunk with an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.llm.common import SPACE_CLASS, SPACES, cut, hot_join, let, table, words_of

SYMBOLS = "#*$%&|<>"
#: Rules on the measures of one document. The first two are the base rules, which fail the document by itself.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
}
BASE_RULES = ("short", "repeats")
#: A host fails if one of its rules surely fails too often: the posterior rate, less CERTAIN of its standard deviations, is
#: above so many times the common rate, taken within the two bounds.
TIMES, BOUNDS, CERTAIN = 2.0, (0.25, 0.5), 1.645
#: Word positions are packed beside hashes of their windows in so many bits; longer texts sort pairs instead.
_POSITION_BITS = 22


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are compared by hash first; only those whose hash occurs twice are compared as text, so
    the count is exact and most texts need no sort of strings.
    """

    def of(w: Column) -> Column:
        window = lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2])
        at = F.sequence(F.lit(0), F.size(w) - 3)
        low = F.lit((1 << _POSITION_BITS) - 1).cast("long")
        keyed = F.transform(at, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~((1 << _POSITION_BITS) - 1)).cast("long")).bitwiseOR(i.cast("long")))

        def suspects(k: Column) -> Column:
            other = lambda a, b: F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)
            before = F.concat(F.array(F.lit(None).cast("long")), F.slice(k, 1, F.size(k) - 1))
            after = F.concat(F.slice(k, 2, F.size(k) - 1), F.array(F.lit(None).cast("long")))
            flagged = F.zip_with(F.zip_with(before, k, lambda a, b: F.coalesce(other(a, b), F.lit(False))), F.zip_with(k, after, lambda a, b: F.coalesce(other(a, b), F.lit(False))), lambda x, y: x | y)
            return F.filter(F.zip_with(flagged, k, lambda f, x: F.when(f, x.bitwiseAND(low).cast("int"))), lambda x: x.isNotNull())

        places = F.when(F.size(w) < (1 << _POSITION_BITS), let(F.sort_array(keyed), suspects)).otherwise(at)
        exact = lambda p: F.array_sort(F.transform(p, lambda i: F.struct(window(i).alias("text"), i.alias("at"))))

        def covered(s: Column) -> Column:
            none = F.lit(None).cast("string")
            texts = F.transform(s, lambda x: x.text)
            def count(t: Column) -> Column:
                before = F.concat(F.array(none), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))))
                after = F.concat(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.array(none))
                same = F.zip_with(F.zip_with(before, t, lambda a, b: a.eqNullSafe(b)), F.zip_with(t, after, lambda a, b: a.eqNullSafe(b)), lambda x, y: x | y)
                first = F.filter(F.zip_with(same, s, lambda f, x: F.when(f, x["at"])), lambda x: x.isNotNull())
                return F.size(F.array_distinct(F.flatten(F.transform(first, lambda i: F.array(i, i + 1, i + 2)))))
            return let(texts, count)

        return let(places, lambda p: F.when(F.size(p) < 2, F.lit(0)).otherwise(let(exact(p), covered)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(of(words)).cast("long")


def _symbols(text: Column) -> Column:
    left = text
    for c in SYMBOLS:
        left = F.replace(left, F.lit(c))
    return (F.length(text) - F.length(left)).cast("long")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the base measures of every whole text; a null text has no words."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[host_col].cast("string").alias("host"), text.alias("text"))
    counted = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    rows = rows.select("doc_id", "host", counted.alias("c"), _symbols(F.col("text")).alias("n_symbols"), _duplicate_lines(F.col("text")).alias("n_dup_lines"))
    return rows.select("doc_id", "host", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


def host_verdicts(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, n_docs, <rule>_rate for each rule, host_failed) from rows of measures().

    Each rule's failures by host are Beta-binomial; the prior's mean and weight come from the moments of
    all hosts (their spread beyond binomial noise), so small hosts are drawn towards the common rate. A host fails if the
    posterior of one rule lies above the limit with a probability of 95 % (by its mean and standard deviation).
    """
    failed = {r: F.sum(F.expr(f"({e})").cast("long")).alias(f"{r}_n") for r, e in rules.items()}
    hosts = cut(measured.groupBy("host").agg(F.count("*").alias("n_docs"), *failed.values()))
    moments = []
    for r in rules:
        f, n = F.col(f"{r}_n"), F.col("n_docs")
        moments += [F.sum(f).alias(f"{r}_f"), F.sum(f * f / n).alias(f"{r}_ff")]
    total = hosts.agg(F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), *moments).first()
    out, bad = hosts, F.lit(False)
    for r in rules:
        n, k = float(total["n"] or 1), float(total["hosts"] or 1)
        mean = float(total[f"{r}_f"] or 0) / n
        spread = max(float(total[f"{r}_ff"] or 0) / n - mean * mean - mean * (1 - mean) * k / n, 1e-9)
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
        limit = min(max(TIMES * mean, BOUNDS[0]), BOUNDS[1])
        rate, seen = F.col(f"{r}_rate"), F.col("n_docs") + weight
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_n") + mean * weight) / seen)
        bad = bad | (rate - CERTAIN * F.sqrt(rate * (1 - rate) / (seen + 1)) > limit)
    return out.select("host", "n_docs", *[f"{r}_rate" for r in rules], bad.alias("host_failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES) -> DataFrame:
    """Measures, base_failed and kept of every document.

    A document is kept if neither it nor its host fails. Null hosts are one host of their own. Repeated rows are judged and
    counted as often as they come. Columns besides the three are not read. No rows give no rows. A host may hold any part of all rows.
    """
    named = F.when(F.col("host").isNull(), "").otherwise(F.concat(F.lit("="), "host"))
    measured = cut(measures(docs, id_col, text_col, host_col).withColumn("host", named))
    verdicts = cut(host_verdicts(measured, rules).select("host", "n_docs", "host_failed"))
    base = F.expr(" or ".join(f"({RULES[r]})" for r in BASE_RULES))
    return hot_join(measured, verdicts, "host", "n_docs").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~F.col("host_failed")).alias("kept"),
    )


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_WORDS = f"list_filter(string_split_regex(t, '{SPACE_CLASS}+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT source, rule, count(*) AS n, sum(CASE WHEN failed THEN 1.0 ELSE 0.0 END) AS k
      FROM (SELECT source, 'short' AS rule, n_words < 50 AS failed FROM m
            UNION ALL SELECT source, 'repeats', 100 * n_repeat_words > 50 * n_words FROM m
            UNION ALL SELECT source, 'symbols', 10 * n_symbols > n_words FROM m)
      GROUP BY source, rule),
t AS (SELECT rule, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS hosts, sum(k)::DOUBLE / sum(n) AS mean, sum(k::DOUBLE * k / n) / sum(n) AS sq FROM f GROUP BY rule),
p AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * hosts / n, 1e-9) - 1, 1.0), 1e6) AS weight FROM t),
q AS (SELECT source, least(greatest({TIMES} * mean, {BOUNDS[0]}), {BOUNDS[1]}) AS most, (k + mean * weight) / (n + weight) AS rate, n + weight AS seen FROM f JOIN p USING (rule)),
h AS (SELECT source, bool_or(rate - {CERTAIN}::DOUBLE * sqrt(rate * (1 - rate) / (seen + 1)) > most) AS host_failed FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(host_failed, false) AS kept
FROM m LEFT JOIN h ON m.source IS NOT DISTINCT FROM h.source
"""
