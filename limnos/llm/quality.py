"""Host-level quality rules, in DataFrame functions only.

Each document is measured once. Rule failures are summed by host; a host's rate of each rule is shrunk towards the rate
of all hosts by a beta prior with the moments of the host rates, so that a small host is not judged on a few documents;
a host with a shrunk rate over the limit is rejected, and the verdict goes back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import staged

BLANKS = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A host goes if the shrunk rate of one of its rules is above this.
HOST_LIMIT = 0.5
#: Weight of the prior in documents, at least and at most.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1e6
#: Rule and the condition under which a document fails it, over the measured columns.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more: hashes in order, neighbours compared."""
    def covered(pairs: Column) -> Column:
        def place(pair, i):
            same = (pair["h"] == F.get(pairs, i - 1)["h"]) | (pair["h"] == F.get(pairs, i + 1)["h"])
            return F.when(F.coalesce(same, F.lit(False)), pair["i"])
        places = F.sort_array(F.filter(F.transform(pairs, place), lambda x: x.isNotNull()))
        start = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["total"] + F.least(F.lit(3), x - acc["last"])).alias("total"), x.alias("last"))
        return F.aggregate(places, start, step)["total"]

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))

    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(window, of))


def measured(docs: DataFrame) -> DataFrame:
    """All columns of docs and a struct __m with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def long(value: Column, name: str) -> Column:
        return value.cast("long").alias(name)

    return docs.withColumn("__m", F.struct(
        _let(words, lambda w: F.struct(long(F.size(w), "n_words"), long(_repeat_words(w), "n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))).alias("l"),
        long(F.length(F.translate(text, BLANKS, "")), "word_chars"),
        long(length - F.length(F.translate(text, SYMBOLS, "")), "n_symbols")))


MEASURES = {"n_words": "__m.w.n_words", "word_chars": "__m.word_chars", "n_symbols": "__m.n_symbols",
            "n_dup_lines": "__m.l.n_dup_lines", "n_repeat_words": "__m.w.n_repeat_words", "n_lines": "__m.l.n_lines"}
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, <rule>_rate, host_kept) from measured rows with a `host` column.

    The prior of a rule has the mean m of the host rates and the weight m (1 - m) / variance - 1 in documents; one host,
    equal rates or a rate of 0 or 1 give the greatest weight.
    """
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.expr(f"CAST({rule} AS INT)")).alias(name) for name, rule in RULES.items()]), "hosts")
    moments = hosts.agg(*[f(F.col(name) / F.col("n")).alias(f"{name}_{part}") for name in RULES
                          for f, part in ((F.avg, "mean"), (F.var_samp, "var"))]).first()  # one row
    rates = {}
    for name in RULES:
        mean, var = moments[f"{name}_mean"] or 0.0, moments[f"{name}_var"] or 0.0
        weight = min(PRIOR_MOST, max(PRIOR_LEAST, mean * (1 - mean) / var - 1)) if var > 0 and 0 < mean < 1 else PRIOR_MOST
        rates[f"{name}_rate"] = (F.col(name) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    kept = F.lit(True)
    for rate in rates.values():
        kept = kept & (rate <= HOST_LIMIT)
    return hosts.select("host", *[rate.alias(name) for name, rate in rates.items()], kept.alias("host_kept"))


def _verdicts(rows: DataFrame) -> DataFrame:
    """Written, so that Spark knows its size when it chooses the join."""
    return staged(host_verdicts(rows).select(F.col("host").alias("__host"), "host_kept"), "host-verdicts")


def _judged(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    return rows.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")


def host_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row.

    Reads doc_id, text and source (the host). A null text is empty and fails the base rule; rows with a null source
    are one host; a null doc_id stays null; repeated rows count each; an empty table gives none.
    """
    rows = staged(measured(docs.select("doc_id", "text", F.col("source").alias("host"))).select(
        "doc_id", "host", *[F.col(path).alias(name) for name, path in MEASURES.items()]), "measured")
    judged = _judged(rows, _verdicts(rows)).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.select("doc_id", *[c for c in MEASURES if c != "n_lines"], "base_failed",
                         (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Texts are measured twice, for the hosts' verdicts and for their own, and are neither written nor shuffled for it.
    """
    named = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("text").alias("text"), F.col("source").alias("host"))
    rows = measured(named).select("__doc", "host", *[F.col(path).alias(name) for name, path in MEASURES.items()])
    return _judged(rows, _verdicts(rows)).where(f"host_kept AND NOT ({BASE_FAILED})").select("__doc.*")


def _rate(name: str) -> str:
    weight = (f"CASE WHEN v_{name} > 0 AND m_{name} > 0 AND m_{name} < 1 THEN least({PRIOR_MOST:.1f}, greatest({PRIOR_LEAST}, "
              f"m_{name} * (1 - m_{name}) / v_{name} - 1)) ELSE {PRIOR_MOST:.1f} END")
    return f"({name} + m_{name} * ({weight})) / (n + ({weight})) <= {HOST_LIMIT}"


#: DuckDB text. Words are what stands between ASCII blanks; a window's words are joined by a blank.
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM t),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, sum(least(3, coalesce(i - before, 3))) AS n FROM
            (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again) GROUP BY r),
m AS (SELECT doc_id, source AS host, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[ \\t-\\r]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines FROM w LEFT JOIN covered c USING (r)),
h AS (SELECT host, count(*) AS n, {', '.join(f'sum(({rule})::INT) AS {name}' for name, rule in RULES.items())} FROM m GROUP BY host),
p AS (SELECT {', '.join(f'avg({x} / n) AS m_{x}, var_samp({x} / n) AS v_{x}' for x in RULES)} FROM h),
v AS (SELECT host, {' AND '.join(_rate(x) for x in RULES)} AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND host_kept AS kept
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host
"""
