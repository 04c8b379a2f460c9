"""Quality rules with host-level verdicts.

Each document is measured by expressions over its whole text; rule failures are summed by host, every host's failure rate
is shrunk by a beta prior fitted to all hosts, and hosts whose rate is high beyond doubt take their documents with them.
Only DataFrame operations. The measures (a few numbers a document) are written once; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, let, written

# White space that separates words, symbol characters.
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: A host is refused when its shrunk failure rate is above this by CERTAINTY posterior standard deviations.
HOST_CEILING, CERTAINTY = 0.5, 3.0

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the list, the first occurrence included.

    Hashes of the windows only tell whether all differ; where they don't, windows themselves are sorted and compared.
    """
    n = F.size(words) - 2
    part = lambda k: F.slice(words, k, n)
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    hashes = F.transform(zipped, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    indexed = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(0), n - 1).alias("i"))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    exact = let(let(F.sort_array(indexed), starts), covered)
    return F.when(n < 2, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(exact)


def measures(text: Column) -> Column:
    """Struct of METRICS (long) of one text; null counts as no text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    gone = lambda chars: F.length(F.translate(text, chars, ""))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            gone(SPACES).cast("long").alias("word_chars"),
            (F.length(text) - gone(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


#: Rules by name: a condition on the measures that a sound document does not meet. The first two make up base_failed.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines > 5",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("too_short", "repetitive")


def beta_prior(p: dict) -> tuple[float, float]:
    """Beta prior (a, b) of hosts' failure rates by the method of moments.

    p: n (documents), n2 (sum of squared host sizes), f (failures), hosts, ss (sum over hosts of n * (rate - mean)^2).
    One host, no spread beyond chance or a mean of 0 or 1 give the strongest prior allowed, 1000 documents.
    """
    mean = min(max(p["f"] / p["n"], 1e-6), 1 - 1e-6) if p["n"] else 0.5
    spread = p["n"] - p["n2"] / p["n"] if p["n"] else 0.0
    between = (p["ss"] - (p["hosts"] - 1) * mean * (1 - mean)) / spread if spread > 0 else 0.0
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, host: str = "host") -> DataFrame:
    """One row per host: host, host_docs, shrunk failure rate by rule (rate_<rule>), host_refused.

    host_refused: for any rule, the posterior rate less CERTAINTY standard deviations exceeds HOST_CEILING. A host of
    few documents stays near the prior. The null host is a host. Only one row of sums for all hosts reaches the driver.
    """
    fails = [F.count_if(F.expr(c)).alias(f"f_{r}") for r, c in RULES.items()]
    hosts = written(measured.groupBy(host).agg(F.count("*").alias("host_docs"), *fails), "host-fails")
    sums = hosts.agg(F.sum("host_docs").alias("n"), F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("n2"), F.count("*").alias("hosts"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    n = sums["n"] or 0
    means = {r: (sums[r] or 0) / n if n else 0.5 for r in RULES}
    ss = hosts.agg(*[F.sum(F.col("host_docs") * F.pow(F.col(f"f_{r}") / F.col("host_docs") - F.lit(means[r]), 2)).alias(r) for r in RULES]).first()
    out, refused = [F.col(host), F.col("host_docs")], F.lit(False)
    for r in RULES:
        a, b = beta_prior({"n": n, "n2": sums["n2"] or 0.0, "hosts": sums["hosts"], "f": sums[r] or 0, "ss": ss[r] or 0.0})
        rate = (F.col(f"f_{r}") + a) / (F.col("host_docs") + a + b)
        out.append(rate.alias(f"rate_{r}"))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + a + b + 1))
        refused = refused | (rate - CERTAINTY * deviation > HOST_CEILING)
    return hosts.select(*out, refused.alias("host_refused"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rules and host verdicts of all documents: doc_id, host, METRICS, fail_<rule>, base_failed, host_refused, kept.

    A null or empty text has no words and fails as too short; repeated rows are measured each; a null host is a host of
    its own; an empty table gives no rows. kept: the document passes the base rules and its host is not refused.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    m = written(m.select("doc_id", "host", "m.*"), "doc-measures")
    hosts = written(host_verdicts(m), "host-verdicts")
    out = join_groups(m, hosts, "host", "host_docs", m.count())
    base = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    return out.select("doc_id", "host", *METRICS, *[F.expr(c).alias(f"fail_{r}") for r, c in RULES.items()], base.alias("base_failed"), "host_refused", (~base & ~F.col("host_refused")).alias("kept"))


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdicts of all rows; nulls, empty texts, repeated rows and empty tables as in quality_rules(). Very long
    texts are measured whole; ties play no part."""
    return quality_rules(docs).select("doc_id", *METRICS, "base_failed", "host_refused", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT w.doc_id, w.host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN ln ON w.doc_id = ln.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, n_dup_lines > 5,
    word_chars < 2 * n_words OR word_chars > 15 * n_words] AS failed, failed[1] OR failed[2] AS base_failed FROM m),
h AS (SELECT rule, host, count(*) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS f
  FROM (SELECT host, unnest(range(1, 6)) AS rule, unnest(failed) AS failed FROM b) GROUP BY rule, host),
t AS (SELECT rule, sum(n) AS n, sum(n * n) AS n2, count(*) AS hosts, sum(f) / sum(n) AS mean FROM h GROUP BY rule),
v AS (SELECT rule, any_value(t.n) AS n, any_value(n2) AS n2, any_value(hosts) AS hosts, greatest(least(any_value(mean), 1 - 1e-6), 1e-6) AS mean,
    sum(h.n * (f / h.n - mean) ** 2) AS ss FROM h JOIN t USING (rule) GROUP BY rule),
g AS (SELECT rule, mean, CASE WHEN n - n2 / n > 0 THEN (ss - (hosts - 1) * mean * (1 - mean)) / (n - n2 / n) ELSE 0 END AS between_hosts FROM v),
k AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 2), 1000) ELSE 1000 END AS strength FROM g),
r AS (SELECT host, (f + mean * strength) / (n + strength) AS rate, n + strength + 1 AS size FROM h JOIN k USING (rule)),
x AS (SELECT host, bool_or(rate - 3 * sqrt(rate * (1 - rate) / size) > 0.5) AS host_refused FROM r GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_refused,
  NOT base_failed AND NOT host_refused AS kept
FROM b JOIN x ON b.host IS NOT DISTINCT FROM x.host
"""
