"""Quality rules with verdicts on hosts, in DataFrame functions only.

Every document is measured inside its row: words, symbols, repeated lines and words in repeated
three-word windows. Failures are summed by host. A host's failure rate is shrunk towards the others
by a beta prior, fitted to the counts of all hosts by beta-binomial moments: what the rates differ
by beyond the chance of few documents. A host is rejected when its odds of failure exceed a
multiple of the mean with high posterior probability, so a small host needs more evidence. The verdict goes back to
the documents: of a rejected host, those that fail any rule themselves go; of other hosts, those
that fail the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import staged, whole_row
from corpuslab.operators.joins import weighted_lookup

SPACE = r"[\x20\x09-\x0D]+"
# A host is bad if its odds of failure are above this multiple of those of all documents.
TIMES_ODDS = 3.0
# One-sided 95 % of the normal distribution, which stands for that of a host's rate.
CERTAINTY = 1.645
# Documents that the prior counts for when the counts do not tell, as with one document per host.
OPEN_STRENGTH = 100.0
# Bounds of the share of the variance that lies between hosts.
LEAST_SHARE, MOST_SHARE = 1e-6, 0.999


def _covered(places: Column) -> Column:
    """Words covered by the three-word windows that start at sorted places."""
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("l"))
    return F.aggregate(
        places,
        start,
        lambda a, i: F.struct(
            (a["c"] + F.least(F.lit(3), i - a["l"])).cast("long").alias("c"), i.alias("l")
        ),
        lambda a: a["c"],
    )


def measures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", also: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, host and the counts of each document, and columns that are ``also`` carried along.

    A null text counts as empty.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.col(text).alias("text"),
        *also,
    )
    split = base.select(
        "doc_id",
        "host",
        *also,
        F.array_remove(F.split(body, SPACE, -1), "").alias("words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.size(F.split(body, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
    )
    shifted = split.select(
        "doc_id",
        "host",
        *also,
        "n_symbols",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    windows = shifted.select(
        "doc_id",
        "host",
        *also,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.slice(
            F.transform(
                F.arrays_zip(
                    F.col("words").alias("a"),
                    F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"),
                    F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))).alias("c"),
                ),
                lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")),
            ),
            F.lit(1),
            F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("triples"),
    )
    # Equal windows are neighbours once sorted; arrays are columns, so each is computed once.
    ordered = windows.withColumn("t", F.array_sort("triples")).drop("triples")
    after = F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1)))
    paired = ordered.withColumn("same", F.zip_with("t", after, lambda a, b: a["h"] == b["h"]))
    flagged = F.arrays_zip(
        F.col("t"), F.col("same").alias("n"), F.concat(F.array(F.lit(False)), "same").alias("p")
    )
    places = F.transform(F.filter(flagged, lambda x: x["n"] | x["p"]), lambda x: x["t"]["i"])
    return paired.withColumn("n_repeat_words", _covered(F.sort_array(places))).drop("t", "same")


def rule_failures(measured: DataFrame) -> DataFrame:
    """Adds base_failed, and failed: the base rules or one of the others.

    The other rules: mean word length from 2 to 15, at most a symbol for every ten words, at most
    30 % repeated lines.
    """
    words = F.col("n_words")
    base = (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)
    other = (
        (F.col("word_chars") < 2 * words)
        | (F.col("word_chars") > 15 * words)
        | (10 * F.col("n_symbols") > words)
        | (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))
    )
    return measured.withColumn("base_failed", base).withColumn("failed", base | other)


def fitted_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength (its weight in documents) of the beta prior of (n_docs, n_failed).

    With N documents of h hosts and mean m, the sum of n_i (p_i - m)^2 is expected to be
    m (1 - m) ((h - 1) + share (N - sum n_i^2 / N - (h - 1))), the share being 1 / (strength + 1).
    """
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(
        F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("s")
    ).first()
    if not sums["h"]:
        return 0.0, OPEN_STRENGTH
    mean = sums["k"] / sums["n"]
    chance = mean * (1 - mean)
    room = sums["n"] - sums["nn"] / sums["n"] - (sums["h"] - 1)
    if chance <= 0 or room <= 1e-9:
        return mean, OPEN_STRENGTH
    share = ((sums["s"] - sums["n"] * mean * mean) / chance - (sums["h"] - 1)) / room
    return mean, 1 / min(max(share, LEAST_SHARE), MOST_SHARE) - 1


def host_verdicts(failures: DataFrame, times_odds: float = TIMES_ODDS, certainty: float = CERTAINTY) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk) and rejected, one row per host.

    A host is rejected if ``certainty`` standard deviations below its rate the odds are still above
    ``times_odds`` times those of the mean. The prior is one row, so it comes to the driver.
    """
    hosts = staged(
        failures.groupBy("host").agg(
            F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
        ),
        "hosts",
    )
    mean, strength = fitted_prior(hosts)
    weight = F.col("n_docs") + F.lit(strength)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / weight
    deviation = F.sqrt(rate * (1 - rate) / (weight + 1))
    rejected = rate - F.lit(certainty) * deviation > F.lit(times_odds * mean / (1 + (times_odds - 1) * mean))
    return hosts.withColumn("rate", rate).withColumn("rejected", rejected)


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """One row per document: its measures, base_failed and kept.

    Null and empty texts have no words and fail; a missing host is the host ''. Repeated and missing
    doc_ids are rows of their own, an empty table gives no rows, very long texts are measured whole,
    other columns are left out, whatever their names. Hosts with many documents meet a broadcast of
    fewer than 1000 verdicts, so no task gets all documents of a host.
    """
    failures = staged(rule_failures(measures(docs, doc_id, text, host)), "measures")
    verdicts = staged(host_verdicts(failures).select("host", "n_docs", "rejected"), "verdicts")
    judged = weighted_lookup(failures, verdicts, "host", "n_docs")
    kept = ~F.col("base_failed") & ~(F.col("rejected") & F.col("failed"))
    return judged.withColumn("kept", kept).drop("rejected", "failed")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever their names.

    Every row is judged on its own, as in ``judge``: repeated and missing doc_ids, null and very
    long texts, missing hosts, empty tables. A row is carried as one struct beside its measures and
    written once, without those that fail the base rules. Rows that fail no rule are kept as they
    are read back; only the others that remain meet the verdict on their host.
    """
    carried = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source"), whole_row(docs, "row")
    )
    measured = rule_failures(measures(carried, also=("row",)))
    row = F.when(~F.col("base_failed"), F.col("row")).alias("row")
    judged = staged(measured.select("host", "base_failed", "failed", row), "judged")
    verdicts = staged(host_verdicts(judged).select("host", "n_docs", "rejected"), "verdicts")
    good = judged.filter(~F.col("failed")).select("row")
    asked = judged.filter(F.col("failed") & ~F.col("base_failed"))
    spared = weighted_lookup(asked, verdicts, "host", "n_docs").filter(~F.col("rejected")).select("row")
    return good.unionByName(spared).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents
), p AS (
  SELECT doc_id, host, body,
         list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS triple
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM p)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, triple) AS n FROM w)
  WHERE n > 1
), c AS (
  SELECT doc_id, CAST(sum(least(3, i - coalesce(before, -3))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)
  GROUP BY doc_id
), m AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM p LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), f AS (
  SELECT *, base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM b
), h AS (
  SELECT host, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM f GROUP BY host
), sums AS (
  SELECT count(*) AS h, CAST(sum(n) AS DOUBLE) AS n, sum(k) / sum(n) AS m, sum(CAST(n AS DOUBLE) * n) AS nn,
         sum(CAST(k AS DOUBLE) * k / n) AS s
  FROM h
), prior AS (
  SELECT m, CASE WHEN m * (1 - m) <= 0 OR n - nn / n - (h - 1) <= 1e-9 THEN 100
            ELSE 1 / least(greatest(((s - n * m * m) / (m * (1 - m)) - (h - 1)) / (n - nn / n - (h - 1)), 1e-6), 0.999) - 1
            END AS s
  FROM sums
), rates AS (
  SELECT host, m, n + s AS weight, (k + m * s) / (n + s) AS rate FROM h, prior
), verdict AS (
  SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 3 * m / (1 + 2 * m) AS rejected FROM rates
)
SELECT doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
       base_failed, NOT base_failed AND NOT (rejected AND failed) AS kept
FROM f JOIN verdict USING (host)
"""
