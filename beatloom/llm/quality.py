"""Quality rules with host verdicts, in built-in column expressions only.

Each document is measured once. Rule failures are counted per host, the rates
are shrunk towards the common rate with a beta prior fitted to all hosts, and the
host's verdict goes back to its documents: any failed rule drops a document, and
on a distrusted host, one whose shrunk rate is well above the common rate, the
limits are twice as strict. A document that is clean by
the strict limits is kept whatever its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.session import materialise

SPACE = r"[\x20\x09-\x0D]"
# Limits of the rules.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
MAX_SYMBOLS_PCT, MAX_DUP_LINES_PCT = 10, 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 3, 12
DISTRUST = 1.25  # times the common failure rate


def repeat_positions(hashes: str) -> Column:
    """Positions, in order, of the values that an array holds more than once. Sorted
    with the whole value in front, so equal values are always neighbours."""
    pairs = F.sort_array(F.transform(hashes, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # each value's neighbours are looked up once in the sorted array
    again = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)) | F.when(i > 0, F.get(s, i - 1)["g"] == x["g"]).otherwise(F.lit(False)))
    found = F.flatten(F.transform(F.array(pairs), again))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text has no words. A window is three words; equal windows are those of
    equal 64-bit hashes.
    """
    d = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", F.filter(F.split("_t", f"{SPACE}+"), lambda w: w != "").alias("_w"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window))
        .otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    d = d.withColumn("_p", repeat_positions("_g"))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def failures(strict: int = 1) -> list[Column]:
    """One boolean per rule over the columns of ``measure``; ``strict`` divides
    the allowed shares of symbols and repeated lines."""
    c = F.col
    return [
        c("n_words") < MIN_WORDS,
        100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words"),
        100 * strict * c("n_symbols") > MAX_SYMBOLS_PCT * c("n_words"),
        100 * strict * c("n_dup_lines") > MAX_DUP_LINES_PCT * c("n_lines"),
        (c("word_chars") < MIN_WORD_CHARS * c("n_words")) | (c("word_chars") > MAX_WORD_CHARS * c("n_words")),
    ]


def host_rates(failed: DataFrame, host: str = "host") -> DataFrame:
    """host, n_docs, n_failed, rate (posterior mean of the host's failure rate) and
    common (mean of the prior).

    The beta prior has the mean and variance of the hosts' rates (method of
    moments, at least two pseudo-documents); one host or equal rates leave a weak
    prior at the common mean. Documents with a null host share one.
    """
    h = failed.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("failed").alias("n_failed"))
    r = F.col("n_failed") / F.col("n_docs")
    p = h.agg(F.avg(r).alias("_m"), F.coalesce(F.var_samp(r), F.lit(0.0)).alias("_v"))
    strength = F.when(F.col("_v") > 0, F.greatest(F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1, F.lit(2.0))).otherwise(2.0)
    p = p.select("_m", strength.alias("_k"))
    # the prior is one row
    rate = (F.col("n_failed") + F.col("_m") * F.col("_k")) / (F.col("n_docs") + F.col("_k"))
    return h.crossJoin(F.broadcast(p)).select(host, "n_docs", "n_failed", rate.alias("rate"), F.col("_m").alias("common"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", distrust: float = DISTRUST) -> DataFrame:
    """One row per document: key, measures, n_failed_rules, n_failed_strict,
    host_rate, host_distrusted, base_failed, kept.

    A host is distrusted if its shrunk failure rate is more than ``distrust`` times
    the common rate.

    ``base_failed`` (too short, or mostly repeated windows) drops a document by
    itself. Empty and null texts fail it. The host table joins on its name; Spark
    broadcasts it if it is small and splits a hot host otherwise.
    """
    d = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    m = measure(d, "_text", (key, "_host"))
    n = {name: sum((f.cast("int") for f in failures(strict)), F.lit(0)) for name, strict in (("n_failed_rules", 1), ("n_failed_strict", 2))}
    # measured once; read for the host rates and for the documents
    m = materialise(m.withColumns(n))
    rates = host_rates(m.select("_host", (F.col("n_failed_rules") > 0).alias("failed")), "_host")
    rates = rates.select("_host", F.col("rate").alias("host_rate"), (F.col("rate") > distrust * F.col("common")).alias("host_distrusted"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    failed = F.when(F.col("host_distrusted"), F.col("n_failed_strict")).otherwise(F.col("n_failed_rules"))
    out = m.join(rates, "_host").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (failed == 0)).drop("_host")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, all columns unchanged. Keys are unique."""
    good = judge(docs, key, text, host).filter("kept").select(key)
    return docs.join(good, key, "left_semi").select(*docs.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_rules",
        "host_distrusted",
    )


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS p, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS k FROM g),
r AS (SELECT doc_id, p FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, (n_words < 50)::INT + (100 * n_repeat_words > 50 * n_words)::INT + (100 * n_symbols > 10 * n_words)::INT
  + (100 * n_dup_lines > 30 * n_lines)::INT + (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT AS n_failed_rules,
  200 * n_symbols > 10 * n_words OR 200 * n_dup_lines > 30 * n_lines AS strict,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (n_failed_rules > 0) AS b FROM f GROUP BY host),
q AS (SELECT avg(b / n) AS m, coalesce(var_samp(b / n), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 2.0) ELSE 2.0 END AS k FROM q),
x AS (SELECT host, (b + m * k) / (n + k) > 1.25 * m AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_rules, bad AS host_distrusted,
  NOT base_failed AND n_failed_rules = 0 AND NOT (bad AND strict) AS kept FROM f JOIN x USING (host)
"""
