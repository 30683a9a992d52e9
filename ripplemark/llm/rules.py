"""Quality rules as a bitmask ledger, with DataFrame functions only.

`ledger` evaluates every rule once per document and stores its measurements and one failure bit
per rule.  Policies are versioned sets of rules; `apply_policy` is then one bitwise AND, and
`ablations` counts, by bitwise aggregation of the bits alone, what each rule rejects on its own.

Null or empty texts have no words, all measurements 0, and fail the base rule on few words.
Repeated documents each get their row; further columns are kept by `ledger` unless a name of the
ledger clashes with them, then the ledger's column stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_prefix

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]+"


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows whose words occur twice or more in the array, each word once.

    Windows are compared by a 64-bit hash within one document; equal windows are found by sorting.
    """
    spots = F.when(
        F.size(words) >= window,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(window)]).alias("h"), i.alias("p")))),
    )
    return spots


def _covered(spots: Column, window: int = 3) -> Column:
    twice = F.sort_array(F.filter(F.transform(spots, lambda x, i: F.when((x["h"] == F.get(spots, i - 1)["h"]) | (x["h"] == F.get(spots, i + 1)["h"]), x["p"])), lambda p: p.isNotNull()))
    return twice


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper."""
    own = free_prefix(docs)
    body, words, lines, spots, twice = (f"{own}_{x}" for x in ("body", "words", "lines", "spots", "twice"))
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        words: F.array_remove(F.split(body, SPACES), ""),
        lines: F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "word_chars": F.length(F.regexp_replace(body, SPACES, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))).cast("long"),
    })
    out = out.withColumns({"n_words": F.size(words).cast("long"), "n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), spots: repeated_words(F.col(words))})
    out = out.drop(words, lines, body).withColumn(twice, _covered(F.col(spots))).drop(spots)
    gap = F.transform(twice, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col(twice), i + 1) - x, F.lit(3))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")).drop(twice)


#: Rule name -> when it fails, over the measurements.  The position in this table is the bit.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_upper > word_chars",
}

#: Policy version -> its rules.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "v2": list(RULES),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all measurements and `failed`, a bit for each rule that fails."""
    bits = [F.expr(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END") for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs, text).withColumn("failed", total)


def apply_policy(rows: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    """Ledger rows with the policy's verdict."""
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that only it rejects, rows kept without it.

    Rows are first counted by their bits, so no more than 2^rules rows are worked on.
    """
    bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = bits.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the ledger of every document, and the verdict of policy v2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_policy(apply_policy(ledger(docs), "base", "_base"), "v2")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failed")


_W = "[\\x20\\x09-\\x0D]"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, list_filter(string_split_regex(body, '{_W}+'), lambda x: x <> '') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, generate_subscripts(words, 1) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM p WHERE i + 2 <= len(words)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(body, '{_W}+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                   + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END
                   + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
                   + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
                   + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
