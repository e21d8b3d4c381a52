"""Quality rules: a table of thresholds compiled into native Spark columns.

RULES names a measure and the range it must keep to; `verdict` turns the table into one boolean
column. All measures are built-in expressions on the row itself: no user functions, no shuffle.

Defined results: null or wordless text has no words, so it fails the base rule; ratios of such texts
are 0; an empty table gives no rows; repeated rows are each judged; very long texts are measured whole;
a measure at the end of its range passes; other columns, whatever their names, stay in `row`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import common

#: Frequent words of four languages.
STOP_WORDS = (
    "the of and to a in is it that for was on are with as at be this by "
    "de la le les et un une des du que en est pour qui dans par sur pas au avec "
    "der die und den das von mit sich ist im dem nicht ein eine als auf "
    "el los las y para con por se su al lo del"
).split()
#: (measure, least, most): a text is kept if each measure lies in its range.
RULES = [
    ("mean_word_chars", 2.5, 12.0),
    ("symbols_per_word", 0.0, 0.1),
    ("exclamations_per_word", 0.0, 0.5),
    ("stop_word_ratio", 0.05, 1.0),
    ("dup_line_ratio", 0.0, 0.3),
    ("distinct_word_ratio", 0.15, 1.0),
    ("bullet_line_ratio", 0.0, 0.9),
    ("ellipsis_line_ratio", 0.0, 0.3),
]
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\u000b\f\r"


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in a window of 8 words that is found twice or more in the text."""
    hashed = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hashes") - WINDOW
    window = lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))
    hashed = hashed.withColumn("_windows", F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), window)).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window pay for sorting (window, place) pairs.
    pairs = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    sorted_ = hashed.withColumn("_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs).otherwise(none))
    same = lambda p, k: F.coalesce(F.get("_pairs", k)["h"] == p["h"], F.lit(False))
    twins = F.filter("_pairs", lambda p, k: same(p, k - 1) | same(p, k + 1))
    placed = sorted_.withColumn("_at", F.sort_array(F.transform(twins, lambda p: p["i"])))
    covered = F.transform("_at", lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - a, F.lit(WINDOW))).cast("long"))
    return placed.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns `row` (the document) and `quality`, a struct of all measures."""
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    df = df.select("_row", text.alias("_text"), F.btrim(text, F.lit(SPACE)).alias("_trimmed"))
    df = df.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", "[ \\t\\n\\x0B\\f\\r]+")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    df = repeated_words(df)
    n = F.size("_words").cast("long")
    per_word = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    per_line = lambda x: F.coalesce(F.try_divide(x, F.size("_lines")), F.lit(0.0))
    without = lambda chars: F.length(F.translate("_text", chars, ""))
    dup_lines = F.size("_lines") - F.size(F.array_distinct("_lines"))
    measures = {
        "n_words": n,
        "word_chars": without(SPACE).cast("long"),
        "n_symbols": (F.length("_text") - without(SYMBOLS)).cast("long"),
        "n_dup_lines": dup_lines.cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
        "mean_word_chars": per_word(without(SPACE)),
        "symbols_per_word": per_word(F.length("_text") - without(SYMBOLS)),
        "exclamations_per_word": per_word(F.length("_text") - without("!")),
        "stop_word_ratio": per_word(F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))),
        "dup_line_ratio": per_line(dup_lines),
        "distinct_word_ratio": per_word(F.size(F.array_distinct("_words"))),
        "bullet_line_ratio": per_line(F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]")))),
        "ellipsis_line_ratio": per_line(F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$")))),
    }
    return df.select(F.col("_row").alias("row"), F.struct(*(v.alias(k) for k, v in measures.items())).alias("quality"))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def verdict(q: Column, rules: list[tuple[str, float, float]] = RULES) -> Column:
    return reduce(lambda a, b: a & b, (q[m].between(lo, hi) for m, lo, hi in rules), F.lit(True))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[tuple[str, float, float]] = RULES) -> DataFrame:
    q = F.col("quality")
    return measured(docs, text_col).where(~base_failed(q) & verdict(q, rules)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    return measured(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id",
        *(q[m].alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(q).alias("base_failed"),
        (~base_failed(q) & verdict(q)).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, s, array_to_string(w[s:s + 7], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS s FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(s, s + 7)) AS p FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_excl, len(list_distinct(w)) AS n_distinct, len(l) AS n_lines,
    len(list_filter(w, lambda x: list_contains(['STOPS'], lower(x)))) AS n_stop,
    len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullet,
    len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS n_ellipsis
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= CAST(0.1 AS DOUBLE) AND n_excl / n_words <= 0.5
  AND n_stop / n_words >= CAST(0.05 AS DOUBLE) AND n_dup_lines / n_lines <= CAST(0.3 AS DOUBLE) AND n_distinct / n_words >= CAST(0.15 AS DOUBLE)
  AND n_bullet / n_lines <= CAST(0.9 AS DOUBLE) AND n_ellipsis / n_lines <= CAST(0.3 AS DOUBLE) AS kept
FROM b
""".replace("STOPS", "', '".join(STOP_WORDS))
