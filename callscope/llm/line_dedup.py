"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A text is cut into lines: at line breaks and after sentence ends. A run of lines repeats if its lines,
trimmed, follow one another elsewhere, earlier in the order (doc_id, text hash,
place). Repeated runs of MIN_WORDS words or more are deleted where they come later; the first
occurrence stays, and so does everything else, byte for byte.

Grams are the lines that start within GRAM words of a line's start; windows are the grams that start
within the next MIN_WORDS - GRAM words, so that a window lies within MIN_WORDS words of its start.
The smallest gram hash of each window is its fingerprint (the later place on ties), so any common
run of MIN_WORDS words shares a fingerprint. Each fingerprint is joined with its first occurrence
only, never with all: matches along one diagonal (same two texts, same distance) are extended both
ways over the two texts' line hashes to the longest runs. Where that first occurrence turns out to
be a shorter match, the windows that chose the fingerprint are joined by all their lines instead, so
that a run whose gram also stands alone in an earlier text is still found.

Defined results: null and empty texts stay as they are; rows that repeat a doc_id and a text count as
one document and all keep what it keeps; a null doc_id comes last in the order; a run within one text
is deleted where it recurs there; very long texts are taken whole; other columns, whatever their names,
stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm import common

MIN_WORDS, GRAM = 50, 25
CUT = r"(?<=[.!?] |\n)"
#: What ends a line, and a mark set behind it to cut at.
ENDS, MARK = (". ", "! ", "? ", "\n"), "\x00"
LAST = 2**63 - 1
#: Most fingerprints (of 8 bytes) sent to every task; beyond it they are shuffled.
BROADCAST_ROWS = 20_000


def lines_of(text: Column) -> Column:
    """Lines that concatenate to the text: cut at marks set by plain replacement, or by the pattern where a text holds the mark itself."""
    marked = reduce(lambda x, end: F.replace(x, F.lit(end), F.lit(end + MARK)), ENDS, text)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, CUT)).otherwise(F.split(marked, MARK))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def words_in(line: Column) -> Column:
    """Words of a trimmed line: its spaces and one, none in an empty line."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, a, aw): each document's key, line hashes and line word counts; a repeated document once."""
    d, t = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(text_col)
    df = docs.where(F.length(text_col) > 0).select(d.alias("d"), t.alias("t"), F.transform(lines_of(F.col(text_col)), trimmed).alias("lines"))
    df = common.materialize(df.select("d", "t", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", words_in).alias("aw")))
    repeated = df.groupBy("d", "t").count().where("count > 1")
    return df if repeated.isEmpty() else df.dropDuplicates(["d", "t"])


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(g, all, d, t, p, fresh): each window's fingerprint, its place, the hash of the whole window, and whether the place is new. lines: d, t, p (place), h (hash), w (words)."""
    text = Window.partitionBy("d", "t")
    by_place = text.orderBy("p")
    c = F.sum("w").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    df = lines.where("w > 0").withColumn("c", c)
    by_word = text.orderBy("c")
    # Sums of 44-bit hashes don't overflow; they ignore order, which the extension checks.
    low = F.shiftrightunsigned("h", 20)
    df = df.withColumn("g", F.sum(low).over(by_word.rangeBetween(0, gram - 1)))
    span = by_word.rangeBetween(0, min_words - 1)
    df = df.withColumn("whole", F.max(F.col("c") + F.col("w")).over(span) - F.col("c") >= min_words).withColumn("all", F.sum(low).over(span))
    pick = F.min(F.struct(F.col("g"), (-F.col("c")).alias("c"), F.col("p"))).over(by_word.rangeBetween(0, min_words - gram))
    df = df.select("d", "t", "c", "whole", "all", pick.alias("pick")).where("whole")
    df = df.withColumn("before", F.lag("pick.p").over(by_word))
    fresh = F.coalesce(F.col("before") != F.col("pick.p"), F.lit(True))
    return df.select(F.col("pick.g").alias("g"), "all", "d", "t", F.col("pick.p").alias("p"), fresh.alias("fresh"))


def runs_on(a: Column, b: Column, aw: Column, shift: Column, min_words: int) -> Column:
    """Runs (start, end) of `a` of min_words words or more that equal `b` shifted: b[i - shift] = a[i]. All arguments are columns of the row."""
    low, high = F.greatest(shift, F.lit(0)), F.least(F.size(a), F.size(b) + shift)
    # Places that differ, and the end: runs lie between them.
    ends = F.filter(F.sequence(low, high), lambda i: (i == high) | (F.get(a, i) != F.get(b, i - shift)))
    between = lambda e: F.transform(e, lambda x, k: F.struct(F.coalesce(F.get(e, k - 1) + 1, low).cast("int").alias("start"), x.cast("int").alias("end")))
    runs = F.get(F.transform(F.array(ends), between), F.lit(0))
    words = lambda r: F.aggregate(F.slice(aw, r["start"] + 1, r["end"] - r["start"]), F.lit(0), lambda s, x: s + x)
    long = F.filter(runs, lambda r: (r["end"] > r["start"]) & (words(r) >= min_words))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(a).alias("end")))
    copy = (shift == 0) & (F.col("d") != F.col("fd")) & (a == b)
    return F.when(low >= high, F.slice(whole, 1, 0)).when(copy, whole).otherwise(long)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(d, t, runs): line places to delete from each text that has any."""
    texts = hashed_lines(docs, id_col, text_col)
    lines = texts.select("d", "t", F.posexplode(F.arrays_zip("a", "aw")).alias("p", "x")).select("d", "t", "p", F.col("x.a").alias("h"), F.col("x.aw").alias("w"))
    marks = common.materialize(fingerprints(lines, min_words, gram))
    met = common.materialize(meetings(marks.where("fresh").select(F.col("g").alias("k"), "d", "t", "p")))
    diagonals = common.materialize(met.select("d", "t", "fd", "ft", "shift").distinct())
    found = common.materialize(extended(diagonals, texts, min_words))
    runs = found.groupBy("d", "t").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    inside = F.exists("runs", lambda r: (F.col("p") >= r["start"]) & (F.col("p") < r["end"]))
    short = met.join(runs, ["d", "t"], "left").where(F.coalesce(~inside, F.lit(True))).select(F.col("k").alias("g")).distinct()
    short = common.materialize(short)
    n = short.count()
    if n:
        some = F.broadcast(short) if n <= BROADCAST_ROWS else short
        again = meetings(marks.join(some, "g", "left_semi").select(F.col("all").alias("k"), "d", "t", "p").distinct())
        fresh = again.select("d", "t", "fd", "ft", "shift").distinct().join(diagonals, ["d", "t", "fd", "ft", "shift"], "left_anti")
        fresh = common.materialize(fresh)
        if not fresh.isEmpty():
            found = found.union(extended(fresh, texts, min_words))
    return found.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))


def meetings(marks: DataFrame) -> DataFrame:
    """(k, d, t, p, fd, ft, shift): each later place of a key with an earlier one. marks: k, d, t, p.

    A text's first place of a key meets the key's first place of all; a further one meets the one before it
    in the same text, so that a periodic text makes one diagonal.
    """
    place = F.struct("d", "t", "p")
    first = marks.groupBy("k").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("k", "first")
    # A key's places may be any number: written, the sums don't share a stage with the join, so that Spark can split a large key there,
    # and what has met is dealt anew by key and text, as a text's places are few.
    first = common.materialize(first)
    met = marks.join(first, "k").repartition("k", "d", "t").withColumn("before", F.lag("p").over(Window.partitionBy("k", "d", "t").orderBy("p")))
    met = met.where(F.col("before").isNotNull() | (F.struct("d", "t") != F.struct("first.d", "first.t")))
    own = F.col("before").isNotNull()
    fd, ft = F.when(own, F.col("d")).otherwise(F.col("first.d")), F.when(own, F.col("t")).otherwise(F.col("first.t"))
    return met.select("k", "d", "t", "p", fd.alias("fd"), ft.alias("ft"), (F.col("p") - F.coalesce("before", "first.p")).alias("shift"))


def extended(diagonals: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(d, t, runs) of each diagonal that has runs, over the line hashes of its two texts."""
    both = diagonals.join(texts, ["d", "t"]).join(texts.select(F.col("d").alias("fd"), F.col("t").alias("ft"), F.col("a").alias("b")), ["fd", "ft"])
    runs = runs_on(F.col("a"), F.col("b"), F.col("aw"), F.col("shift"), min_words)
    return both.select("d", "t", runs.alias("runs")).where(F.size("runs") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """The documents without later repeated runs: text_col changed, all other columns and rows as they were, and n_lines_deleted."""
    runs = repeated_runs(docs, id_col, text_col, min_words, gram)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col("row")[text_col]).alias("t"))
    row = row.join(runs, ["d", "t"], "left").withColumn("lines", F.when(F.col("runs").isNotNull(), lines_of(F.col("row")[text_col])))
    gone = lambda i: F.exists("runs", lambda r: (i >= r["start"]) & (i < r["end"]))
    row = row.withColumn("kept", F.filter("lines", lambda x, i: ~gone(i)))
    text = F.when(F.col("runs").isNull(), F.col("row")[text_col]).otherwise(F.array_join("kept", ""))
    deleted = F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long")
    return row.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), deleted.alias("n_lines_deleted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), "n_lines_deleted")
