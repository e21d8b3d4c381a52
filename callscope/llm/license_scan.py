"""License scans by a positional rare-token index, in DataFrame functions only.

TEMPLATES are short licence notices. The index holds every template word but the commonest, with its
positions; idf weights of these words are counted over all documents. In a text, all index words are
looked up, each occurrence votes for (template, relative position), and a template whose best relative position gathers enough of its weight, and whose mandatory key
phrase stands in the text, gives its label. Base phrases give their labels wherever they stand.

Defined results: null and wordless texts have no labels and score 0; first_word and last_word are null
where no base phrase stands; very long texts are scanned whole; of relative positions with equal votes
either gives the same share; repeated rows are each scanned; other columns, whatever their names, stay
in `row`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import common

#: Phrase and label.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: (label, notice, mandatory key phrases, of which one must stand in the text).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", [f"creative commons attribution {x}" for x in ("4 0", "3 0", "2 0", "international", "license")]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", ["attribution noncommercial", "attribution non commercial"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Words too frequent in any text to be looked up.
COMMON = set("a all and any are for in is may not of or the this to use with without you 0 2 3 4 work".split())
#: Share of the weight of a template's index words that its best relative position must gather.
SHARE = 0.6
WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

POSTINGS = [(w, k, i) for k, (_, notice, _) in enumerate(TEMPLATES) for i, w in enumerate(notice.split()) if w not in COMMON]
INDEXED = sorted({w for w, _, _ in POSTINGS})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(common.lower_az(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def may_match(text: Column) -> Column:
    """False where no phrase and no index word can stand: spares splitting most texts into words."""
    rare = sorted({w for w in INDEXED} | {max(p.split(), key=len) for p, _ in BASE})
    return common.lower_az(text).rlike("(?<![0-9a-z\\x80-\\x{10FFFF}])(" + "|".join(rare) + ")(?![0-9a-z\\x80-\\x{10FFFF}])")


def weights(docs: DataFrame, text_col: str) -> dict[str, float]:
    """idf of each index word over all documents, which are counted in the same pass, as if each held an empty word."""
    mine = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, INDEXED)))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.when(may_match(F.coalesce(F.col(text_col), F.lit(""))), mine).otherwise(F.array().cast("array<string>")))).alias("w"))
    df = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in INDEXED}


def phrase_at(words: str, phrase: str) -> Column:
    """Word places where the phrase starts."""
    parts = phrase.split()
    hit = lambda w, i: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)), F.lit(True))
    return F.filter(F.transform(words, lambda w, i: F.when((w == parts[0]) & hit(w, i), i)), lambda i: i.isNotNull())


def of_template(k: int) -> Callable[[Column], Column]:
    return lambda v: v["k"] == k


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns `row`, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score."""
    idf = weights(docs, text_col)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    none = F.array().cast("array<string>")
    df = row.select("row", F.regexp_count(common.lower_az(text), F.lit(WORDS)).cast("long").alias("n_words"), F.when(may_match(text), words_of(text)).otherwise(none).alias("words"))
    df = df.withColumns({f"at{k}": phrase_at("words", phrase) for k, (phrase, _) in enumerate(BASE)})
    weight = F.create_map(*(F.lit(x) for w in INDEXED for x in (w, idf[w])))
    hits = F.transform("words", lambda w, i: F.struct(F.try_element_at(weight, w).alias("weight"), i.alias("at"), w.alias("word")))
    df = df.withColumn("hits", F.filter(hits, lambda h: h["weight"].isNotNull()))
    posting = F.create_map(*(x for w in INDEXED for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for v, k, i in POSTINGS if v == w)))))
    vote = lambda h: F.transform(posting[h["word"]], lambda p: F.struct(p["k"].alias("k"), (h["at"] - p["i"]).alias("offset"), h["weight"].alias("weight")))
    df = df.withColumn("votes", F.flatten(F.transform("hits", vote)))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    df = df.withColumn("joined", F.when(F.size("votes") > 0, joined).otherwise(F.lit("")))
    shares = {}
    for k, (_, notice, phrases) in enumerate(TEMPLATES):
        full = sum(idf[w] for w, j, _ in POSTINGS if j == k)
        mine = F.filter("votes", of_template(k))
        totals = F.aggregate(
            F.sort_array(F.transform(mine, lambda v: F.struct(v["offset"].alias("offset"), v["weight"].alias("weight")))),
            F.struct(F.lit(None).cast("int").alias("offset"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")),
            lambda s, v: F.struct(
                v["offset"].alias("offset"),
                F.when(s["offset"] == v["offset"], s["sum"] + v["weight"]).otherwise(v["weight"]).alias("sum"),
                F.greatest(s["best"], F.when(s["offset"] == v["offset"], s["sum"] + v["weight"]).otherwise(v["weight"])).alias("best"),
            ),
            lambda s: s["best"],
        )
        verified = reduce(lambda a, b: a | b, (F.contains("joined", F.lit(f" {p} ")) for p in phrases))
        shares[f"share{k}"] = F.when(verified, F.least(totals / full, F.lit(1.0))).otherwise(F.lit(0.0))
    df = df.withColumns(shares)
    places = F.array_sort(F.concat(*(F.col(f"at{k}") for k in range(len(BASE)))))
    given = lambda pairs: F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in pairs)))))
    base = [(F.size(f"at{k}") > 0, label) for k, (_, label) in enumerate(BASE)]
    own = [(F.col(f"share{k}") >= SHARE, label) for k, (label, _, _) in enumerate(TEMPLATES)]
    return df.withColumn("places", places).select(
        "row",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.try_element_at("places", F.lit(-1)).cast("long").alias("last_word"),
        given(base).alias("base_labels"),
        given(base + own).alias("labels"),
        F.greatest(*(F.when(c, 1.0).otherwise(0.0) for c, _ in base), *(F.col(f"share{k}") for k in range(len(TEMPLATES)))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    comma = lambda c: F.array_join(c, ",").alias(c)
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", comma("base_labels"), comma("labels"), "score")
