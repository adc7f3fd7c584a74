"""Licence scan with a positional index of rare template words.

A document looks up, of every mandatory phrase, its words of the highest
inverse document frequency in an index of the templates' words and positions.
Places that all of a template's rare words agree on, as far apart in the
document as in the template, are where it would start; only there are the
mandatory phrases verified and the other words counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.llm.common import ascii_lower, cut, table

#: label, words of the notice, mandatory phrases in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: phrase, label: found wherever the words stand in this order.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Template words too common to look up; they count in phrases only.
COMMON = frozenset("a and any are by for in into is of or that the this to with".split())
#: How many of the rarest words of each mandatory phrase are looked up; a phrase that is there has them, so that none is lost.
RAREST = 2
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = sorted({p for _, _, ps in TEMPLATES for p in ps} | {p for p, _ in BASE})


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NO_WORD), lambda w: w != "")


def _places(phrase: str, label: str) -> Column:
    """i, label of every place in hits where the phrase starts: its words are hits that follow each other, in the document too."""
    p, hits = phrase.split(), F.col("hits")

    def at(h: Column, j: Column) -> Column:
        cond = h["w"] == p[0]
        for m in range(1, len(p)):
            nxt = F.get(hits, j + m)
            cond = cond & F.coalesce((nxt["w"] == p[m]) & (nxt["i"] == h["i"] + m), F.lit(False))
        return F.when(cond, F.struct(h["i"].alias("i"), F.lit(label).alias("label")))

    return F.array_compact(F.transform(hits, at))


def _rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({names})")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places has the templates found: label, start (words, from 0) and score, the
    share of the template's inverse document frequency that was found there;
    score is the largest of them, else 0. labels adds the templates' labels to
    the base phrases'. Of words equally rare the first by name is looked up. A
    null text counts as empty and has no words. Repeated rows each count, ids
    may be null, other columns aren't looked at, and an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split() if w not in COMMON} | {w for p in _PHRASES for w in p.split()})
    d = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("words"))
    hit = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w")))))
    rows = cut(d.select("row_no", "doc_id", F.size("words").cast("long").alias("n_words"), hit.alias("hits")))

    rows = rows.withColumn("base", F.flatten(F.array(*[_places(p, label) for p, label in BASE])))

    # tables of the templates, whose sizes are fixed by the constants above
    each = [(n, w, i, t, ps) for n, (_, t, ps) in enumerate(TEMPLATES) for i, w in enumerate(t.split())]
    index = _rows(spark, "t, w, at, counts, must", [(n, w, i, w not in COMMON, any(_offset(t, p) <= i < _offset(t, p) + len(p.split()) for p in ps)) for n, w, i, t, ps in each])
    phrases = _rows(spark, "t, phrase, w, at", [(n, p, w, _offset(t, p) + i) for n, (_, t, ps) in enumerate(TEMPLATES) for p in ps for i, w in enumerate(p.split()) if w not in COMMON])
    names = _rows(spark, "t, label, n_must", [(n, label, len({_offset(t, p) + i for p in ps for i in range(len(p.split()))})) for n, (label, t, ps) in enumerate(TEMPLATES)])

    found = rows.filter(F.size("hits") > 0).select("row_no", F.explode("hits").alias("h")).select("row_no", "h.i", "h.w")
    df = found.filter(~F.col("w").isin(sorted(COMMON))).groupBy("w").agg(F.count_distinct("row_no").alias("df"))
    # a row per licence word; a word that no document has is rarer than any
    idf = cut(df.select("w", F.log1p(F.lit(rows.count()) / F.col("df")).alias("idf")))
    weighed = index.join(idf, "w", "left").withColumn("idf", F.when(F.col("counts"), F.coalesce("idf", F.lit(0.0))).otherwise(0.0))
    total = weighed.groupBy("t").agg(F.sum("idf").alias("total"))
    by_idf = Window.partitionBy("t", "phrase").orderBy(F.coalesce("idf", F.lit(float("inf"))).desc(), "w", "at")
    rare = cut(phrases.join(idf, "w", "left").withColumn("r", F.row_number().over(by_idf)).filter(F.col("r") <= RAREST).select("t", "w", "at").distinct())
    agree = rare.groupBy("t").agg(F.count("*").alias("n_rare"))

    # where all rare words of a template agree on its start
    votes = found.join(F.broadcast(rare), "w").groupBy("row_no", "t", (F.col("i") - F.col("at")).alias("start")).agg(F.count("*").alias("n"))
    starts = cut(votes.join(F.broadcast(agree), "t").filter("n = n_rare").select("row_no", "t", "start"))
    # the words that should stand around each start, held against those that do
    due = starts.join(F.broadcast(weighed), "t").select("row_no", "t", "start", (F.col("start") + F.col("at")).alias("i"), "w", "must", "idf")
    there = found.join(starts.select("row_no").distinct(), "row_no", "left_semi")
    seen = due.join(there, ["row_no", "i", "w"]).groupBy("row_no", "t", "start").agg(F.count_if("must").alias("n_seen"), F.sum("idf").alias("got"))
    places = (
        seen.join(F.broadcast(names), "t")
        .join(F.broadcast(total), "t")
        .filter("n_seen = n_must")
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct("label", F.col("start").cast("long").alias("start"), F.coalesce(F.least(F.try_divide("got", "total"), F.lit(1.0)), F.lit(1.0)).alias("score")))).alias("places"))
    )
    at = F.transform("base", lambda b: b["i"].cast("long"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = rows.select("row_no", "doc_id", "n_words", "base").join(places, "row_no", "left")
    out = out.withColumn("places", F.coalesce("places", F.expr("cast(array() as array<struct<label:string,start:bigint,score:double>>)")))
    own = F.transform("base", lambda b: b["label"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.transform("places", lambda p: p["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
        "places",
    )


def _offset(template: str, phrase: str) -> int:
    t, p = template.split(), phrase.split()
    return next(i for i in range(len(t)) if t[i : i + len(p)] == p)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("places")
