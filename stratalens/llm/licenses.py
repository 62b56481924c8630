"""License scans by diagonal voting, in DataFrame operations only.

Every word pair of every text is joined to the pairs of the templates. A match
votes for its diagonal (text position less template position); all votes of an
exact phrase fall on one diagonal, and a passage with words put in or left out
spreads over neighbouring ones, which are merged. A span counts once its
votes cover enough of the template and it isn't stretched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that must stand word for word, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Openings of notices, matched with gaps; at most 64 words each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
}
#: Share of a notice's word pairs that must have votes, diagonals merged, words a span may be longer.
COVER, APART, STRETCH = 0.7, 2, 4
_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: digits, ASCII letters and everything beyond ASCII.

    Phrases are plain ASCII, and the Kelvin sign is the one character beyond
    A-Z that would become an ASCII letter: it is kept from that.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138"))), _BREAKS), "")


def templates(spark: SparkSession) -> DataFrame:
    """One row per word pair of each template; a fixed, small table."""
    rows = []
    for t, (phrase, label, exact) in enumerate([*((p, x, True) for p, x in BASE.items()), *((p, x, False) for p, x in NOTICES.items())]):
        own = phrase.split()
        rows += [(t, label, exact, len(own) - 1, i, f"{a} {b}") for i, (a, b) in enumerate(zip(own, own[1:], strict=False))]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, pairs int, at int, pair string").withColumn("hash", F.xxhash64("pair"))


def votes(docs: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, template, label, exact, pairs, diagonal, mask): the template positions that voted, as bits."""
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    rolled = F.transform(F.array(words(F.col(text_col))), lambda w: F.when(F.size(w) > 1, pairs(w)))[0]
    grams = docs.select(*key, F.posexplode(rolled).alias("pos", "pair")).withColumn("hash", F.xxhash64("pair"))
    found = grams.join(F.broadcast(templates(docs.sparkSession)), ["hash", "pair"])
    return found.groupBy(*key, "template", "label", "exact", "pairs", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))


def spans(voted: DataFrame, key: list[str]) -> DataFrame:
    """Verified spans: (key, label, exact, start, score)."""
    exact = voted.where("exact and bit_count(mask) = pairs").select(*key, "label", "exact", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    w = Window.partitionBy(*key, "template").orderBy("diagonal")
    loose = voted.where("not exact").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > APART).cast("int"), F.lit(1)))
    loose = loose.withColumn("island", F.sum("new").over(w)).groupBy(*key, "template", "label", "exact", "pairs", "island").agg(
        F.bit_or("mask").alias("mask"), F.min("diagonal").alias("start"), F.max("diagonal").alias("stop")
    )
    loose = loose.withColumn("score", F.bit_count("mask") / F.col("pairs")).where((F.col("score") >= COVER) & (F.col("stop") - F.col("start") <= STRETCH))
    return exact.unionByName(loose.select(*key, "label", "exact", "start", "score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its license evidence.

    n_base counts the places of the exact phrases, first_word and last_word are
    the smallest and largest of their starts (null without any), base_labels and
    labels are distinct, sorted and comma-joined (empty without any), score is
    the best span's cover of its template (0 without any). A null text is empty.
    Rows are told apart by id and text, so repeated rows get the same answer.
    Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    key = ["id", "digest"]
    found = spans(votes(base, key, "text"), key)
    labels = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    found = found.groupBy(*key).agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("score").alias("score"),
    ).withColumnsRenamed({"id": "__id", "digest": "__digest"})
    sized = base.select("id", "digest", F.size(words(F.col("text"))).alias("n_words"))
    joined = sized.join(found, (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
