"""License scans by diagonal voting, in DataFrame operations only.

Every text is cut into words, and every pair of neighbouring words (a rolling 2-gram) is hashed and
joined with the positions of the same pair in the templates. A pair at word ``p`` of the text and
word ``t`` of a template votes for the diagonal ``p - t``; a whole template in a row puts all its
votes on one diagonal. Words left out or put in move the rest of a passage to a diagonal nearby, so
votes on neighbouring diagonals are merged. A span stands if the words behind the hashes are equal
and it covers enough of its template's pairs; a base phrase needs all of them on one diagonal.
Covered pairs are bits, in blocks of 62, so a template may have any length.

The templates are a fixed list, so their side of the join is shipped; votes are summed up before
the shuffle, by row, template and diagonal, so neither a hot source nor a phrase that stands in
every text gathers anywhere. Texts are read once: each keeps one row of its own through the join.

Defined cases: a null or empty text has no words, no places and score 0; the words of a one-word
text make no pair; repeated rows and rows without an id are rows of their own; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The phrases that decide the base labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Openings of well-known notices, as words.
NOTICES = (
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at",
        "apache",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        "gpl",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "bsd",
    ),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEIGHBOURS = 2
MIN_COVER = 0.7
BLOCK_PAIRS = 62  # covered pairs are the bits of a long, one per block


def words(text: Column) -> Column:
    """Words of a text in lower case. A letter outside ASCII stays part of its word either way."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def templates(
    spark: SparkSession,
    base: Sequence[tuple[str, str]] = BASE_PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """One row per template and pair in it."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *notices]):
        parts = phrase.split()
        n = len(parts) - 1
        if n < 1:
            raise ValueError(f"a template needs 2 words: {phrase}")
        for at, (a, b) in enumerate(zip(parts, parts[1:])):
            fields = {"template": number, "label": label, "is_base": number < len(base)}
            fields |= {"n_pairs": n, "at": at, "a": a, "b": b, "block": at // BLOCK_PAIRS}
            bit = F.lit(1 << at % BLOCK_PAIRS).cast("bigint").alias("bit")
            rows.append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], bit))
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return table.withColumn("pair", _pair_hash(F.col("a"), F.col("b")))


def _pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def votes(docs: DataFrame, text: str = "text", table: DataFrame | None = None) -> DataFrame:
    """Per row, template, diagonal and block the covered pairs, as bits, and where they stand. A row with
    ``template`` null stands for each text itself."""
    table = templates(docs.sparkSession) if table is None else table
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col(text)).alias("w")
    )
    following = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = rows.select(
        "row",
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("x"), following.alias("y"))).alias("p", "pair"),
    )
    pairs = pairs.select(
        "row", "doc_id", "n_words", "p", F.col("pair.x").alias("x"), F.col("pair.y").alias("y")
    )
    met = pairs.join(
        F.broadcast(table),  # a fixed list of some hundred rows
        (_pair_hash(F.col("x"), F.col("y")) == F.col("pair"))
        & (F.col("x") == F.col("a"))
        & (F.col("y") == F.col("b")),
        "left",
    )
    itself = F.coalesce(F.col("p"), F.lit(0)) == 0
    # The first pair may vote as well, then it counts for both.
    kinds = F.when(itself & F.col("template").isNotNull(), F.array(F.lit(True), F.lit(False)))
    kinds = kinds.when(itself, F.array(F.lit(False))).when(F.col("template").isNotNull(), F.array(F.lit(True)))
    met = met.where(itself | F.col("template").isNotNull()).withColumn("vote", F.explode(kinds))
    voted = F.col("vote")
    met = met.select(
        "row",
        "doc_id",
        "n_words",
        *[F.when(voted, F.col(c)).alias(c) for c in ("template", "label", "is_base", "n_pairs", "at", "block", "bit", "p")],
    )
    return met.groupBy(
        "row",
        "doc_id",
        "n_words",
        "template",
        "label",
        "is_base",
        "n_pairs",
        "block",
        (F.col("p") - F.col("at")).alias("diagonal"),
    ).agg(
        F.bit_or("bit").alias("covered"),
        F.min("p").alias("first"),
        F.max("p").alias("last"),
    )


def spans(voted: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """Merges neighbouring diagonals and keeps the spans that cover enough of their template.

    A text without any keeps one row, with ``template`` null. Base phrases are not merged.
    """
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(line)
    # Blocks of one diagonal stay together.
    reach = F.when(F.col("is_base"), 0).otherwise(NEIGHBOURS)
    starts = F.coalesce(gap > reach, F.lit(True)).cast("int")
    keys = ["row", "doc_id", "n_words", "template", "label", "is_base", "n_pairs", "group"]
    merged = (
        voted.withColumn("starts", starts)
        .withColumn("group", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "block")
        .agg(
            F.bit_or("covered").alias("covered"),
            F.min("diagonal").alias("start"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .groupBy(*keys)
        .agg(
            F.sum(F.bit_count("covered")).alias("covered"),
            F.min("start").alias("start"),
            F.min("first").alias("first"),
            (F.max("last") + 1).alias("last"),
        )
    )
    cover = F.col("covered") / F.col("n_pairs")
    needed = F.when(F.col("is_base"), 1.0).otherwise(min_cover)
    return merged.withColumn("cover", cover).withColumn("found", F.col("cover") >= needed).drop("covered", "group")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Places of the base phrases, labels and score of every row."""
    found = spans(votes(docs, text))
    base = F.col("found") & F.col("is_base")

    def names(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    start = F.when(base, F.col("start").cast("bigint"))
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.max("cover"), F.lit(0.0)), 6).alias("score"),
    ).drop("row")
