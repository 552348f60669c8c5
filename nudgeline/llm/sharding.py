"""A seeded global shuffle into shards, as an external shuffle in two passes.

First pass: every record goes to one of many buckets by a seeded hash of its id, its text and its number
among the rows that have both alike, so buckets
are near equal and small enough for memory whatever the input. Second pass: each bucket is put into
a fixed order, shuffled by Fisher-Yates with a generator seeded by the bucket's number, and written.
Buckets in their order make up one random order of all records; it is cut into shards whose row
counts differ by one at most (law ``rows``), and a record's slot is its place in its shard.

The same seed gives the same shards, however the input was split into tasks and whichever task had
to run again. How many records each bucket holds is counted first, so that the second pass knows
where each bucket starts; that table has one number per bucket.

Defined cases: a null text counts as empty; rows without an id are scattered by their text; copies of a
text under different ids are scattered by their ids, and repeats of a row (equal id and text) by
their number among them; an empty table gives no rows; other columns are carried along, except that
columns called like a result column are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, landed, set_columns, task, workspace

N_SHARDS = 16
BUCKET_BYTES = 64 << 20
LAW = "rows"
# Most bucket starts, or repeated rows' hashes, that are shipped (16 bytes each), and most partitions of
# the second pass; beyond that a partition has several buckets.
SHIP_ROWS = 200_000
MOST_PARTS = 20_000


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text and one for its end."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint")


def _identity(seed: int, text: str) -> Column:
    """The same number for rows that have id and text alike."""
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return F.xxhash64(F.col("doc_id"), body, F.lit(seed))


def _bucket(identity: Column, number: Column, n_buckets: int) -> Column:
    """Rows with one identity are dealt to the buckets in turn, from the one of its hash on."""
    first = F.pmod(identity, F.lit(n_buckets))
    return ((first + number) % n_buckets).cast("int")


def _starts(identities: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket`` and how many rows lie before it. One row per bucket, so one task may order them."""
    whole, rest = F.call_function("div", F.col("n"), F.lit(n_buckets)), F.col("n") % n_buckets
    turns = F.least(F.col("n"), F.lit(n_buckets)).cast("int") - 1
    dealt = identities.select(
        "identity", whole.alias("whole"), rest.alias("rest"), F.explode(F.sequence(F.lit(0), turns)).alias("turn")
    )
    extra = F.when(F.col("turn") < F.col("rest"), 1).otherwise(0)
    sizes = dealt.groupBy(_bucket(F.col("identity"), F.col("turn"), n_buckets).alias("bucket")).agg(
        F.sum(F.col("whole") + extra).alias("n")
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _shuffled(n_rows: int, n_shards: int, seed: int, names: list[str], own: str):
    """Second pass over one task's buckets, which arrive sorted, each row with its bucket's start."""

    def place(bucket: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        order = list(range(table.num_rows))
        draw = random.Random(f"{seed}:{bucket}").random
        for i in range(len(order) - 1, 0, -1):  # Fisher-Yates
            j = int(draw() * (i + 1))
            order[i], order[j] = order[j], order[i]
        table = table.take(pa.array(order))
        first = table.column(f"{own}start")[0].as_py()
        shard, slot = [], []
        for place in range(first, first + len(order)):
            s = place * n_shards // n_rows
            shard.append(s)
            slot.append(place - -(-s * n_rows // n_shards))
        columns = {"shard": pa.array(shard, pa.int32()), "slot": pa.array(slot, pa.int64())}
        arrays = [columns[n] if n in columns else table.column(n).combine_chunks() for n in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            numbers = batch.column(f"{own}bucket").to_pylist()
            start = 0
            while start < len(numbers):
                stop = start
                while stop < len(numbers) and numbers[stop] == numbers[start]:
                    stop += 1
                if numbers[start] != current:
                    if held:
                        yield place(current, held)
                    current, held = numbers[start], []
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield place(current, held)

    return run


def shuffle(
    docs: DataFrame,
    n_shards: int = N_SHARDS,
    seed: int = 1,
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Writes all records into shards in random order; gives them as read back, with ``size``,
    ``text_crc32``, ``shard`` and ``slot``."""
    spark = docs.sparkSession
    folder = workspace(spark, "shards", folder)
    body = F.coalesce(F.col(text), F.lit(""))
    own = free_prefix(docs)
    same, at, number = f"{own}identity", f"{own}bucket", f"{own}number"
    rows = set_columns(
        docs,
        {
            "size": record_size(text),
            "text_crc32": F.crc32(body.cast("binary")),
            "shard": F.lit(0),
            "slot": F.lit(0).cast("bigint"),
        },
    )
    names = rows.columns
    known = docs.select(_identity(seed, text).alias("identity"), record_size(text).alias("bytes"))
    known = known.groupBy("identity").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    known = landed(known, f"{folder}/identities")
    extent = known.agg(F.sum("n").alias("n"), F.sum("bytes").alias("b"), F.max("n").alias("most")).first()
    n_rows = extent["n"] or 0
    n_buckets = max(n_shards, -(-(extent["b"] or 0) // bucket_bytes))
    starts = landed(_starts(known, n_buckets), f"{folder}/starts")
    numbered = rows.withColumns({same: _identity(seed, text), number: F.lit(0).cast("bigint")})
    if (extent["most"] or 0) > 1:
        many = landed(known.where(F.col("n") > 1).select(F.col("identity").alias(same)), f"{folder}/repeats")
        if many.count() <= SHIP_ROWS:
            many = F.broadcast(many)
        # Rows that are alike are counted off in one task, a row at a time.
        along = Window.partitionBy(same).orderBy("text_crc32")
        counted = numbered.join(many, same, "left_semi")
        counted = counted.withColumn(number, (F.row_number().over(along) - 1).cast("bigint"))
        numbered = numbered.join(many, same, "left_anti").unionByName(counted)
    bucketed = numbered.withColumn(at, _bucket(F.col(same), F.col(number), n_buckets)).drop(same, number)
    begins = starts.select(F.col("bucket").alias(at), F.col("start").alias(f"{own}start"))
    if n_buckets <= SHIP_ROWS:
        begins = F.broadcast(begins)
    # A task holds one bucket at a time; sorted, so that the order it starts from does not depend on
    # which task wrote first.
    n_parts = min(n_buckets, MOST_PARTS)
    scattered = bucketed.join(begins, at).repartitionById(n_parts, F.col(at) % n_parts)
    ordered = scattered.sortWithinPartitions(at, "doc_id", "text_crc32", text)
    shuffled = task(__name__, _shuffled(max(n_rows, 1), n_shards, seed, names, own))
    placed = ordered.mapInArrow(shuffled, rows.schema)
    path = f"{folder}/by-shard"
    placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*names)
