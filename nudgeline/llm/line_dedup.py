"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

A line's key is the line with ASCII white space stripped at both ends and A-Z in lower case. Keys
that are long enough and stand in at least ``min_docs`` documents are repeated: all their lines go,
except in the document with the largest id that holds them.

``LineIndex`` keeps three tables in the shared folder:

* ``references``: one row per (key, document), in segments of +1 (inserted) and -1 (deleted);
* ``repeated``: the exact count and last holder of every key with at least ``min_docs`` holders;
* ``filters``: per shard of the key space a cuckoo filter of its repeated keys.

Inserting or deleting documents appends a segment, counts the touched keys again and adds or removes
exactly the keys that became or ceased to be repeated, so insertions can be taken back. Lines are
first tested against the filters (a filter never misses a key), and what passes meets the exact
table. Filters are shipped to the tasks while they are small in sum (``ship_limit`` bytes, checked);
beyond that the exact join alone decides, with the same result.

A key in a third of all documents is summed up before the shuffle, and joined against one row.

Defined cases: a null text is one empty line; empty and short lines are always kept; rows without
doc_id count as no document and keep all their lines; rows that share a doc_id are one document;
an empty table gives an empty result; other columns pass through, except that columns called like
a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import cuckoo
from .common import batches_by_bytes, free_prefix, landed, set_columns, task, workspace

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 1 << 18
SHIP_LIMIT = 64 << 20

_POSTINGS = "high BIGINT, low BIGINT, doc_id BIGINT"
_REFERENCES = f"{_POSTINGS}, sign INT"
_REPEATED = "shard INT, high BIGINT, low BIGINT, n_docs BIGINT, last_doc BIGINT"
_FILTERS = "shard INT, cells BINARY"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line's key; None for a line that is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _postings(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "body"):
            keys, ids, counts = [], [], []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body")):
                lines = body.as_py().encode().split(b"\n")
                own = {line_key(line, min_chars) for line in lines} - {None}
                keys.extend(own)
                ids.append(doc_id)
                counts.append(len(own))
            if not keys:
                continue
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(pairs[:, 0])),
                    pa.array(np.ascontiguousarray(pairs[:, 1])),
                    pa.array(np.repeat(np.array(ids, np.int64), counts)),
                ],
                names=["high", "low", "doc_id"],
            )

    return run


def postings(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document row and distinct long line in it."""
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    known = docs.where(F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("bigint").alias("doc_id"), body).mapInArrow(
        task(__name__, _postings(min_chars)), _POSTINGS
    )


def _refilter(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """One shard: takes out and puts in what changed; rebuilt when that does not fit.

    ``keys`` are all repeated keys of the shard and those that have just left it.
    """
    shard = int((keys if len(keys) else old)["shard"].iloc[0])
    state = keys["change"].to_numpy()
    high, low = keys["high"].to_numpy(np.int64), keys["low"].to_numpy(np.int64)
    try:
        if not len(old):
            raise cuckoo.FilterFull
        cells = cuckoo.CuckooFilter.from_bytes(old["cells"].iloc[0])
        cells.delete(high[state < 0], low[state < 0])
        cells.insert(high[state > 0], low[state > 0])
    except cuckoo.FilterFull:
        cells = cuckoo.built(high[state >= 0], low[state >= 0])
    return pd.DataFrame({"shard": [shard], "cells": [cells.to_bytes()]})


class LineIndex:
    """The incremental state of line dedup in one folder; versions are written anew, so a task or
    job that is run again never meets half a change. Old versions are kept until the folder goes."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        min_docs: int = MIN_DOCS,
        min_chars: int = MIN_CHARS,
        n_shards: int | None = None,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.min_docs, self.min_chars, self.n_shards = min_docs, min_chars, n_shards
        self.version = 0

    # --- tables ---

    def _read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        v = self.version if version is None else version
        if not v:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/version={v}")

    def repeated(self) -> DataFrame:
        """Repeated keys with their exact number of documents and the last of them."""
        return self._read("repeated", _REPEATED)

    def filters(self) -> DataFrame:
        return self._read("filters", _FILTERS)

    def references(self) -> DataFrame:
        """All segments so far."""
        paths = [f"{self.folder}/references/version={v}" for v in range(1, self.version + 1)]
        if not paths:
            return self.spark.createDataFrame([], _REFERENCES)
        return self.spark.read.schema(_REFERENCES).parquet(*paths)

    # --- changes ---

    def insert(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Counts documents in; gives back their references."""
        return self._change(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Takes inserted documents (same ids and texts) out again."""
        return self._change(docs, text, -1)

    def _shard(self):
        return F.pmod(F.shiftright("high", 32), F.lit(self.n_shards)).cast("int").alias("shard")

    def _change(self, docs: DataFrame, text: str, sign: int) -> DataFrame:
        found = postings(docs, text, self.min_chars)
        ids = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("m")).first()
        if ids["n"] != ids["m"]:
            found = found.distinct()  # several rows of one document
        version = self.version + 1
        segment = landed(
            found.withColumn("sign", F.lit(sign)), f"{self.folder}/references/version={version}"
        )
        before = self.repeated()
        if self.version:
            touched = segment.select("high", "low").distinct()
            rows = self.references().unionByName(segment).join(touched, ["high", "low"], "left_semi")
            rows = rows.groupBy("high", "low", "doc_id").agg(F.sum("sign").alias("sign"))
            rows = rows.where(F.col("sign") > 0)
        else:
            rows = segment
        counted = rows.groupBy("high", "low").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")
        )
        counted = counted.where(F.col("n_docs") >= self.min_docs)
        if self.n_shards is None:
            # Fixed for the life of the index; a shard's filter grows by itself.
            self.n_shards = max(16, segment.count() // KEYS_PER_SHARD)
        counted = counted.select(self._shard(), "high", "low", "n_docs", "last_doc")
        if self.version:
            untouched = before.join(touched, ["high", "low"], "left_anti").select(*before.columns)
            counted = untouched.unionByName(counted)
        path = f"{self.folder}/repeated/version={version}"
        now = landed(counted, path)
        old = before.select("shard", "high", "low", F.lit(True).alias("was"))
        new = now.select("shard", "high", "low", F.lit(True).alias("is"))
        both = old.join(new, ["shard", "high", "low"], "full")
        change = F.when(F.col("was").isNull(), 1).when(F.col("is").isNull(), -1).otherwise(0)
        keys = both.select("shard", "high", "low", change.alias("change"))
        filters = keys.groupBy("shard").cogroup(self.filters().groupBy("shard"))
        landed(
            filters.applyInPandas(_refilter, _FILTERS), f"{self.folder}/filters/version={version}"
        )
        self.version = version
        return segment.drop("sign")

    # --- use ---

    def candidates(self, rows: DataFrame, ship_limit: int = SHIP_LIMIT) -> DataFrame:
        """References whose key may be repeated, by the filters alone."""
        filters = self.filters()
        size = filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0)).alias("b")).first()["b"]
        if size > ship_limit:
            return rows
        shipped = self.spark.sparkContext.broadcast(
            {r["shard"]: bytes(r["cells"]) for r in filters.collect()}
        )
        n_shards = self.n_shards

        def probe(batches):
            known = {s: cuckoo.CuckooFilter.from_bytes(b) for s, b in shipped.value.items()}
            for batch in batches:
                high = batch.column("high").to_numpy()
                low = batch.column("low").to_numpy()
                shard = (high >> 32) % n_shards
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(n_shards + 1))
                passed = np.zeros(len(high), bool)
                for s, cells in known.items():
                    rows_of = order[edges[s] : edges[s + 1]]
                    if len(rows_of):
                        passed[rows_of] = cells.contains(high[rows_of], low[rows_of])
                yield batch.filter(pa.array(passed))

        return rows.mapInArrow(task(__name__, probe), rows.schema)

    def drops(self, rows: DataFrame, ship_limit: int = SHIP_LIMIT) -> DataFrame:
        """Per document the keys of the lines it loses, as 16 bytes each."""
        known = self.repeated().select("high", "low", "last_doc")
        hits = self.candidates(rows, ship_limit).join(known, ["high", "low"])
        hits = hits.where(F.col("doc_id") < F.col("last_doc"))
        key = F.struct("high", "low")
        return hits.groupBy("doc_id").agg(F.collect_list(key).alias("keys"))


def _strip(text: str, min_chars: int, columns: list[str], keys: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, text):
            kept, n_lines, n_dropped = [], [], []
            lost = batch.column(keys)
            for i, body in enumerate(batch.column(text)):
                lines = (body.as_py() or "").encode().split(b"\n")
                n_lines.append(len(lines))
                if lost[i].is_valid:
                    part = lost[i].values
                    pairs = np.stack(
                        [part.field(0).to_numpy(), part.field(1).to_numpy()], axis=1
                    ).astype("<i8")
                    gone = {p.tobytes() for p in pairs}
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                else:
                    stay = lines
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            made = {"text": kept, "n_lines": n_lines, "n_dropped": n_dropped}
            arrays = [
                pa.array(kept, pa.string()) if c == text
                else pa.array(made[c], pa.int64()) if c in ("n_lines", "n_dropped")
                else batch.column(c)
                for c in columns
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def drop_lines(
    docs: DataFrame, drops: DataFrame, text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Documents without the lines they lose, with ``n_lines`` and ``n_dropped``.

    The lists of lost keys are the small side, so they are hashed and the texts are not sorted.
    """
    own = free_prefix(docs)
    doc, keys = f"{own}doc", f"{own}keys"
    lost = drops.select(F.col("doc_id").alias(doc), F.col("keys").alias(keys))
    zero = F.lit(0).cast("bigint")
    rows = set_columns(docs, {"n_lines": zero, "n_dropped": zero})
    joined = rows.join(lost.hint("shuffle_hash"), rows["doc_id"] == F.col(doc), "left").drop(doc)
    fields = [StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    return joined.mapInArrow(task(__name__, _strip(text, min_chars, rows.columns, keys)), StructType(fields))


def dedup_lines(
    docs: DataFrame,
    folder: str | None = None,
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    ship_limit: int = SHIP_LIMIT,
) -> DataFrame:
    """All documents with their repeated lines taken out; ``text`` holds what is left."""
    spark = docs.sparkSession
    index = LineIndex(spark, workspace(spark, "line-dedup", folder), min_docs, min_chars)
    rows = index.insert(docs, text)
    return drop_lines(docs, index.drops(rows, ship_limit), text, min_chars)
