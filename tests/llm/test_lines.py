import hashlib
import os

import duckdb
import fixtures
import numpy as np
import pytest

from nudgeline.llm import cuckoo, line_dedup, queries, sql


def plain_dedup(rows):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(fixtures.LOWER)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(fixtures.LOWER) for x in lines]
        kept = [
            line
            for line, key in zip(lines, keys)
            if len(holders.get(key, ())) < 3 or max(holders[key]) == doc_id
        ]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def result(frame):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in frame.collect()}


def test_against_plain_version(spark):
    docs = fixtures.documents(spark)
    want = plain_dedup([(r[0], r[1]) for r in fixtures.texts()])
    assert result(line_dedup.dedup_lines(docs)) == want
    # Without shipped filters the exact join decides alone.
    assert result(line_dedup.dedup_lines(docs, ship_limit=-1)) == want
    assert any(n for _, n, _ in want.values())


def test_insertions_can_be_taken_back(spark, tmp_path):
    docs = fixtures.documents(spark)
    first = docs.where("doc_id % 2 = 1")
    second = docs.where("doc_id % 2 = 0")

    def tables(index):
        known = sorted(map(tuple, index.repeated().collect()))
        return known, {r["shard"]: bytes(r["cells"]) for r in index.filters().collect()}

    index = line_dedup.LineIndex(spark, str(tmp_path / "a"), min_docs=2)
    index.insert(first)
    before = tables(index)
    index.insert(second)
    both = tables(index)
    assert both[0] != before[0]
    index.delete(second)
    assert tables(index)[0] == before[0]
    # The filters know exactly the repeated keys.
    for shard, cells in tables(index)[1].items():
        own = [k for k in before[0] if k[0] == shard]
        assert (np.frombuffer(cells, np.uint16) > 0).sum() == len(own)
    whole = line_dedup.LineIndex(spark, str(tmp_path / "b"), min_docs=2)
    whole.insert(docs)
    assert tables(whole)[0] == both[0]
    rows = whole.insert(docs.limit(0))
    assert rows.count() == 0 and tables(whole)[0] == both[0]


def test_the_last_holder_moves_when_it_is_deleted(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path / "c"))
    docs = spark.createDataFrame([(i, fixtures.SHARED) for i in range(5)], "doc_id BIGINT, text STRING")
    index.insert(docs)
    assert [(r["n_docs"], r["last_doc"]) for r in index.repeated().collect()] == [(5, 4)]
    index.delete(docs.where("doc_id >= 3"))
    assert [(r["n_docs"], r["last_doc"]) for r in index.repeated().collect()] == [(3, 2)]
    index.delete(docs.where("doc_id = 0"))
    assert index.repeated().collect() == []


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    high, low = rng.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    cells = cuckoo.built(high, low)
    assert cells.contains(high, low).all()
    again = cuckoo.CuckooFilter.from_bytes(cells.to_bytes())
    again.delete(high[:2500], low[:2500])
    assert again.contains(high[2500:], low[2500:]).all()
    assert again.contains(high[:2500], low[:2500]).mean() < 0.01
    again.delete(high[2500:], low[2500:])
    assert not again.table.any()
    with pytest.raises(KeyError):
        again.delete(high[:1], low[:1])
    with pytest.raises(cuckoo.FilterFull):
        cuckoo.CuckooFilter.sized(1).insert(high, low)


@pytest.fixture(scope="module")
def connection(small):
    made = duckdb.connect()
    for table in ("documents", "embeddings"):
        path = os.path.join(small, f"{table}.parquet")
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return made


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql_on_the_small_tables(spark, small, connection, name):
    wanted = connection.execute(sql.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    found = queries.queries()[name](spark, small)
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(wanted.fetchall(), key=repr)


def test_digests(connection):
    want = connection.execute(sql.oracle_sql()["op1_line_dedup"]).fetchall()
    plain = plain_dedup(connection.execute("SELECT doc_id, text FROM documents").fetchall())
    digests = {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, _, t) in plain.items()}
    assert {r[0]: r[3] for r in want} == digests
