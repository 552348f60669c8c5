import zlib

import fixtures

from nudgeline.llm import sharding


def placed(frame):
    return {r["doc_id"]: (r["shard"], r["slot"]) for r in frame.collect()}


def test_shards_are_level_and_gapless(spark):
    rows = [(i, f"text {i % 50}" * (i % 9)) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(7)
    found = sharding.shuffle(docs, 16, bucket_bytes=2000)
    shards = {}
    for r in found.collect():
        text = dict(rows)[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(16))
    assert {len(s) for s in shards.values()} == {62, 63}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_same_seed_same_order(spark):
    docs = fixtures.documents(spark)
    one = placed(sharding.shuffle(docs, 4))
    assert one == placed(sharding.shuffle(docs.repartition(5), 4))
    assert one != placed(sharding.shuffle(docs, 4, seed=2))


def test_order_is_shuffled(spark):
    rows = [(i, "same text") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = placed(sharding.shuffle(docs, 4, bucket_bytes=4000))
    order = sorted(found, key=found.get)
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 900 < rising < 1100
    for s in range(4):
        mean = sum(i for i, (shard, _) in found.items() if shard == s) / 500
        assert 850 < mean < 1150
