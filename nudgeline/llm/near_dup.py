"""Near-duplicate documents by HyperMinHash sketches, banding and verification.

A document is the set of its word 5-shingles (A-Z in lower case). Its sketch has 256 buckets; each
holds the smallest hash that falls into it, compressed to a leading-zero count and ten mantissa bits
(16 bits). A bucket that stays empty is hashed anew, at last with all shingles, so short texts have
full sketches too, and two documents agree in a bucket with a probability that is their similarity.

Documents with equal sets are one class from the start. Classes whose compressed registers agree in
one of 64 bands of 4 meet in that band's group; at a similarity of 0.75 a pair misses all bands with
a probability below 1e-10. A pair that meets is first judged by the share of equal registers, less
the collisions to be expected by chance; what is clearly too far apart (five standard deviations
below the threshold) goes, and the rest is verified on the full shingle sets.

Not all pairs of a group are looked at: first only each member against the group's centre, the one
that meets most others in all its groups (in a family, the text that the others are made from).
Verified links are merged into components, and groups whose members are all connected are done. What
is still apart is gathered under its most popular centre, in blocks of a few hundred sets: a task
compares two blocks on the full sets and gives only links that join something. Pairs that meet in a
band but under different centres are compared in the join itself, by size and one bit of every
register; the few that may be near (again five standard deviations) are judged and verified like the
others. So large families of near copies, and passages that stand in many documents, cost
comparisons but no rows, and no link between different texts is lost to a cap.

Everything between the steps is a table in the shared folder. Links, components and sketches never
reach the driver; it sees counts.

Defined cases: a text with fewer than five words has its whole sequence as its one shingle; without
words it has none and is linked with nothing; rows that share an id are judged each by its own text; rows without an id are
linked with nothing, with a null component, and kept; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches_by_bytes, free_prefix, landed, task, workspace
from .hashing import mixed, window_hashes, word_hashes

WIDTH = 5
PERCENT = 75
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND = 4
ROUNDS = 4
DEVIATIONS = 5.0
# Share of registers of unrelated sets of equal size that agree by chance (a fixed value of the
# sketch: 0.169919487 for registers without a mantissa).
CHANCE = 0.169919487 / (1 << MANTISSA_BITS)
SHIP_IDS = 1 << 20

_VALUE_BITS = 64 - BUCKET_BITS
_EMPTY = np.uint64((1 << 64) - 1)
_SKETCHED = (
    "doc_id BIGINT, n_shingles BIGINT, high BIGINT, low BIGINT, registers BINARY, "
    "bits ARRAY<BIGINT>"
)
# Longs that hold one bit of every register.
BIT_WORDS = BUCKETS // 64
# Sets and shingles that a block of a canopy holds at most on average; two blocks meet in a task.
BLOCK = 400
BLOCK_SHINGLES = 1 << 20


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(WIDTH, len(words))))


# --- sketches --------------------------------------------------------------------------------------


def _seeded(values: np.ndarray, seed: int) -> np.ndarray:
    return mixed(values + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def sketch(values: np.ndarray) -> np.ndarray:
    """The compressed registers of a set."""
    kept = np.full(BUCKETS, _EMPTY)
    shift = np.uint64(_VALUE_BITS)
    for seed in range(ROUNDS):
        x = _seeded(values, seed)
        found = np.full(BUCKETS, _EMPTY)
        np.minimum.at(found, (x >> shift).astype(np.intp), x << np.uint64(BUCKET_BITS))
        empty = kept == _EMPTY
        kept[empty] = found[empty]
        if not (kept == _EMPTY).any():
            break
    empty = np.flatnonzero(kept == _EMPTY)
    step = max(1, (1 << 18) // len(values))
    for start in range(0, len(empty), step):
        some = empty[start : start + step]
        seeds = (some + (ROUNDS + 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashed = mixed(values[None, :] + seeds[:, None])
        kept[some] = hashed.min(axis=1) << np.uint64(BUCKET_BITS)
    # The bits above the bucket's are left-aligned: zeros in front, then a one, then the mantissa.
    kept >>= np.uint64(BUCKET_BITS)
    length = np.frexp(kept.astype(np.float64))[1].astype(np.int64)
    zeros = np.maximum(_VALUE_BITS - length, 0)
    tail = kept << (64 - length).clip(0, 63).astype(np.uint64) << np.uint64(1)
    mantissa = tail >> np.uint64(64 - MANTISSA_BITS)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype("<u2")


def register_bits(registers: np.ndarray) -> np.ndarray:
    """The last bit of every register, 64 to a long."""
    return np.packbits((registers & 1).astype(np.uint8)).view("<i8")


def _sketch_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_by_bytes(batches, "body"):
        sizes, digests, registers, bits = [], [], [], []
        for text in batch.column("body").to_pylist():
            values = shingles(text)
            sizes.append(len(values))
            digests.append(xxhash.xxh3_128_digest(values.tobytes()))
            own = sketch(values) if len(values) else None
            registers.append(None if own is None else own.tobytes())
            bits.append(None if own is None else register_bits(own).tolist())
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(np.ascontiguousarray(halves[:, 0])),
                pa.array(np.ascontiguousarray(halves[:, 1])),
                pa.array(registers, pa.binary()),
                pa.array(bits, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "high", "low", "registers", "bits"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node and band; the band's hash stands for its registers and number."""
    n = BUCKETS // BAND
    number = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            data = b"".join(r.as_py() for r in part.column("registers"))
            keys = mixed(mixed(np.frombuffer(data, "<u8").reshape(-1, n) + number) ^ number)
            nodes = np.repeat(part.column("node").to_numpy(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], names=["band", "node"]
            )


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers and the sizes of both sets, less chance agreement."""
    ratio = n / m
    chance = CHANCE * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _plausible(percent: int):
    share = percent / 100
    limit = share - DEVIATIONS * (share * (1 - share) / BUCKETS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                a, b = (
                    np.frombuffer(b"".join(r.as_py() for r in part.column(c)), "<u2").reshape(-1, BUCKETS)
                    for c in ("a_registers", "b_registers")
                )
                n, m = (part.column(c).to_numpy() for c in ("a_size", "b_size"))
                passed = pa.array(estimate(a, b, n, m) >= limit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b")], names=["a", "b"]
                ).filter(passed)

    return run


# --- links -----------------------------------------------------------------------------------------


def _plausible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity."""
    for side in ("a", "b"):
        own = nodes.select(
            F.col("node").alias(side),
            F.col("n_shingles").alias(f"{side}_size"),
            F.col("registers").alias(f"{side}_registers"),
        )
        pairs = pairs.join(own, side)
    # Sizes alone rule out many.
    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    near = pairs.where(small * 100 >= large * percent)
    return near.mapInArrow(task(__name__, _plausible(percent)), "a BIGINT, b BIGINT")


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full shingle sets of the given nodes, from their leaders' texts."""
    wanted = nodes.select("node", F.col("doc_id").alias("leader"), "high", "low")
    if wanted.limit(SHIP_IDS + 1).count() <= SHIP_IDS:
        wanted = F.broadcast(wanted)  # 32 MB at most
    found = rows.join(wanted, F.col("doc_id") == F.col("leader")).drop("doc_id", "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "body"):
            nodes, values = [], []
            texts, high, low = (batch.column(c).to_pylist() for c in ("body", "high", "low"))
            for node, text, *digest in zip(batch.column("node").to_pylist(), texts, high, low):
                found = shingles(text)
                # Another row of the same id may hold another text.
                if np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist() == digest:
                    nodes.append(node)
                    values.append(found.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = np.concatenate([*values, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["node", "shingles"],
            )

    # Rows with equal id and text yield the same set.
    return found.mapInArrow(task(__name__, run), "node BIGINT, shingles ARRAY<BIGINT>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough; arrays are intersected in the engine."""
    for side in ("b", "a"):
        own = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
        pairs = pairs.join(own, side)
    both = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    sized = pairs.select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("total"))
    return sized.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")


class _Verifier:
    """Turns candidate pairs into links, each pair once."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, percent: int, folder: str):
        self.rows, self.nodes, self.percent, self.folder = rows, nodes, percent, folder
        self.tested: DataFrame | None = None
        self.step = 0

    def links(self, pairs: DataFrame) -> DataFrame:
        at, self.step = f"{self.folder}/step-{self.step}", self.step + 1
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = landed(pairs, f"{at}/pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if not pairs.limit(1).count():
            return pairs
        plausible = landed(_plausible_pairs(pairs, self.nodes, self.percent), f"{at}/plausible")
        met = plausible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.nodes.drop("registers", "bits").join(met, "node", "left_semi")
        sets = landed(_sets(self.rows, wanted), f"{at}/sets")
        return landed(_verified(plausible, sets, self.percent), f"{at}/links")


def _canopies(apart: DataFrame) -> DataFrame:
    """The most popular centre that each member of a group meets."""
    centres = apart.where(F.col("turn") == 1).select("band", F.struct("rank", "node").alias("centre"))
    top = apart.select("band", "node").join(centres, "band").groupBy("node")
    return top.agg(F.max("centre")["node"].alias("canopy"))


def _canopy_links(members: DataFrame, percent: int) -> DataFrame:
    """Links inside canopies. ``members`` have canopy, node, component and shingles.

    A canopy is dealt into blocks, and every two blocks (or one with itself) make a group of at most
    about ``2 * BLOCK`` sets and ``2 * BLOCK_SHINGLES`` shingles (or two sets), however large the canopy
    is. The groups are dealt out by canopy and both blocks, so those of one canopy are many tasks' work.
    """
    sizes = members.groupBy("canopy").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum(F.size("shingles").cast("bigint")).alias("shingles"),
        F.min("component").alias("x"),
        F.max("component").alias("y"),
    )
    sizes = sizes.where(F.col("x") != F.col("y"))
    blocks = F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)
    n = F.least(F.ceil(blocks), F.col("m")).cast("int")
    dealt = members.join(sizes.select("canopy", n.alias("n")), "canopy")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keys = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    dealt = dealt.select("canopy", *keys, "block", "node", "component", "shingles")
    # The join left the rows dealt by canopy alone, which grouping would be content with.
    dealt = dealt.repartition("canopy", "i", "j")

    def compare(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        block = rows.column("block").to_numpy()
        found = _near_pairs(
            [x.values.to_numpy().view(np.uint64) for x in rows.column("shingles")],
            rows.column("component").to_numpy(),
            block == i,
            block == j,
            percent,
        )
        node = rows.column("node").to_numpy()
        a, b = node[found[:, 0]], node[found[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("canopy", "i", "j").applyInArrow(compare, "a BIGINT, b BIGINT")


def _near_pairs(
    sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> np.ndarray:
    """Places (x, y) of near pairs between two parts of some sets, as many as join components."""
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in one set only
    number = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = number[column[use]], owner[use]
    xs, ys = np.flatnonzero(left), np.flatnonzero(right)
    both = np.zeros((len(xs), len(ys)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        both += table[xs] @ table[ys].T
    common = both.astype(np.int64)
    union = size[xs][:, None] + size[ys][None, :] - common
    near = (common * 100 >= union * percent) & (component[xs][:, None] != component[ys][None, :])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for x, y in np.argwhere(near):
        p, q = find(int(component[xs[x]])), find(int(component[ys[y]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((xs[x], ys[y]))
    return np.array(out, np.int64).reshape(-1, 2)


def _near_across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a band's members from different components and canopies that may be near, by size
    and register bits.

    Registers that differ agree in their last bit half the time, so a pair at the threshold has
    half as many different bits as different registers.
    """
    share = (1 - percent / 100) / 2
    limit = BUCKETS * share + DEVIATIONS * (BUCKETS * share * (1 - share)) ** 0.5
    x, y = members.alias("x"), members.alias("y")
    small = F.least("x.n_shingles", "y.n_shingles")
    large = F.greatest("x.n_shingles", "y.n_shingles")
    apart = sum(
        F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BIT_WORDS)
    )
    near = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.turn") < F.col("y.turn"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.canopy") != F.col("y.canopy"))
        & (small * 100 >= large * percent)
        & (apart <= limit)
    )
    a, b = F.col("x.node"), F.col("y.node")
    return x.join(y, near).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


# --- components ------------------------------------------------------------------------------------


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every linked node.

    Every node takes its smallest smaller neighbour as parent, and its other smaller neighbours are
    linked to that one instead; links move to ever smaller nodes until parents are all that is left.
    Then parents are replaced by their parents until all are roots.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    step = 0
    while True:
        edges = landed(edges.distinct(), f"{folder}/edges-{step}")
        # Combined before the shuffle, so a node with very many neighbours is no one task's work; the
        # join may split it.
        least = edges.groupBy("u").agg(F.min("v").alias("p"))
        moved = landed(edges.join(least, "u").select("u", "v", "p"), f"{folder}/parents-{step}")
        rest = moved.where(F.col("v") != F.col("p"))
        if not rest.limit(1).count():
            break
        kept = moved.where(F.col("v") == F.col("p")).select("u", "v")
        edges = kept.unionByName(rest.select(F.col("v").alias("u"), F.col("p").alias("v")))
        step += 1
    tree, step = moved.select("u", "p"), 0
    while True:
        up = tree.select(F.col("u").alias("p"), F.col("p").alias("q"))
        risen = tree.join(up, "p", "left").select(
            "u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("rose")
        )
        risen = landed(risen, f"{folder}/tree-{step}")
        tree = risen.select("u", "p")
        if not risen.where("rose").limit(1).count():
            break
        step += 1
    roots = tree.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("p").alias("component")).unionByName(roots)


# --- all together ----------------------------------------------------------------------------------


def _placed(docs: DataFrame, text: str, percent: int, folder: str) -> DataFrame:
    """Id, size and digest of every row's set, and its component: the number of one (unlike its
    smallest id, no other has it) and that id. Both are null without an id or a set."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    sketched = landed(rows.mapInArrow(task(__name__, _sketch_all), _SKETCHED), f"{folder}/sketched")
    usable = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # A node is a class of equal sets, led by its smallest document.
    classes = usable.groupBy("high", "low").agg(F.min("doc_id").alias("leader"))
    classes = landed(
        classes.withColumn("node", F.monotonically_increasing_id()), f"{folder}/classes"
    )
    leaders = usable.join(
        classes.select("high", "low", F.col("leader").alias("doc_id"), "node"), ["high", "low", "doc_id"]
    )
    nodes = landed(
        leaders.dropDuplicates(["node"]).select(
            "node", "doc_id", "high", "low", "n_shingles", "registers", "bits"
        ),
        f"{folder}/nodes",
    )
    bands = nodes.select("node", "registers").mapInArrow(task(__name__, _bands), "band BIGINT, node BIGINT")
    size = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = landed(bands.join(size, "band").select("band", "node", "n"), f"{folder}/met")
    # In a family the text that the others are made from meets most of them, so the member with the
    # most company is the centre. The smaller node wins ties.
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    rank = F.struct("company", (-F.col("node")).alias("back")).alias("rank")
    groups = landed(met.join(company, "node").select("band", "node", "n", rank), f"{folder}/groups")
    centres = groups.groupBy("band").agg((-F.max("rank")["back"]).alias("a"))
    pairs = groups.join(centres, "band").where(F.col("node") != F.col("a"))
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    check = _Verifier(rows, nodes, percent, folder)
    links = check.links(pairs)
    # Groups of three and more that still hold different components.
    known = nodes.select("node", "n_shingles", "bits")
    known = known.join(components(links, f"{folder}/first"), "node", "left")
    known = landed(
        known.withColumn("component", F.coalesce("component", "node")), f"{folder}/known"
    )
    members = groups.where(F.col("n") > 2).join(known, "node")
    apart = members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    apart = apart.where(F.col("x") != F.col("y")).select("band")
    by_rank = Window.partitionBy("band").orderBy(F.col("rank").desc())
    turn = F.row_number().over(by_rank).alias("turn")
    apart = members.join(apart, "band", "left_semi").withColumn("turn", turn)
    apart = landed(apart, f"{folder}/apart")
    canopies = landed(_canopies(apart), f"{folder}/canopies")
    wanted = nodes.drop("registers", "bits").join(canopies, "node", "left_semi")
    sets = landed(_sets(rows, wanted), f"{folder}/canopy-sets")
    inside = canopies.join(known.select("node", "component"), "node").join(sets, "node")
    inside = landed(_canopy_links(inside, percent), f"{folder}/canopy-links")
    links = links.unionByName(inside)
    apart = apart.drop("rank").join(canopies, "node")
    links = links.unionByName(check.links(_near_across(apart, percent)))
    found = components(links, f"{folder}/all")
    known = nodes.select("node").join(found, "node", "left")
    known = known.select("node", F.coalesce("component", "node").alias("component"))
    ids = known.join(classes.select("node", "leader"), "node")
    names = ids.groupBy("component").agg(F.min("leader").alias("component_id"))
    ids = ids.join(names, "component").select("node", "component", "component_id")
    ids = classes.join(ids, "node").select("high", "low", "component", "component_id")
    placed = sketched.join(ids, ["high", "low"], "left")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = [F.when(has_set, F.col(c)).alias(c) for c in ("component", "component_id")]
    return placed.select("doc_id", "n_shingles", "high", "low", *own)


def find(
    docs: DataFrame, text: str = "text", percent: int = PERCENT, folder: str | None = None
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    placed = _placed(docs, text, percent, workspace(docs.sparkSession, "near-dup", folder))
    component = F.coalesce("component_id", "doc_id")
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _digested(text: str, names: list[str]):
    """Adds size and digest of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, text):
            sets = (shingles(t) for t in batch.column(text).to_pylist())
            found = [(len(x), xxhash.xxh3_128_digest(x.tobytes())) for x in sets]
            halves = np.frombuffer(b"".join(d for _, d in found), "<i8").reshape(-1, 2)
            made = [
                pa.array([n for n, _ in found], pa.int64()),
                pa.array(np.ascontiguousarray(halves[:, 0])),
                pa.array(np.ascontiguousarray(halves[:, 1])),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return run


def _left_of_repeated(
    docs: DataFrame, several: DataFrame, placed: DataFrame, text: str, folder: str
) -> DataFrame:
    """What stays of the rows whose id other rows have too. They are known by id and digest."""
    own = free_prefix(docs)
    size, high, low, row = (f"{own}{c}" for c in ("size", "high", "low", "row"))
    many = several.select(F.col("doc_id").alias(f"{own}id")).hint("shuffle_hash")
    rows = docs.join(many, docs["doc_id"] == F.col(f"{own}id"), "left_semi")
    made = [StructField(c, LongType()) for c in (size, high, low)]
    schema = StructType([*docs.schema.fields, *made])
    rows = rows.mapInArrow(task(__name__, _digested(text, schema.names)), schema)
    rows = landed(
        rows.withColumn(row, F.monotonically_increasing_id()), f"{folder}/repeated-ids"
    )
    # The sets that their components keep: texts of one id may be near each other as well.
    first = placed.where(F.col("component_id") == F.col("doc_id")).groupBy("component")
    first = first.agg(F.min(F.struct("high", "low", "doc_id")).alias("s")).select("s.*")
    keys = rows.where(F.col(size) > 0).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col(high).alias("high"),
        F.col(low).alias("low"),
        F.struct(F.xxhash64(text).alias("hash"), F.col(row).alias("row")).alias("order"),
    )
    stays = keys.join(first, ["doc_id", "high", "low"]).groupBy("doc_id", "high", "low")
    stays = stays.agg(F.min("order")["row"].alias(row)).select(row)
    without = rows.where(F.col(size) == 0)
    left = rows.join(stays, row, "left_semi").select(rows.columns).unionByName(without)
    return left.drop(size, high, low, row)


def deduplicate(
    docs: DataFrame, text: str = "text", percent: int = PERCENT, folder: str | None = None
) -> DataFrame:
    """The documents with one row of each component left, one with the smallest id.

    Rows that share an id go or stay each by its own set, and of rows with equal id and set one
    stays. Rows without a set are linked with nothing and stay. What goes is the small side, so it
    is hashed and the texts are not sorted; only texts of ids that several rows share are read for
    their sets again.
    """
    folder = workspace(docs.sparkSession, "near-dup", folder)
    placed = _placed(docs, text, percent, folder).where(F.col("doc_id").isNotNull())
    placed = landed(placed, f"{folder}/placed")
    gone = placed.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    times = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    several = landed(times.select("doc_id"), f"{folder}/several")
    shared = several.limit(1).count() > 0
    if shared:
        gone = gone.unionByName(several)
    name = f"{free_prefix(docs)}gone"
    gone = gone.select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == F.col(name), "left_anti")
    if not shared:
        return left
    return left.unionByName(_left_of_repeated(docs, several, placed, text, folder))
