"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source has a target number of words. Among all document rates that meet it, entropy balancing
takes the ones that stay closest to one copy each; these are exponentially tilted:
``rate = min(cap, exp(lambda * size / mean size))`` with one ``lambda`` per source. The dual problem
is convex with one unknown per source, and Newton steps solve it: each step is one aggregation of
rate, size and slope over the sources' size classes, held in a bracket that bisection would keep, so
it always converges. A source whose target is ``cap`` times its size takes every document that often.

Rates become whole copies by running sums: along the sizes of a source, a class of documents of one
size gets as many copies as whole numbers its rates pass, spread evenly over the class in the order
of a seeded hash. What then remains of the target, less than the largest document, is made up by a
few smaller documents.

Sources may be of any size: the classes (source, size, salt) are counted before they are ranked, a
class is salted so that no window holds more than some 200,000 rows on average, and the running sums
are taken over classes first. Sums that decide anything are decimal numbers, so reruns agree to the
last copy, whichever task is first. States of the iteration are tables in the shared folder.

Defined cases: a null text or one without words has size 0 and gets copies like the smallest ones,
which take no words; null is a source of its own, ordered last; ties are broken by hash and id;
repeated rows are rows of their own; an empty table gives no rows; other columns are carried along,
except that columns called like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, landed, set_columns, workspace

# In code-point order of the sources, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_SALT = 200_000
MAX_STEPS = 60
PASSES = 4
TOLERANCE = 1e-6
UNIT = 100_000_000  # rates are whole numbers of these parts
_BIG = "decimal(38,0)"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to a table of ``source`` and ``source_size``.

    Targets share the sum of all sizes by weight; none exceeds ``cap`` times its source's size, and
    what is over goes to the others by weight. That is a water level: sources in order of
    ``cap * size / weight`` are full as long as that lies below the level the rest would get.
    The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
    limit = F.lit(float(cap)) * F.col("source_size")
    rows = sources.withColumn("weight", weight).withColumn("limit", limit)
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(onward))
    full = F.col("limit") < F.col("weight") * F.col("level")
    rows = rows.withColumn("full", full)
    # The lowest source that is not full has the final level.
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("level"))))
    rows = rows.withColumn("final", first_open.over(everything)["level"])
    target = F.when(F.col("full"), F.col("limit")).otherwise(
        F.least("limit", F.col("weight") * F.col("final"))
    )
    return rows.withColumn("target", target).drop("weight", "limit", "level", "full", "final")


def _key(source: str = "source") -> Column:
    """The source as a join key; null is one as well."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _rate(tilt: Column, size: Column, mean: Column, cap: int) -> Column:
    """The document rate in parts; a whole number, so that sums do not depend on their order."""
    shape = F.when(mean > 0, size / mean).otherwise(F.lit(0.0))
    rate = F.least(F.lit(float(cap)), F.exp(tilt * shape))
    return F.round(F.when(F.isnan(rate), F.lit(float(cap))).otherwise(rate) * UNIT).cast("bigint")


def tilts(classes: DataFrame, sources: DataFrame, cap: int, folder: str) -> DataFrame:
    """``tilt`` per source key such that its rates times its sizes sum up to its target.

    ``classes`` have key, size and n; ``sources`` key, source_size, mean and target.
    """
    at_cap = F.col("target") >= F.lit(float(cap)) * F.col("source_size")
    ceiling = F.lit(1e7)  # enough for any document of a word in a source of long ones
    state = sources.select(
        "key",
        "mean",
        "target",
        "source_size",
        F.when(at_cap, ceiling).otherwise(F.lit(0.0)).alias("tilt"),
        (-ceiling).alias("low"),
        ceiling.alias("high"),
        (at_cap | (F.col("source_size") == 0)).alias("done"),
    )
    state = landed(state, f"{folder}/tilt-0")
    for step in range(1, MAX_STEPS + 1):
        if not state.where(~F.col("done")).limit(1).count():
            break
        size = F.col("size").cast("double")
        parts = _rate(F.col("tilt"), size, F.col("mean"), cap)
        words = (F.col("n") * F.col("size")).cast(_BIG)
        rising = F.when(parts < cap * UNIT, parts).otherwise(F.lit(0))
        sums = (
            classes.join(state.where(~F.col("done")).select("key", "tilt", "mean"), "key")
            .groupBy("key")
            .agg(
                F.sum(words * parts.cast(_BIG)).alias("sum"),
                F.sum(words * rising.cast(_BIG) * F.col("size").cast(_BIG)).alias("slope"),
            )
        )
        value = F.col("sum").cast("double") / UNIT
        slope = F.col("slope").cast("double") / UNIT / F.col("mean")
        error = value - F.col("target")
        low = F.when(error < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        moved = state.join(sums, "key", "left").select(
            *state.columns, error.alias("error"), slope.alias("slope"), low.alias("l"), high.alias("h")
        )
        newton = F.col("tilt") - F.col("error") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("l")) & (newton < F.col("h"))
        # Far out, halving the distance to 0 is faster than halving the bracket.
        halved = F.when(
            (F.col("l") > -ceiling) & (F.col("h") < ceiling), (F.col("l") + F.col("h")) / 2
        ).otherwise(F.when(F.col("error") > 0, F.col("tilt") * 2 - 1).otherwise(F.col("tilt") * 2 + 1))
        near = F.abs("error") <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        closed = F.col("h") - F.col("l") <= 1e-9 * F.greatest(F.abs("l"), F.abs("h"))
        done = F.col("done") | near | closed
        state = landed(
            moved.select(
                "key",
                "mean",
                "target",
                "source_size",
                F.when(done, F.col("tilt")).when(inside, newton).otherwise(halved).alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(F.col("l")).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(F.col("h")).alias("high"),
                done.alias("done"),
            ),
            f"{folder}/tilt-{step}",
        )
    return state


def _whole_copies(classes: DataFrame, cap: int) -> DataFrame:
    """``whole``: the copies of each class (key, size) together, from its rate and rows.

    First by running sums of the rates over the sizes of a source. That leaves less than the largest
    document of the target; each further pass makes up for what is left with a few documents of at
    most a third of it, larger ones first, one copy each, so every pass leaves a third at most.
    """
    along = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    n, size = F.col("n"), F.col("size")
    # A source may hold more rows than a long has parts for.
    parts = n.cast("decimal(20,0)") * F.col("rate").cast("decimal(18,0)")
    base = F.coalesce(F.sum(parts).over(along), F.lit(0).cast("decimal(38,0)"))
    rows = classes.withColumn("base", base)

    def passed(parts: Column) -> Column:
        return F.call_function("div", parts + F.lit(UNIT // 2), F.lit(UNIT))

    rows = rows.withColumn("whole", passed(F.col("base") + parts) - passed(F.col("base")))
    falling = Window.partitionBy("key").orderBy(F.col("size").desc())
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(PASSES):
        words = F.sum(F.col("whole") * size).over(Window.partitionBy("key"))
        rows = rows.withColumn("left", F.round(F.col("target") - words).cast("bigint"))
        missing = F.abs("left")
        free = F.when(F.col("left") > 0, n * cap - F.col("whole")).otherwise(F.col("whole"))
        free = F.when((size > 0) & (size * 3 <= missing), F.least(free, n)).otherwise(F.lit(0))
        rows = rows.withColumn("free", free)
        used = F.coalesce(F.sum(F.col("free") * size).over(before), F.lit(0))
        room = F.greatest(missing - used, F.lit(0))
        change = F.least("free", F.call_function("div", room, F.greatest(size, F.lit(1))))
        rows = rows.withColumn("change", change).withColumn(
            "whole", F.col("whole") + F.when(F.col("left") > 0, F.col("change")).otherwise(-F.col("change"))
        )
    return rows.select("key", "size", "n", "whole")


_CELL = ("passed", "whole", "n", "source_size", "target")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: tuple = WEIGHTS,
    cap: int = CAP,
    seed: int = 1,
    folder: str | None = None,
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    spark = docs.sparkSession
    folder = workspace(spark, "mixing", folder)
    sized = docs.select(
        F.col(source).alias("source"), F.col("doc_id"), n_words(text).alias("size")
    )
    sized = landed(sized, f"{folder}/sizes")
    n_salts = max(1, sized.count() // ROWS_PER_SALT)

    def salt() -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_salts)).cast("int")

    cells = landed(
        sized.groupBy("source", "size", salt().alias("salt"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("key", _key()),
        f"{folder}/cells",
    )
    classes = cells.groupBy("source", "key", "size").agg(F.sum("n").alias("n"))
    per_source = classes.groupBy("source", "key").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows")
    )
    mean = F.col("source_size") / F.col("rows")
    sources = landed(
        targets(per_source, weights, cap).withColumn("mean", mean), f"{folder}/sources"
    )
    solved = tilts(classes, sources, cap, folder)
    rate = _rate(F.col("tilt"), F.col("size").cast("double"), F.col("mean"), cap).alias("rate")
    rated = classes.join(solved.select("key", "tilt", "mean", "target"), "key")
    rated = _whole_copies(rated.withColumn("rate", rate), cap)
    earlier = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = cells.select("key", "size", "salt", passed.alias("passed")).join(rated, ["key", "size"])
    starts = starts.join(sources.select("key", "source_size", "target"), "key")
    # One shuffle of the rows: they are ranked within their cell and meet its one row there.
    own = free_prefix(docs)
    cell = [f"{own}{c}" for c in ("key", "size", "salt")]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        _key(source).alias(cell[0]),
        n_words(text).alias(cell[1]),
        salt().alias(cell[2]),
    )
    turn = Window.partitionBy(*cell).orderBy(F.xxhash64("doc_id", F.lit(-seed)), "doc_id")
    rows = rows.withColumn(f"{own}turn", F.row_number().over(turn))
    starts = starts.select(
        *[F.col(c).alias(f"{own}{c}") for c in ("key", "size", "salt", *_CELL)],
    )
    joined = rows.join(starts, cell)

    def given(turns: Column) -> Column:
        """Copies that the first rows of a class get together: spread evenly over its rows. The
        product takes more digits than a long has once a class holds some 10^9 rows."""
        passed = (F.col(f"{own}passed") + turns).cast("decimal(19,0)")
        return F.call_function("div", passed * F.col(f"{own}whole").cast("decimal(19,0)"), F.col(f"{own}n"))

    made = f"{own}copies"
    copies = (given(F.col(f"{own}turn")) - given(F.col(f"{own}turn") - 1)).cast("int")
    joined = joined.withColumn(made, copies)
    out = set_columns(
        joined,
        {
            "size": F.col(cell[1]),
            "source_size": F.col(f"{own}source_size"),
            "target": F.col(f"{own}target"),
            "copies": F.col(made),
            "taken": F.col(made) * F.col(cell[1]),
        },
    )
    return out.drop(*cell, f"{own}turn", made, *[f"{own}{c}" for c in _CELL])


def copied(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: every row as often as it has copies."""
    # The mix gives its own columns the places of those of the same name, so the rows travel as one.
    own = free_prefix(docs)
    read = {options.get("text", "text"), options.get("source", "source"), "doc_id"}
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{own}row")
    rows = docs.select(*[F.col(f"`{c}`") for c in sorted(read)], whole)
    mixed = mix(rows, **options).where(F.col("copies") > 0)
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias(f"{own}copy")
    return mixed.select(f"{own}row", each).select(f"{own}row.*")
