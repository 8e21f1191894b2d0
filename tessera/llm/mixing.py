"""Mixing sources to target weights by temperature, realised as budgeted permutations.

A source's weight is its share of tokens to a power between 0 and 1, normalised. The power is found by repeated section of its interval, 32 trial powers in each pass over the sources: the
largest at which the weights reach a wanted entropy, or at which no source is repeated more often than allowed. A
source's part of the budget is then a number of whole epochs, each a keyed permutation of its documents, and
the head of one more. Where that head ends follows from sums over ever smaller parts of the permutation, so no source
is ever sorted or added up in one task, however large.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, materialize, read, text_or_empty

#: Powers that one pass over the sources tries: the interval shrinks by this factor each time.
TRIED, PASSES = 32, 6


def default_tokens(text: Column) -> Column:
    """Words of a text, at least 1, so that an empty text too uses up budget."""
    return F.greatest(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(1)).cast("long")


def boundary(measured: Callable, test: Callable, lo: float, hi: float) -> tuple[float, float]:
    """The last power at which `test` is false and the first at which it is true; it turns once between lo and hi."""
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / TRIED for k in range(1, TRIED)]
        found = measured(grid)
        true = next((k for k, g in enumerate(grid) if test(found[g])), len(grid))
        ends = [lo, *grid, hi]
        lo, hi = ends[true], ends[true + 1]
    return lo, hi


def power_for(sources: DataFrame, budget: float, *, entropy: float | None, repetition: float | None) -> float:
    """The largest power in [0, 1] with the entropy (a share of its largest value), raised as far as the repetition limit asks.

    Without a wanted entropy it is the smallest power that keeps to the limit: the flattest mixture allowed.
    """
    whole = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if (whole.n or 0) < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(whole.t))

    def measured(powers: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy and most epochs at each power; only sums by power leave the executors."""
        raised = F.pow("share", "power")
        tried = sources.withColumn("share", share).withColumn("power", F.explode(F.array(*map(F.lit, powers))))
        rows = tried.groupBy("power").agg(F.sum(raised).alias("z"), F.sum(raised * F.log("share")).alias("l"), F.max(raised / F.col("tokens")).alias("r")).collect()
        return {r.power: ((math.log(r.z) - r.power * r.l / r.z) / math.log(whole.n), r.r / r.z * budget) for r in rows}

    ends = measured([0.0, 1.0])
    power = 1.0 if entropy is not None else 0.0
    if entropy is not None and ends[1.0][0] < entropy:
        power = boundary(measured, lambda m: m[0] < entropy, 0.0, 1.0)[0]
    if repetition is not None and measured([power])[power][1] > repetition:
        power = boundary(measured, lambda m: m[1] <= repetition, power, 1.0)[1]
    return power


def mix(
    docs: DataFrame,
    *,
    budget: int | None = None,
    entropy: float | None = None,
    repetition: float | None = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    broadcast_rows: int = 10_000,
) -> DataFrame:
    """`docs`, each row as often as the mixture takes it, with epoch (from 0), place (order within source and epoch) and n_tokens.

    budget: tokens in all, those of `docs` if None. entropy: wanted of the weights, as a share of that of equal
    weights. repetition: most epochs of a source; where budget or entropy ask for more, it goes first. The last epoch of a source
    takes its documents by place until their tokens reach the rest of its part, the one that reaches it included.
    A null source is a source of its own; a null or empty text counts one token; rows with equal id and text
    share their place and are taken together. An empty table gives an empty one. Other columns stay; columns named epoch,
    place or n_tokens are replaced. Up to `broadcast_rows` sources the plan is broadcast, beyond that it is joined.
    """
    added = ("epoch", "place", "n_tokens")
    names = [c for c in docs.columns if c not in added]
    own = F.struct(F.col(id_col), F.col(text_col))
    slim = docs.select(F.col(source_col).alias("source"), F.xxhash64(own).alias("row"), default_tokens(text_or_empty(text_col)).alias("tokens"))
    slim = materialize(slim, "mixing-rows")  # a few numbers of each document, never its text
    sources = materialize(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mixing-sources")
    whole = sources.agg(F.sum("tokens").alias("t")).first().t or 0
    budget = whole if budget is None else budget
    power = power_for(sources, budget, entropy=entropy, repetition=repetition)
    raised = F.pow(F.col("tokens") / F.lit(float(max(1, whole))), F.lit(power))
    z = sources.agg(F.sum(raised).alias("z")).first().z or 1.0
    epochs = raised / F.lit(z) * F.lit(float(budget)) / F.col("tokens")
    epochs = epochs if repetition is None else F.least(epochs, F.lit(float(repetition)))
    plan = sources.withColumn("all", epochs + F.lit(1e-9)).select(
        "source",
        F.floor("all").cast("int").alias("epochs"),
        (F.col("all") % 1 * F.col("tokens")).cast("long").alias("rest"),
    )
    small = sources.limit(broadcast_rows + 1).count() <= broadcast_rows
    plan = materialize(plan, "mixing-plan")
    cuts = materialize(last_places(slim, plan, seed, small), "mixing-cuts")
    plan = plan.join(cuts, plan["source"].eqNullSafe(cuts["cut_source"]), "left").select(plan["source"].alias("_mix_source"), F.col("epochs").alias("_mix_epochs"), F.col("cut").alias("_mix_cut"))

    taken = with_plan(docs.select(*names), plan, source_col, small)
    copies = F.col("_mix_epochs") + F.when(place(seed, F.col("_mix_epochs"), F.xxhash64(own)) <= F.col("_mix_cut"), 1).otherwise(0)
    taken = taken.withColumn("_mix_n", copies).where("_mix_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
    return taken.select(*names, "epoch", place(seed, F.col("epoch"), F.xxhash64(own)).alias("place"), default_tokens(text_or_empty(text_col)).alias("n_tokens"))


def place(seed: int, epoch: Column, row: Column) -> Column:
    """Where a row stands in the permutation of an epoch: a number from 0 below 2**63."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), row), 1)


def with_plan(rows: DataFrame, plan: DataFrame, source_col: str, small: bool) -> DataFrame:
    side = F.broadcast(plan) if small else plan
    return rows.join(side, rows[source_col].eqNullSafe(side["_mix_source"])).drop("_mix_source")


#: Parts into which each round divides what is left of a permutation.
PARTS = 4096


def last_places(slim: DataFrame, plan: DataFrame, seed: int, small: bool) -> DataFrame:
    """cut_source, cut: the place up to which a source's last epoch is taken; no row where nothing is.

    A place is a number below 2**63. Each round divides the range that holds the cut into PARTS equal parts, sums the tokens of each part over all tasks and goes on
    with the part in which the sum reaches the rest: a source gives PARTS sums at most, wherever its rows lie, and after six rounds the part is a single place.
    """
    named = plan.withColumnRenamed("source", "_mix_source").where("rest > 0")
    rows = with_plan(slim, named, "source", small).withColumn("place", place(seed, F.col("epochs"), F.col("row"))).select("source", "place", "tokens")
    rows = materialize(rows, "mixing-places")
    state = named.select("_mix_source", F.lit(0).cast("long").alias("lo"), F.lit(63).alias("bits"), F.lit(0).cast("long").alias("before"), "rest")
    width = PARTS.bit_length() - 1
    for left in range(63, 0, -width):
        step = max(0, left - width)
        met = with_plan(rows, state, "source", small).where((F.col("place") >= F.col("lo")) & (F.shiftright(F.col("place") - F.col("lo"), left) == 0))
        part = F.shiftright(F.col("place") - F.col("lo"), step)
        sums = met.groupBy("source", "lo", "before", "rest", part.alias("part")).agg(F.sum("tokens").alias("s"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("s").over(W.partitionBy("source").orderBy("part")))
        reached = upto.where("upto >= rest AND upto - s < rest")
        state = materialize(reached.select(F.col("source").alias("_mix_source"), (F.col("lo") + F.shiftleft(F.col("part").cast("long"), step)).alias("lo"), F.lit(step).alias("bits"), (F.col("upto") - F.col("s")).alias("before"), "rest"), "mixing-cut")
    return state.select(F.col("_mix_source").alias("cut_source"), F.col("lo").alias("cut"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "place", "n_tokens")
