"""Mixing sources to target weights by temperature.

The token share of source i, raised to an exponent a in [0, 1] and normalised,
is its weight: a = 1 keeps the natural mix, a = 0 is uniform. The exponent is
bisected (five halvings per Spark job, over the per-source totals, which stay
distributed) to the largest one whose weights reach the target entropy, and, if
that repeats a source too often, to the smallest that meets the repetition
limit.

The weights are then realised as budgeted permutations: a source with budget b
and t tokens is passed b div t times whole, and once more up to the remaining
tokens, in the order of a seeded hash of the row: blocks of the permutation are
hash ranges. The place where the last pass ends is found by sums over 4,096
blocks, over 4,096 parts of the block it ends in, then over that part's rows,
so no task ever orders a whole source. Texts are not shuffled.

Defined cases: null text counts as empty; null sources are one source; a source
without tokens has weight 0 and takes no part; rows equal in id and text share
their place, so they stay or go together; other columns are kept as they are (but for earlier
``mix_`` results).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.llm.common import BROADCAST_ROWS, bounded_broadcast, materialize, prepare, row_key

TOKENS = r"regexp_count(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"
STEPS, ROUNDS = 31, 6
BLOCK_BITS = 12
PLACE_BITS = 63


def _tokens(col: str = "text"):
    return F.expr(TOKENS.format(col)).cast("long")


def _source(col: str = "source"):
    """Source as a non-null key: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def _place(seed: int):
    """Place of a row in the permutation, 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(row_key(), F.lit(seed)), 1)


def source_totals(docs: DataFrame) -> DataFrame:
    """(src, tokens, rows) of every source."""
    return (docs.select(_source().alias("src"), _tokens().alias("t"))
            .groupBy("src").agg(F.sum("t").alias("tokens"), F.count("*").alias("rows")))


def _mix_figures(totals: DataFrame, whole: int, budget: float, exponents: list[float]):
    """Entropy and largest repetition of the mix at each exponent, in one job.
    A row per exponent with three figures: with all of them in one row, the
    driver plans and compiles as many aggregates as there are figures."""
    lp = F.log(F.col("tokens") / F.lit(float(whole)))
    grid = totals.select(lp.alias("lp"), F.posexplode(F.array(*[F.lit(float(a)) for a in exponents])).alias("k", "a"))
    e = F.exp(F.col("a") * F.col("lp"))
    rows = grid.groupBy("k").agg(F.sum(e), F.sum(e * F.col("lp")), F.max(F.exp((F.col("a") - 1.0) * F.col("lp")))).collect()
    return [(math.log(z) - exponents[k] * zl / z, budget / whole * m / z) for k, z, zl, m in sorted(rows)]


def _bisect(totals, whole, budget, low_is_good, test):
    """Boundary in [0, 1] of a monotone ``test`` of (entropy, repetition)."""
    lo, hi = 0.0, 1.0
    ends = _mix_figures(totals, whole, budget, [lo, hi])
    if test(ends[1 if low_is_good else 0]):
        return hi if low_is_good else lo
    if not test(ends[0 if low_is_good else 1]):
        return lo if low_is_good else hi
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / (STEPS + 1) for k in range(STEPS + 2)]
        good = [test(f) for f in _mix_figures(totals, whole, budget, grid[1:-1])]
        if low_is_good:
            k = sum(good)
            lo, hi = grid[k], grid[k + 1]
        else:
            k = len(good) - sum(good)
            lo, hi = grid[k], grid[k + 1]
    return lo if low_is_good else hi


def choose_exponent(totals: DataFrame, budget: float, target_entropy: float | None,
                    max_repeats: float | None) -> float:
    """The exponent for a target entropy in nats and a repetition limit.
    ``totals`` has only sources with tokens. Raises if the budget itself
    exceeds the limit."""
    whole = totals.agg(F.sum("tokens")).first()[0]
    if max_repeats is not None and budget > max_repeats * whole * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens repeats {whole} tokens more than {max_repeats} times")
    a = 1.0
    if target_entropy is not None:
        a = _bisect(totals, whole, budget, True, lambda f: f[0] >= target_entropy - 1e-12)
    if max_repeats is not None:
        a = max(a if target_entropy is not None else 0.0,
                _bisect(totals, whole, budget, False, lambda f: f[1] <= max_repeats * (1 + 1e-9)))
    return a


def half_way_entropy(totals: DataFrame, part: float = 0.5) -> float:
    """Entropy ``part`` of the way from the natural mix to the uniform one."""
    whole = totals.agg(F.sum("tokens")).first()[0]
    (flat, _), (natural, _) = _mix_figures(totals, whole, whole, [0.0, 1.0])
    return natural + part * (flat - natural)


def weights(spark: SparkSession, docs: DataFrame, budget: float | None = None, entropy_part: float | None = 0.5,
            max_repeats: float | None = 4.0) -> DataFrame:
    """(src, tokens, rows, exponent, weight, budget, passes, rest) per source:
    ``passes`` whole passes and ``rest`` tokens of another one."""
    totals = materialize(spark, source_totals(docs), "mix_totals")
    some = totals.filter("tokens > 0")
    whole = some.agg(F.sum("tokens")).first()[0]
    if not whole:
        a, budget, z = 1.0, 0.0, 1.0
    else:
        budget = float(whole if budget is None else budget)
        target = None if entropy_part is None else half_way_entropy(some, entropy_part)
        a = choose_exponent(some, budget, target, max_repeats)
        z = some.agg(F.sum(F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(whole)))))).first()[0]
    share = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(whole or 1)))) / F.lit(z)
    return (totals.withColumn("exponent", F.lit(a))
            .withColumn("weight", F.when(F.col("tokens") > 0, share).otherwise(0.0))
            .withColumn("budget", F.col("weight") * F.lit(budget))
            # a budget that is a whole number of passes but for rounding is one
            .withColumn("passes", F.coalesce(F.floor(F.try_divide("budget", "tokens") + 1e-9), F.lit(0)).cast("int"))
            .withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("tokens"))))


def _last_passes(spark: SparkSession, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(src, cut_place, cut_rk): the last row of each source's partial pass, in
    order of (place, _rk); no row for a pass of no rows."""
    shift = PLACE_BITS - BLOCK_BITS
    b1 = F.expr(f"shiftrightunsigned(place, {shift})")
    b2 = F.expr(f"shiftrightunsigned(place, {shift - BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L")

    def ends_in(sums: DataFrame, block: str) -> DataFrame:
        """Of per-block sums with ``rest``: the block where it runs out."""
        upto = Window.partitionBy("src").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = sums.withColumn("cum", F.sum("t").over(upto))
        return (cum.filter("cum > rest and cum - t <= rest")
                .groupBy("src").agg(F.min(F.struct(F.col(block), (F.col("rest") - (F.col("cum") - F.col("t"))).alias("left")))
                                    .alias("m"))
                .select("src", F.col(f"m.{block}").alias(block), F.col("m.left").alias("rest")))

    small, _ = bounded_broadcast(plan.select("src", "rest"), BROADCAST_ROWS)
    level1 = ends_in(rows.groupBy("src", b1.alias("b1")).agg(F.sum("t").alias("t")).join(small, "src"), "b1")
    level1 = materialize(spark, level1, "mix_blocks")
    hint1, _ = bounded_broadcast(level1.withColumnRenamed("b1", "want1"), BROADCAST_ROWS)
    inside = rows.withColumn("b1", b1).withColumn("b2", b2).join(hint1, "src").filter("b1 = want1")
    inside = materialize(spark, inside.drop("want1"), "mix_block_rows")
    level2 = ends_in(inside.groupBy("src", "b2").agg(F.sum("t").alias("t"), F.first("rest").alias("rest")), "b2")
    level2 = materialize(spark, level2, "mix_parts")
    part = inside.drop("rest").join(level2.withColumnRenamed("b2", "want2"), "src").filter("b2 = want2")
    upto = Window.partitionBy("src").orderBy("place", "_rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    single = part.groupBy("src", "place", "_rk", "rest").agg(F.sum("t").alias("t"))  # repeated rows are one
    fits = single.withColumn("cum", F.sum("t").over(upto)).filter("cum <= rest")
    last = fits.groupBy("src").agg(F.max(F.struct("place", "_rk")).alias("m"))
    # No row of the part fits: the pass ends where the part begins.
    start = level2.join(level1.drop("rest"), "src").select(
        "src", F.expr(f"shiftleft(b1, {shift}) + shiftleft(b2, {shift - BLOCK_BITS}) - 1").alias("start"))
    return start.join(last, "src", "left").select(
        "src", F.coalesce("m.place", "start").alias("cut_place"), F.coalesce("m._rk", F.lit("")).alias("cut_rk"))


def mix(spark: SparkSession, docs: DataFrame, budget: float | None = None, entropy_part: float | None = 0.5,
        max_repeats: float | None = 4.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(docs with ``mix_copies`` and ``mix_tokens`` added, the weights table).

    ``budget`` is in tokens (by default as many as there are). Every row is
    returned; ``mix_copies`` says how often it stands in the mix.
    """
    prepare(spark)
    # The user's row is one column: no name of it meets a name used here.
    kept = [c for c in docs.columns if c not in ("mix_copies", "mix_tokens", "mix_place")]
    keyed = docs.select(row_key().alias("_rk"), _source().alias("_src"), _tokens().alias("_tokens"), _place(seed).alias("_place"),
                        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    narrow = keyed.select("_rk", F.col("_src").alias("src"), F.col("_tokens").alias("t"), F.col("_place").alias("place"))
    narrow = materialize(spark, narrow, "mix_rows")
    plan = materialize(spark, weights(spark, docs, budget, entropy_part, max_repeats), "mix_weights")
    cuts = _last_passes(spark, narrow, plan)
    per_source = materialize(spark, plan.join(cuts, "src", "left").select(
        F.col("src").alias("_src"), F.col("passes").alias("_passes"), F.col("cut_place").alias("_cut"),
        F.col("cut_rk").alias("_cut_rk")), "mix_cuts")
    per_source, _ = bounded_broadcast(per_source, BROADCAST_ROWS)
    before = ((F.col("_place") < F.col("_cut")) | ((F.col("_place") == F.col("_cut")) & (F.col("_rk") <= F.col("_cut_rk"))))
    mixed = keyed.join(per_source, "_src").select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        (F.col("_passes") + F.coalesce(before.cast("int"), F.lit(0))).alias("mix_copies"),
        F.col("_tokens").alias("mix_tokens"), F.col("_place").alias("mix_place"))
    return mixed, plan


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as the mix has it, with the number of the copy."""
    return mixed.filter("mix_copies > 0").select(
        *columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
