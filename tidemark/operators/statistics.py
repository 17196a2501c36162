"""Resampling, tests and evidence.

Resampling indices come from an md5 of draw and position, so a result never depends
on how rows are partitioned.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import BOOTSTRAP_DRAWS, INTERVAL, MIN_EFFECTIVE, MIN_SAMPLE, SEED
from ..functions import expressions as E


def hashed_index(draw: Column, position: Column, n: Column, seed: int = SEED) -> Column:
    """A number below n for each draw and position: an md5 prefix modulo n."""
    text = F.concat_ws(":", F.lit(seed), draw, position)
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).cast("int")


def _values(rows: DataFrame, by, value: str, order) -> DataFrame:
    """Known values of a group as one array in order: the samples are a few hundred values per group."""
    known = rows.filter(F.col(value).isNotNull())
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"])
    return known.groupBy(*by).agg(sorted_.alias("values")).withColumn("n", F.size("values"))


def _drawn(groups: DataFrame, by, draws: int, parts: int = 16) -> DataFrame:
    """A row for each group and draw; parts of the draws are dealt out, so a group's draws are spread over tasks."""
    size = -(-draws // parts)
    dealt = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // size) - 1)))).repartition(*by, "part")
    last = F.least((F.col("part") + 1) * size, F.lit(draws)) - 1
    return dealt.withColumn("draw", F.explode(F.sequence(F.col("part") * size, last))).drop("part")


def bootstrap(rows: DataFrame, by, value: str, order, block: int = 1, draws: int = BOOTSTRAP_DRAWS, interval=INTERVAL, seed: int = SEED, least: int = 10) -> DataFrame:
    """Intervals of median, mean and win rate by resampling single values (block 1) or moving blocks.

    Groups of fewer than ``least`` values have none.  A draw's sample and its statistics
    are built inside its row, so samples are never shuffled.
    """
    groups = _values(rows, by, value, order).filter(F.col("n") >= least).withColumn("block", F.least(F.lit(block), F.col("n")))
    drawn = _drawn(groups, by, draws)
    # position p is the (p % block)-th value of block p / block, whose start is drawn
    start = lambda p: hashed_index(F.col("draw"), F.floor(p / F.col("block")), F.col("n") - F.col("block") + 1, seed)
    place = lambda p: F.element_at("values", start(p) + (p % F.col("block")) + 1)
    sampled = drawn.select(*by, "n", F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), place)).alias("v"))
    middle = (F.element_at("v", F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at("v", (F.floor(F.col("n") / 2) + 1).cast("int"))) / 2
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    won = F.size(F.filter("v", lambda x: x > 0))
    each = sampled.select(*by, "n", middle.alias("median"), (total / F.col("n")).alias("mean"), (won / F.col("n")).alias("win_rate"))
    edges = {"lo": interval[0] / 100, "hi": interval[1] / 100}
    return each.groupBy(*by, "n").agg(*[F.percentile(s, F.lit(q)).alias(f"{s}_{e}") for s in ("median", "mean", "win_rate") for e, q in edges.items()])


def permutation(rows: DataFrame, by, value: str, order, chosen: Column, draws: int = BOOTSTRAP_DRAWS, seed: int = SEED) -> DataFrame:
    """Chance of a difference from the population's mean as large as that of the chosen rows,
    among samples of their number drawn from the population."""
    population = _values(rows, by, value, order)
    picked = rows.filter(chosen & F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("k"), F.avg(value).alias("observed"))
    joined = population.join(picked, list(by)).withColumn("centre", F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    drawn = _drawn(joined, by, draws)
    place = lambda p: F.element_at("values", hashed_index(F.col("draw"), p, F.col("n"), seed) + 1)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("k").cast("int") - 1), place), F.lit(0.0), lambda s, x: s + x)
    # rounded, so that the order in which doubles are summed can't decide a tie
    far = F.round(F.abs(total / F.col("k") - F.col("centre")), 9) >= F.round(F.abs(F.col("observed") - F.col("centre")), 9)
    return drawn.groupBy(*by).agg(F.first("k").alias("k"), F.first("n").alias("population"), F.first("observed").alias("mean_return"), F.avg(far.cast("double")).alias("p_value"))


def binomial_two_sided(k: int, n: int, p: float) -> float | None:
    """Exact test: sum of the chances of all counts that are no likelier than k."""
    if n == 0 or not 0 <= p <= 1:
        return None
    if p in (0.0, 1.0):
        return 1.0 if k == n * p else 0.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    limit = math.exp(log(k)) * (1 + 1e-7)
    return min(1.0, math.fsum(c for c in (math.exp(log(i)) for i in range(n + 1)) if c <= limit))


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(c) else binomial_two_sided(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def cohens_d(rows: DataFrame, by, value: str, chosen: Column) -> DataFrame:
    """Difference of means of chosen and other rows in pooled deviations; fewer than two of either is NULL."""
    a, b = F.when(chosen, F.col(value)), F.when(~chosen, F.col(value))
    found = rows.groupBy(*by).agg(*[f(x).alias(f"{name}_{s}") for s, x in (("a", a), ("b", b)) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0)))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    return found.withColumn("cohens_d", F.when(enough, E.ratio(F.col("mean_a") - F.col("mean_b"), pooled)))


def benjamini_hochberg(rows: DataFrame, p: str, by=(), alpha: float = 0.05, tie="id") -> DataFrame:
    """Known p-values in order with their rank, the threshold and whether they are rejected, per family."""
    known = rows.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranked = known.withColumns({"rank": F.row_number().over(family.orderBy(p, tie)), "m": F.count(F.lit(1)).over(family)})
    last = F.max(F.when(F.col(p) <= alpha * F.col("rank") / F.col("m"), F.col("rank"))).over(family)
    ranked = ranked.withColumn("last", last)
    threshold = F.max(F.when(F.col("rank") == F.col("last"), F.col(p))).over(family)
    return ranked.withColumns({"threshold": threshold, "rejected": F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))}).drop("last")


def assess(rows: DataFrame, by, value: str, order, chosen: Column, tests: int | None = None, draws: int = BOOTSTRAP_DRAWS, seed: int = SEED) -> DataFrame:
    """All tests of the chosen rows against the population they are from; with fewer than
    ``MIN_SAMPLE`` values only their number.

    Effect size against the whole population, chosen rows included; ``many_tests`` if more
    than 20 were made in the session.
    """
    from .outcomes import compare_to_base

    keys = list(by)
    base = compare_to_base(rows, chosen, value, tuple(by)).select(*by, "n", "win_rate", "base_win_rate")
    limits = bootstrap(rows.filter(chosen), by, value, order, draws=draws, seed=seed).select(*by, "median_lo", "median_hi")
    moved = permutation(rows, by, value, order, chosen, draws, seed).select(*by, F.col("p_value").alias("permutation_p"))
    twice = rows.filter(chosen).withColumn("__a", F.lit(True)).unionByName(rows.withColumn("__a", F.lit(False)))
    effect = cohens_d(twice, by, value, F.col("__a")).select(*by, "cohens_d")
    wins = F.round(F.col("win_rate") * F.col("n"))
    joined = base.join(limits, keys, "left").join(moved, keys, "left").join(effect, keys, "left")
    joined = joined.withColumn("binomial_p", binomial_p(wins, F.col("n"), F.col("base_win_rate")))
    enough = F.col("n") >= MIN_SAMPLE
    found = joined.withColumns({c: F.when(enough, F.col(c)) for c in ("median_lo", "median_hi", "permutation_p", "cohens_d", "binomial_p")})
    return found.withColumns({"sufficient": enough, "quality": E.sample_quality(F.col("n")), "many_tests": F.lit(bool(tests and tests > 20)) & enough}).drop("win_rate", "base_win_rate")


MODES = ("discovery", "confirmatory")


def run_assessment(rows: DataFrame, p: str, by, mode: Column, alpha: float = 0.05, tie: str = "id") -> DataFrame:
    """Per family of tests: how many, the best p, what survives, what chance alone would give.

    ``mode`` is constant in a family; in discovery nothing counts as confirmed.
    """
    value = F.when(~F.isnan(F.col(p).cast("double")), F.col(p))
    family = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tests"), F.min(value).alias("best_p"), F.first(mode).alias("mode"))
    kept = benjamini_hochberg(rows, p, by, alpha, tie).groupBy(*by).agg(F.count_if("rejected").alias("n_rejected"), F.max("threshold").alias("threshold"))
    n = F.col("n_tests")
    return family.join(kept, list(by), "left").select(
        *by, "mode", "n_tests", "best_p", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), "threshold", *snooping(n),
        F.coalesce((n > 1) & (F.col("best_p") > 0.05 / n), F.lit(False)).alias("fails_bonferroni"),
        ((F.col("mode") == MODES[1]) & (F.coalesce("n_rejected", F.lit(0)) > 0)).alias("confirmed"),
    )


def freeze(hypotheses: DataFrame, train_end, prior_tests: Column, now: Column | None = None) -> DataFrame:
    """Hypotheses with their limits fixed: confirmatory from now on, tested on data after ``train_end``.

    One way only: what is frozen already keeps its date, its end of training and its count.
    """
    is_open = F.col("frozen_at").isNull()
    fixed = {"mode": F.lit(MODES[1]), "train_end": F.lit(train_end).cast("date"), "prior_tests": prior_tests.cast("int"), "frozen_at": F.current_timestamp() if now is None else now}
    return hypotheses.withColumns({c: F.when(is_open, v).otherwise(F.col(c)) for c, v in fixed.items()})


def snooping(n: Column) -> list[Column]:
    """Expected false findings among n tests at 5 %, and whether that many need a warning."""
    return [F.when(n > 1, n * 0.05).alias("expected_false"), F.coalesce(n > 20, F.lit(False)).alias("many_tests")]


def sampling_modes(rows: DataFrame, by, value: str, order, weeks: int) -> DataFrame:
    """Summaries of all values, of every h-th, and of all with the size that overlap leaves."""
    known = rows.filter(F.col(value).isNotNull())
    known = known.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    all_ = known.withColumn("mode", F.explode(F.array(F.lit("raw"), F.lit("block"))))
    apart = known.filter(F.col("pos") % max(1, weeks) == 0).withColumn("mode", F.lit("non_overlapping"))
    x = F.col(value)
    found = all_.unionByName(apart).groupBy(*by, "mode").agg(F.count(x).alias("used_n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.median(x).alias("median_return"), F.avg(x).alias("mean_return"))
    eff = F.when(F.col("mode") == "non_overlapping", F.col("used_n")).otherwise(E.effective_n(F.col("used_n"), weeks))
    return found.withColumn("effective_n", eff).withColumn("quality", E.effective_quality(F.col("effective_n")))


def verdict(effective: Column, edge_pp: Column, base: Column, lo: Column, hi: Column) -> Column:
    return (
        F.when(effective < MIN_EFFECTIVE, "not_proven")
        .when(edge_pp.isNull(), "no_data")
        .when(F.abs(edge_pp) < 5, "noise")
        .when(F.coalesce(base.between(lo, hi), F.lit(False)), "unconfirmed")
        .otherwise("robust")
    )


def edge_evidence(rows: DataFrame, by, value: str, order, chosen: Column, weeks: int, draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """Chosen rows against the base rate, with block intervals and a verdict."""
    from .outcomes import compare_to_base

    base = compare_to_base(rows, chosen, value, tuple(by))
    blocks = bootstrap(rows.filter(chosen), by, value, order, block=weeks, draws=draws).select(*by, "median_lo", "median_hi", "win_rate_lo", "win_rate_hi")
    joined = base.join(blocks, list(by), "left").withColumn("effective_n", E.effective_n(F.col("n"), weeks))
    call = verdict(F.col("effective_n"), F.col("win_diff_pp"), F.col("base_win_rate"), F.col("win_rate_lo"), F.col("win_rate_hi"))
    return joined.withColumn("quality", E.effective_quality(F.col("effective_n"))).withColumn("verdict", call)
