"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows inside
each text's row.  What passes them is judged by its transformed statistics: per
language and source a minimum-covariance-determinant estimate is made by
concentration steps (keep the ``SHARE`` of rows with the smallest Mahalanobis
distance, estimate again), from two deterministic starts, each until a step no
longer lowers its determinant; the smaller determinant wins, and rows too far from
the estimate are rejected.

Counts (symbols, repeated lines, repeats measured in lines) are variance-stabilised, 2 sqrt(k + 3/8),
and spread by a uniform number of variance one that a row's statistics fix.  That is
the sampling noise of any count: none seen doesn't mean that none are usual.  So no
statistic is constant and spreads come from the rows; all are then measured from their
group's median in its median deviations.  What is left to regularise is the rare group whose statistics
depend on each other: the covariance is mixed with the identity at the weight at which
its trace keeps the condition number below ``CONDITION`` (as in the regularised form of the
method, Boudt and others, 2020), half a percent of a statistic's variance as a rule.

Limits are each group's own: the logarithms of its distances have a median and a median
deviation, which bad rows hardly move, and a row is rejected where a normal variable
with these exceeds it with probability ``TAIL``, the one target.  A spread narrower than normal rows'
is not believed.

Estimates and limits are of distinct statistics, so copies of a text count once in them.
An estimate needs five of them for each statistic.  Groups with fewer are estimated
together with those of their language, what is still too few with all such; if those
are too few as well, no row of theirs is rejected.

Only counts by bin and sums of products move between tasks, a row for each group
(and bin) and task, so no group is ever gathered and none can be hot.  Medians and
the cut of a concentration step are taken from bins, so they don't depend on the
order of rows.

Defined results: null text has no words and fails; null language or source is a
value of its own; equal distances are kept together; repeated doc_ids and equal rows
are judged row by row; a text of any length is one value of its row; further columns
are not read and can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut_lineage, text_of, word_array

SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
SHARE = 0.75
#: Share of normal rows that a limit would reject.
TAIL = 1e-5
#: Bound of a covariance's condition number, in units of median deviations.
CONDITION = 1000.0
#: Bins per unit for medians, per unit of a squared distance's logarithm in steps, and in limits.
BINS = 1024
LOG_BINS = 64
LIMIT_BINS = 256
#: A step that lowers a determinant's logarithm by less is the last.
SETTLED = 1e-4
DIMS = 5
#: Rows that an estimate needs.
LEAST = 5 * DIMS


def row_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the group columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A word is in a repeated window if its three-word window, or one of the two
    before, occurs elsewhere in the text.  Windows are compared by 64-bit hash
    within one text: hashes are sorted with their places, equal neighbours
    marked, and the marked places' reaches summed.  Most texts have no window
    twice, which a set of their hashes shows at once.
    """
    text = F.col("__text")
    groups = [f"by{k}" for k in range(len(by))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(g) for g, c in zip(groups, by)], text_of(text_col).alias("__text"))
    rows = rows.select(
        "doc_id",
        *groups,
        F.length(F.regexp_replace(text, SPACE_CLASS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform(word_array(text), lambda w: F.xxhash64(w)).alias("words"),
    )
    n = F.greatest(F.size("words") - 2, F.lit(0))
    one, two, three = (F.slice("words", k, n) for k in (1, 2, 3))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("lines", "words")],
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.zip_with(F.zip_with(one, two, lambda a, b: F.xxhash64(a, b)), three, lambda ab, c: F.xxhash64(ab, c)).alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    single = F.size(F.array_distinct("windows")) == F.size("windows")
    rows = rows.withColumn("hashed", F.when(single, none).otherwise(placed)).drop("windows")
    gap = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    others = F.greatest(F.size("hashed") - 1, F.lit(0))
    beside = F.arrays_zip(F.col("hashed").alias("x"), F.concat(gap, F.slice("hashed", 1, others)).alias("p"), F.concat(F.slice("hashed", 2, others), gap).alias("q"))
    twice = F.filter(beside, lambda e: F.coalesce(e["x"]["h"] == e["p"]["h"], F.lit(False)) | F.coalesce(e["x"]["h"] == e["q"]["h"], F.lit(False)))
    rows = rows.select(*[c for c in rows.columns if c != "hashed"], F.sort_array(F.transform(twice, lambda e: e["x"]["i"])).alias("places"))
    later = F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0)))
    reach = F.zip_with("places", later, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(*[c for c in rows.columns if c != "places"], covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def vector() -> list[Column]:
    """The transformed statistics of a row that passed the base rules."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    fine = 1 << 20
    even = lambda k: (F.pmod(F.xxhash64(*COUNTS, F.lit(k)), F.lit(fine)) + 0.5) / fine - 0.5
    steady = lambda k, count: 2 * F.sqrt(count + 0.375) + math.sqrt(12) * even(k)
    return [
        F.log(words),
        F.log(chars / words),
        steady(2, F.col("n_symbols")),
        steady(3, F.col("n_dup_lines")),
        steady(4, F.col("n_repeat_words") * F.greatest(F.col("n_lines"), F.lit(1)) / words),
    ]


def chi_square_below(x: float, dims: int) -> float:
    """P(chi-square with ``dims`` degrees of freedom < x), by its recurrence."""
    p = math.erf(math.sqrt(x / 2)) if dims % 2 else 1 - math.exp(-x / 2)
    for k in range(3 if dims % 2 else 4, dims + 1, 2):
        p -= math.exp((k / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(k / 2))
    return p


def chi_square_limit(tail: float, dims: int) -> float:
    low, high = 1e-9, 1e4
    above = lambda x: 1 - chi_square_below(x, dims) if x < 60 else _far_tail(x, dims)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > tail else (low, mid)
    return high


def _far_tail(x: float, dims: int) -> float:
    """The tail as a sum of positive terms, where one minus the rest has no digits left."""
    p = math.erfc(math.sqrt(x / 2)) if dims % 2 else math.exp(-x / 2)
    for k in range(3 if dims % 2 else 4, dims + 1, 2):
        p += math.exp((k / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(k / 2))
    return p


def consistency(share: float, dims: int) -> float:
    """What makes the covariance of the nearest ``share`` of a normal sample right."""
    return share / chi_square_below(chi_square_limit(1 - share, dims), dims + 2)


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments(share_factor: float) -> list[Column]:
    """Means and regularised covariances from sums n, s*, p**."""
    mean = {i: F.col(f"s{i}") / F.col("n") for i in range(DIMS)}
    cov = lambda i, j: (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) * share_factor
    trace = reduce(lambda a, b: a + b, [F.greatest(cov(i, i), F.lit(0.0)) for i in range(DIMS)])
    # eigenvalues lie between the weight and the weight plus the trace
    weight = F.greatest(trace / (CONDITION - 1 + trace), F.lit(1 / CONDITION))
    mixed = lambda i, j: (1 - weight) * cov(i, j) + (weight if i == j else 0.0)
    return [*[mean[i].alias(f"m{i}") for i in range(DIMS)], *[mixed(i, j).alias(f"c{i}{j}") for i, j in PAIRS]]


def _with_cholesky(estimates: DataFrame) -> DataFrame:
    """Adds the lower factor l** column by column (the mixture keeps it positive) and the determinant's logarithm."""
    for i, j in PAIRS:
        done = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(done, F.lit(1e-12))) if i == j else done / F.col(f"l{j}{j}"))
    size = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(DIMS)])
    keys = [c for c in estimates.columns if c in ("grp", "start")]
    return estimates.select(*keys, *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS], size.alias("size"))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared distance: forward substitution, then the sum of squares."""
    for i in range(DIMS):
        left = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", left / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)]))


def _medians(rows: DataFrame, values: list[Column], name: str, fine: int = BINS) -> DataFrame:
    """Per group the medians of ``values``, to 1/fine, as columns name0, name1 and so on."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.floor(v * fine).alias("bin")) for k, v in enumerate(values)]))
    counts = rows.select("grp", cells.alias("cell")).groupBy("grp", "cell.dim", "cell.bin").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("grp", "dim").orderBy("bin")
    half = counts.withColumn("below", F.sum("n").over(in_order)).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "dim")))
    middle = half.filter("2 * below >= all").groupBy("grp", "dim").agg(((F.min("bin") + 0.5) / fine).alias("median"))
    return middle.groupBy("grp").agg(*[F.max(F.when(F.col("dim") == k, F.col("median"))).alias(f"{name}{k}") for k in range(len(values))])


def scales(rows: DataFrame) -> DataFrame:
    """Per group the median a* and the deviation v* of each statistic; one that doesn't differ keeps its unit."""
    medians = cut_lineage(_medians(rows, [F.col(f"x{i}") for i in range(DIMS)], "a"))
    spread = _medians(rows.join(medians, "grp"), [F.abs(F.col(f"x{i}") - F.col(f"a{i}")) for i in range(DIMS)], "v")
    # a spread of less than a bin is none
    wide = [F.when(F.col(f"v{i}") * BINS >= 1, 1.4826 * F.col(f"v{i}")).otherwise(F.lit(1.0)).alias(f"v{i}") for i in range(DIMS)]
    return cut_lineage(medians.join(spread, "grp").select("grp", *[f"a{i}" for i in range(DIMS)], *wide))


def scaled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with statistics in units of their group's scales; null without a group."""
    joined = rows.join(found, "grp", "left")
    return joined.withColumns({f"x{i}": (F.col(f"x{i}") - F.col(f"a{i}")) / F.col(f"v{i}") for i in range(DIMS)}).drop(*[f"{c}{i}" for c in "av" for i in range(DIMS)])


def limits(rows: DataFrame, tail: float = TAIL) -> DataFrame:
    """Per group ``far``, the squared distance beyond which a row is rejected, from columns grp and d2."""
    size = F.log(F.col("d2") + 1e-12)
    middle = cut_lineage(_medians(rows, [size], "o", LIMIT_BINS))
    spread = _medians(rows.join(middle, "grp"), [F.abs(size - F.col("o0"))], "w", LIMIT_BINS)
    quarter, three = chi_square_limit(0.75, DIMS), chi_square_limit(0.25, DIMS)
    normal = math.log(three / quarter) / (2 * NormalDist().inv_cdf(0.75))
    width = F.greatest(1.4826 * F.col("w0"), F.lit(normal))
    return middle.join(spread, "grp").select("grp", F.exp(F.col("o0") + NormalDist().inv_cdf(1 - tail) * width).alias("far"))


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates for each group, of rows in units of its scales: medians and median deviations, and all rows."""
    classical = rows.groupBy("grp").agg(*_sums())
    unit = [*[F.lit(0.0).alias(f"m{i}") for i in range(DIMS)], *[F.lit(float(i == j)).alias(f"c{i}{j}") for i, j in PAIRS]]
    robust = classical.select("grp", F.lit(0).alias("start"), *unit)
    return _with_cholesky(robust.union(classical.select("grp", F.lit(1).alias("start"), *_moments(1.0))))


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS],
    ]


def _concentrate(rows: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """One concentration step: moments of the nearest ``share`` of each group's rows.

    Rows are counted by distance bin; a window over the bins finds the last that is
    needed, and the rows up to it are summed.
    """
    near = _with_distance(rows.join(found, "grp")).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * LOG_BINS))
    bins = near.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("grp", "start").orderBy("bin")
    nearer = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(Window.partitionBy("grp", "start"))
    needed = bins.withColumn("nearer", nearer).withColumn("every", every).filter(F.col("nearer") < share * F.col("every"))
    last = needed.groupBy("grp", "start").agg(F.max("bin").alias("last"))
    total = near.join(last, ["grp", "start"]).filter("bin <= last").groupBy("grp", "start").agg(*_sums())
    return _with_cholesky(total.select("grp", "start", *_moments(consistency(share, DIMS))))


def estimates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Per group the estimate with the smallest determinant, from columns grp and x0, x1 and so on.

    Starts whose determinant a step no longer lowers are done; each step lowers that of
    the others by more than ``SETTLED``, so it comes to an end.
    """
    now = cut_lineage(_concentrate(rows, cut_lineage(_starts(rows)), share))
    columns, done = now.columns, []
    while True:
        # a step's rows hold what they came from, so what is done is read from them without joins that add up
        then = now.select("grp", "start", F.struct(*columns).alias("then"))
        after = cut_lineage(_concentrate(rows, now, share).join(then, ["grp", "start"]).withColumn("lower", F.col("size") < F.col("then.size") - SETTLED))
        done.append(after.filter("not lower").select("then.*"))
        now = after.filter("lower").select(*columns)
        if now.isEmpty():
            break
    done = reduce(DataFrame.unionByName, done)
    best = Window.partitionBy("grp").orderBy("size", "start")
    return done.withColumn("__place", F.row_number().over(best)).filter("__place = 1").drop("__place", "start", "size")


def pooled(rows: DataFrame, groups: list[str], counted: list[str] | None = None) -> DataFrame:
    """``rows`` with ``grp``: their own group, or what is left of ever wider ones, until it has ``LEAST`` rows
    that passed (distinct ones in the columns ``counted``); null if none has.

    Only sizes by group are counted, so a row learns its group by a join with a few.
    """
    name = lambda k: F.to_json(F.struct(F.lit(k).alias("n"), *[F.coalesce(g, F.lit("\0")).alias(g) for g in groups[:k]]))
    passed = rows.filter("not base_failed")
    passed = passed.select(*groups, *counted).distinct() if counted else passed
    sizes = passed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.lit(None).cast("string"))
    for k in range(len(groups), -1, -1):
        open_size = F.sum(F.when(F.col("grp").isNull(), F.col("n"))).over(Window.partitionBy(*groups[:k]) if k else Window.partitionBy(F.lit(1)))
        sizes = sizes.withColumn("grp", F.coalesce("grp", F.when(open_size >= LEAST, name(k))))
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(F.col(f"of_{g}")) for g in groups], F.lit(True))
    named = cut_lineage(sizes.select(*[F.col(g).alias(f"of_{g}") for g in groups], "grp"))
    return rows.join(named, same, "left").drop(*[f"of_{g}" for g in groups])


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    by: tuple[str, ...] = ("lang", "source"),
    share: float = SHARE,
    tail: float = TAIL,
) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, distance (null: not judged), kept."""
    groups = [f"by{k}" for k in range(len(by))]
    rows = cut_lineage(row_statistics(docs, id_col, text_col, by).withColumn("base_failed", base_failed()))
    named = pooled(rows, groups, list(COUNTS)).select("*", *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    columns = ["grp", *[f"x{i}" for i in range(DIMS)]]
    distinct = cut_lineage(named.filter("not base_failed and grp is not null").select(*columns).distinct())
    units = scales(distinct)
    judged = cut_lineage(scaled(distinct, units).select(*columns))
    found = cut_lineage(estimates(judged, share))
    far = limits(_with_distance(judged.join(found, "grp")), tail)
    measured = _with_distance(scaled(named, units).join(found.join(far, "grp"), "grp", "left"))
    passed = ~F.col("base_failed")
    odd = F.coalesce(passed & (F.col("d2") > F.col("far")), F.lit(False))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (passed & ~odd).alias("kept"), F.when(passed, F.sqrt("d2")).alias("distance"),
    )
