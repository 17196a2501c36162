"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the documents are
ranged by that key, token counts are prefix-summed over the ranges and then
inside each range, and the source is cut at its exact budget.  Whole epochs come
first; the rest of the budget takes a random part of the source, of whose last
document only the first words are taken.

Defined results: null text has size 0; a null source is a source of its own,
last in order; sources of size 0 get target 0; equal keys are ordered by doc_id,
then size; repeated rows are taken each on its own; a text of any length is one
value of its row; further columns stay as they are, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_of, word_array, word_count

#: Weights by position of the source, share of all sizes, most
#: epochs, seed of the random keys.
WEIGHTS = (5, 2, 1)
SHARE = 1.0
MOST_EPOCHS = 3
SEED = "mix-1"
#: Documents that a key range holds on average; ranges multiply with the input.
RANGE_DOCS = 4000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for (source, size) rows.

    Targets are ``least(cap, level * weight)`` with one common level: sources
    reach their cap in order of cap/weight, so the level follows from prefix sums
    in that order: it grows up to the first source that stays below its cap and
    falls from there.  One row per source, nothing per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), place))
    weighed = weighed.withColumn("cap", most_epochs * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy(F.lit(1))
    weighed = (
        weighed.withColumn("before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("still", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("still"))
    )
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return weighed.withColumn("open_level", open_level).select(
        "source",
        "source_size",
        F.when(F.col("open_level").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("open_level") * F.col("weight")))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs, part, sig (hash of its text).

    ``taken`` = ``epochs`` whole passes plus ``part`` leading words of one more.
    """
    sizes = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text_of(text_col)).alias("size"),
            F.xxhash64(text_of(text_col)).alias("sig"),
        )
    )
    targets = cut_lineage(source_targets(sizes, weights, share, most_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budgets = targets.withColumn("epochs", whole.cast("long")).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    digits = max(1, math.ceil(math.log(max(1, sizes.count() / RANGE_DOCS), 16)))
    keyed = sizes.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits)).withColumn("named", F.col("source").isNotNull())
    keyed = keyed.withColumn("source", F.coalesce("source", F.lit("")))
    in_source = Window.partitionBy("source", "named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("source", "named", "range").agg(F.sum("size").alias("range_size"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)))
    budgets = budgets.withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    starts = cut_lineage(ranges.join(budgets, ["source", "named"]).drop("range_size"))
    in_range = Window.partitionBy("source", "named", "range").orderBy("key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = keyed.withColumn("before", before).join(starts, ["source", "named", "range"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before"))).cast("long")
    return cut.withColumn("part", part).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        "epochs",
        "part",
        "sig",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    The last document of a source's budget is cut to its first words, a space
    between them; ``n_chars``, if there, is counted again.  Equal rows are
    interchangeable and told apart by number.
    """
    key = lambda doc_id, sig: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), sig)
    plan = mix(docs, id_col, text_col, **how).select(key(F.col("doc_id"), F.col("sig")).alias("__row"), F.col("epochs").alias("__epochs"), F.col("part").alias("__part"))
    plan = plan.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy("__epochs", "__part")))
    rows = docs.withColumn("__row", key(F.col(id_col), F.xxhash64(text_of(text_col))))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0))))
    taken = rows.join(plan.filter("__epochs + __part > 0"), ["__row", "__nth"])
    passes = F.sequence(F.lit(1).cast("long"), F.col("__epochs") + F.when(F.col("__part") > 0, 1).otherwise(0))
    taken = taken.withColumn("__pass", F.explode(passes))
    some = F.array_join(F.slice(word_array(text_of(text_col)), 1, F.col("__part").cast("int")), " ")
    taken = taken.withColumn(text_col, F.when(F.col("__pass") > F.col("__epochs"), some).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.when(F.col("__pass") > F.col("__epochs"), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in DuckDB's SQL, for the defaults above.
ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0
    ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
  3.0::DOUBLE * source_size AS cap FROM t),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still,
  CAST(sum(source_size) OVER () AS DOUBLE) AS every FROM w),
l AS (SELECT *, max(CASE WHEN (every - before) / still * weight <= cap THEN (every - before) / still END) OVER () AS level FROM f),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
k AS (SELECT s.*, b.source_size, b.target, b.epochs, CAST(round(b.target - b.epochs * b.source_size) AS BIGINT) AS rest,
  sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken,
  epochs, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS part FROM k
"""
