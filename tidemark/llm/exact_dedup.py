"""Exact deduplication by skew-safe combining.

Copies meet in three steps: inside each task (map-side combine), then per
(digest, salt), then per digest.  Every step groups on the full content besides
the digest, so a digest collision can't merge different texts.  Verdicts travel
back by digest; the groups are looked through for digests with more than one
content first, and for those, should there be any, the way back compares contents
too.  However large one group of copies is, a task sends at most ``salts`` rows for
it, and no task receives more than its salt's share.

Defined results: null text counts as empty; a null ``doc_id`` loses to any
other, and a group with nulls only keeps one of them (``keep_id`` null); of rows
that share doc_id and text exactly one is kept; a text of any length is compared
whole; an empty table gives no rows; columns of the input other than the two named
ones are neither read nor able to clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_of

#: At most 64, the bits of a long.
SALTS = 64
#: Hexadecimal digits of the SHA-256 that texts meet under; fewer give collisions, for tests.
DIGITS = 64


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digits: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("content")).select(
        "doc_id",
        "content",
        F.substring(F.sha2("content", 256), 1, digits).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )


def _winners(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row per content: the winner of the winners of its salts, and which salts it has.

    Besides it the same rows with their content for the digests that several contents
    share, or None if there are none.
    """
    per_salt = keyed.groupBy("digest", "content", "salt").agg(F.max("doc_id").alias("salt_keep"), F.count(F.lit(1)).alias("salt_size"))
    overall = per_salt.groupBy("digest", "content").agg(
        F.max("salt_keep").alias("keep_id"),
        F.sum("salt_size").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salt_bits"),
    )
    winners = cut_lineage(overall.drop("content"))
    shared = cut_lineage(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest"))
    if shared.isEmpty():
        return winners, None
    return winners.join(shared, "digest", "left_anti"), overall.join(shared, "digest", "left_semi")


def _salted(verdicts: DataFrame, salts: int) -> DataFrame:
    in_salts = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("salt_bits", s) == 1)
    return verdicts.withColumn("salt", F.explode(in_salts)).drop("salt_bits")


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digits: int = DIGITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The verdict travels back to the members over (digest, salt), so members of
    a huge group are spread over ``salts`` keys there as well.
    """
    keyed = _keyed(docs, id_col, text_col, salts, digits)
    winners, colliding = _winners(keyed)
    members = keyed.withColumn("text_sha256", F.sha2("content", 256))
    found = members.drop("content").join(_salted(winners, salts), ["digest", "salt"])
    if colliding is not None:
        found = found.unionByName(members.join(_salted(colliding, salts), ["digest", "salt", "content"]).drop("content"))
    first = F.row_number().over(Window.partitionBy("digest", "salt", "text_sha256", "doc_id").orderBy(F.lit(0)))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (first == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digits: int = DIGITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    winners, colliding = _winners(_keyed(docs, id_col, text_col, salts, digits))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = docs.withColumns({"__id": F.concat(F.col(id_col).isNull().cast("string"), key(id_col)), "__digest": F.substring(F.sha2(text_of(text_col), 256), 1, digits)})
    named = lambda w: w.select(F.concat(F.col("keep_id").isNull().cast("string"), key("keep_id")).alias("__id"), F.col("digest").alias("__digest"), *[c for c in w.columns if c == "content"])
    stay = rows.join(named(winners), ["__id", "__digest"], "left_semi")
    by = ["__id", "__digest"]
    if colliding is not None:
        more = named(colliding).withColumnRenamed("content", "__content")
        rows, stay = rows.withColumn("__content", text_of(text_col)), stay.withColumn("__content", text_of(text_col))
        stay = stay.unionByName(rows.join(more, ["__id", "__digest", "__content"], "left_semi"))
        by.append("__content")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    return stay.withColumn("__first", first).filter("__first = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
