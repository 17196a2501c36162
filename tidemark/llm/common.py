"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space that separates words (space, tab, line feed, vertical tab, form
#: feed, carriage return) as a character class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests) may leave it unset and gets a folder of its own;
    on a cluster other executors couldn't read such a one, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def id_number(docs: DataFrame, id_col: str) -> Column:
    """An id as a long: its value if it is a whole number, else a hash of it; null stays null."""
    kind = docs.schema[id_col].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    return F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of ``text``: maximal runs of anything but white space."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, SPACE_CLASS))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS))).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """The schema and more nullable fields, by name and type."""
    return StructType([*schema.fields, *[StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType) for name, kind in kinds.items()]])
