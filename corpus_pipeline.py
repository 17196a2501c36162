"""A corpus from raw documents to packed sequences, stage by stage.

Every stage gets what the one before kept, works on all of it, and returns the
columns of documents; the last returns the packed pieces.  Between stages rows
are written as Parquet to the shared folder and read again, so a lost executor
never sends the work back beyond the stage it was in.

Defined results of every stage: a null text counts as empty; rows that repeat, or
share a doc_id, are judged each on its own; columns besides those of documents stay
and may have any name that doesn't start with ``__``; texts of any length are read
whole; an empty table gives no rows.  What differs by stage is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, ordinal_quality, packing, simhash
from tidemark.llm.common import checkpoint_folder, table
from tidemark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; texts without words are among them.

    Ties with the limit stay.  Without labels of two grades only texts without words go.
    """
    return ordinal_quality.keep_good(docs, ordinal_quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null one only if there is no other; one of rows alike in all."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their five-word shingles one stays; each pair is verified (see README).

    Candidates are the components of SimHash fingerprints within three bits, and bands of minima for what these miss.
    Of two such rows the one that meets more others stays, of equals the one with the
    smaller doc_id, null last.  Texts without words are equal to each other; texts of fewer
    than five words have one shingle.
    """
    return simhash.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, the last of a source in part.

    A null source is one of its own, last in order; texts without words come with whole passes only.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; an empty text is the end id alone.  Columns are those of the pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Not expressible: the classifier is fitted, and tokens are merged by a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
