"""Stored tables: Parquet folders with append-once, checked replacement and additive migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import single_file

#: Schemas of the stored tables, and the keys that never repeat.
SCHEMAS = {
    "positions_raw": "market string, participant string, report_date date, availability_date date, availability_source string, long bigint, short bigint, open_interest bigint, source string, ingested_at timestamp",
    "price_raw": "market string, date date, close double, source string, ingested_at timestamp",
    "quality_log": "run_at timestamp, source string, check_name string, status string, detail string",
    "notebook": "created_at timestamp, title string, kind string, condition_text string, params_json string, results_json string, note string",
    "hypotheses": "run_at timestamp, condition_text string, market string, horizon_weeks int",
    "frozen_hypotheses": "hid string, condition_text string, market string, horizon_weeks int, frozen_at timestamp, train_end date, mode string, prior_tests int, note string",
    "schema_watch": "dataset string, column_signature string, last_checked timestamp",
}
UNIQUE = {
    "positions_raw": ["market", "participant", "report_date", "source"],
    "price_raw": ["market", "date", "source"],
}


def new_rows(arriving: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``arriving`` whose key isn't there yet, each key once; NULL keys are equal to none."""
    return arriving.dropDuplicates(key).join(have.select(*key), key, "left_anti")


class Store:
    """Tables under a root folder, partitioned by market where they have one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        self.recover(table)
        return self._there(table)

    def schema(self, table: str) -> StructType:
        return self.spark.createDataFrame([], SCHEMAS[table]).schema

    def read(self, table: str, market: str | None = None) -> DataFrame:
        """The table, or an empty one; a market is pruned to its partition."""
        if not self.exists(table):
            rows = self.spark.createDataFrame([], self.schema(table))
        else:
            rows = self.spark.read.option("mergeSchema", "true").parquet(self.path(table))
        return rows.filter(F.col("market") == market) if market else rows

    def _write(self, rows: DataFrame, table: str, mode: str) -> None:
        writer = rows.write.mode(mode)
        (writer.partitionBy("market") if "market" in rows.columns else writer).parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> int:
        """Append what isn't there yet; how many rows that was."""
        self.check(table, rows)
        fresh = new_rows(rows, self.read(table), UNIQUE[table]) if table in UNIQUE else rows
        # counted while they are written, so other writers' rows don't count
        seen = Observation()
        self._write(fresh.observe(seen, F.count(F.lit(1)).alias("n")), table, "append")
        return seen.get["n"]

    def count_hypotheses(self) -> int:
        return self.read("hypotheses").count()

    def replace(self, table: str, rows: DataFrame, columns: list[str] | None = None) -> None:
        """The table's new content; ``rows`` may be made from the old one, so it is written beside it first.

        The old content is renamed, not deleted, until the new one has its name; what a
        crash in between leaves is put right by the next `exists` or `read` (see `recover`).
        """
        if columns is not None:
            self.check(table, rows, columns)
        self.recover(table)
        self._write(rows, f"{table}__new", "overwrite")
        self._swap(table)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rename(self, a: str, b: str) -> None:
        (old, files), (new, _) = self._files(a), self._files(b)
        if not files.rename(old, new):
            raise OSError(f"could not rename {old} to {new}")

    def _there(self, name: str) -> bool:
        path, files = self._files(name)
        return files.exists(path)

    def _swap(self, table: str) -> None:
        if self._there(table):
            self._rename(table, f"{table}__old")
        self._rename(f"{table}__new", table)
        path, files = self._files(f"{table}__old")
        files.delete(path, True)

    def recover(self, table: str) -> None:
        """After a crash within `replace`: the new content if it was complete, else the old one."""
        if self._there(f"{table}__old"):
            if not self._there(table):
                complete = self._there(f"{table}__new/_SUCCESS")
                self._rename(f"{table}__new" if complete else f"{table}__old", table)
            path, files = self._files(f"{table}__old")
            files.delete(path, True)

    def replace_touched(self, table: str, rows: DataFrame, by: tuple[str, ...] = ("market",)) -> None:
        """New content of the partitions that ``rows`` are in; others keep their files.

        Spark writes the new files aside and moves whole partitions when the job commits, so a
        job that fails before that leaves the table as it was.  ``rows`` may be made from the
        table.  A partition of which ``rows`` have none stays.
        """
        self.recover(table)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(table))

    def check(self, table: str, rows: DataFrame, columns: list[str] | None = None) -> None:
        extra = set(rows.columns) - set(columns if columns is not None else self.schema(table).names)
        if extra:
            raise ValueError(f"{table}: unknown columns {sorted(extra)}")

    def signature_changed(self, dataset: str, columns: list[str]) -> tuple[bool, str | None]:
        """Compares and records the columns of a dataset; the first time is no change."""
        now = ",".join(sorted(columns))
        seen = self.read("schema_watch").filter(F.col("dataset") == dataset).orderBy(F.desc("last_checked")).limit(1).collect()
        before = seen[0].column_signature if seen else None
        row = self.spark.createDataFrame([(dataset, now)], "dataset string, column_signature string")
        self._write(row.withColumn("last_checked", F.current_timestamp()), "schema_watch", "append")
        return before is not None and before != now, before

    def log(self, table: str, **values) -> None:
        stamp = next(n for n in ("run_at", "created_at") if n in self.schema(table).names)
        rows = self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {self.schema(table)[k].dataType.simpleString()}" for k in values))
        rows = rows.withColumn(stamp, F.current_timestamp())
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(table) if f.name not in rows.columns]
        self._write(rows.select("*", *missing).select(*self.schema(table).names), table, "append")

    def newest(self, table: str, limit: int = 200) -> DataFrame:
        stamp = next(n for n in ("run_at", "created_at") if n in self.schema(table).names)
        return self.read(table).orderBy(F.desc(stamp)).limit(limit)

    def resume_date(self, table: str, default: str, date_col: str = "report_date", back_days: int = -1):
        """Where an incremental fetch goes on: ``back_days`` before the newest date (−1: the day after)."""
        newest = self.read(table).agg(F.date_sub(F.max(date_col), back_days)).first()[0]
        return str(newest or default)


def migrate(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as NULL."""
    return reduce(lambda d, c: d if c[0] in d.columns else d.withColumn(c[0], F.lit(None).cast(c[1])), columns.items(), rows)


# -- exports -----------------------------------------------------------------------


def export(rows: DataFrame, path: str, kind: str, single: bool = False) -> None:
    """csv, json, parquet or xlsx; csv and json are folders unless ``single``, xlsx is one file with one sheet."""
    if kind == "xlsx" or (single and kind in single_file.KINDS):
        single_file.write(rows, path, kind)
    elif kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        rows.write.mode("overwrite").json(path, ignoreNullFields=False)
    elif kind == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown export {kind!r}")
