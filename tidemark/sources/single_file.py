"""One file out of many tasks: csv, json (a line per row) or xlsx (one sheet).

    register(spark)
    rows.write.format("onefile").mode("append").option("kind", "xlsx").save(path)

Each task writes its rows to a part beside the target, in any store that
``pyarrow.fs`` knows.  The commit joins parts in order of partitions, a piece at a time, and
gives the result its name last, replacing a file that was there; a job that fails leaves
neither the file nor parts.  Rows are never gathered: the commit copies bytes.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "onefile"
KINDS = ("csv", "json", "xlsx")
#: Rows that a sheet can have, its header among them.
SHEET_ROWS = 1_048_576
PIECE = 1 << 20

# The parts of the smallest workbook that spreadsheets open.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
WORKBOOK = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
SHEET_START, SHEET_END = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>', "</sheetData></worksheet>"


def _plain(value):
    return value.isoformat() if isinstance(value, date) else value


def _csv(rows: list[list]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["" if v is None else _plain(v) for v in row] for row in rows])
    return out.getvalue()


def _cell(value) -> str:
    value = _plain(value)
    if value is None or (isinstance(value, float) and value != value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)) and str(value) not in ("inf", "-inf"):
        return f"<c><v>{value}</v></c>"
    shown = value if isinstance(value, str) else json.dumps(value, default=str)
    # characters that XML can't hold go
    shown = "".join(ch for ch in shown if ch >= " " or ch in "\t\n\r")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(shown)}</t></is></c>'


def rendered(kind: str, names: list[str], rows: list[list]) -> str:
    if kind == "csv":
        return _csv(rows)
    if kind == "json":
        return "".join(json.dumps(dict(zip(names, map(_plain, row), strict=True)), ensure_ascii=False, default=str) + "\n" for row in rows)
    return "".join(f"<row>{''.join(map(_cell, row))}</row>" for row in rows)


def _place(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, names: list[str], path: str, kind: str):
        self.names, self.path, self.kind = names, path, kind
        self.parts = f"{path}__parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _place(self.parts)
        partition = TaskContext.get().partitionId()
        path, n = f"{root}/{partition}-{uuid.uuid4().hex}", 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            for batch in iterator:
                rows = [list(row.values()) for row in batch.to_pylist()]
                out.write(rendered(self.kind, self.names, rows).encode())
                n += len(rows)
        return Part(partition, path, n)

    def commit(self, messages: list[Part | None]) -> None:
        fs, target = _place(self.path)
        root = _place(self.parts)[1]
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        try:
            if self.kind == "xlsx" and sum(m.rows for m in parts) >= SHEET_ROWS:
                raise ValueError(f"a sheet holds fewer than {SHEET_ROWS} rows")
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/joined", compression=None) as out:
                if self.kind == "xlsx":
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                        for name, text in WORKBOOK.items():
                            book.writestr(name, text)
                        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                            sheet.write((SHEET_START + rendered("xlsx", self.names, [self.names])).encode())
                            self._copy(fs, parts, sheet)
                            sheet.write(SHEET_END.encode())
                else:
                    if self.kind == "csv":
                        out.write(_csv([self.names]).encode())
                    self._copy(fs, parts, out)
            if fs.get_file_info(target).type == FileType.File:
                fs.delete_file(target)
            fs.move(f"{root}/joined", target)
        finally:
            self.abort(messages)

    @staticmethod
    def _copy(fs: FileSystem, parts: list[Part], out) -> None:
        for m in parts:
            with fs.open_input_stream(m.path, compression=None) as part:
                while piece := part.read(PIECE):
                    out.write(piece)

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = _place(self.parts)
        if fs.get_file_info(root).type == FileType.Directory:
            fs.delete_dir(root)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        kind = self.options.get("kind", "csv")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        return Writer(schema.names, self.options["path"], kind)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OneFile)


def write(rows, path: str, kind: str) -> None:
    """Writes ``rows`` as one file, in the order of their partitions."""
    register(rows.sparkSession)
    rows.write.format(NAME).mode("append").option("kind", kind).save(path)
