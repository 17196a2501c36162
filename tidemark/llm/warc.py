"""WARC archives with a two-level capture index.

*Writing.* Tasks stream their rows into archive files, each record a gzip member of its
own, and return a row per record: its key, file, offset and length.  Those rows, kept by
a checkpoint, are what says which files count: a lost task writes a new file, and one
that no row names is left over.  Of equal payloads of at least ``LEAST`` bytes one is
written in full, the others as revisits that name it; which one is known before any
payload is moved, from digests alone.

*Index.* Captures are range-sorted by their URL's key, host labels reversed.  Each range is
one index file: blocks of ``BLOCK`` compressed entries and, at its end, a sparse directory
with each block's first key.  A lookup binary-searches the ranges' bounds (a row per
index file), then a directory, then reads and binary-searches the blocks that can
hold the key.  A key with very many captures has many blocks; they go to tasks one by one.

*Reading.* Record ranges are sorted by file and offset, neighbours are read at once, and
each payload's digest is checked.  Revisits get their payload's size from the record they name.

Files are reached by ``pyarrow.fs``, so the folder may be in any store it knows; all
tasks must see it.

Defined results: a null payload is empty; null ids come last where the smallest decides and
stay null; a null URL has the empty key; of rows alike in id, URL and payload one is the
response; control characters and spaces in a URL are percent-encoded in its record; a
key longer than ``LONGEST`` is cut and ends with its digest; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, checkpoint_folder, cut_lineage

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes after which a task starts a new archive file.
FILE_BYTES = 1 << 30
#: Effort of the records' compression, of 9.
LEVEL = 6
#: Entries in a block of the index.
BLOCK = 1000
#: Characters of a key beyond which it ends with a digest.
LONGEST = 1024
#: Bytes read at once where records are neighbours.
READ_BYTES = 8 << 20
CAPTURE = "key string, file string, start long, length long"
CAPTURE_NAMES = ["key", "file", "start", "length"]


def url_key(url: Column) -> Column:
    """Host labels reversed, ``)``, then path and query; without ``://`` the url after ``)``; null: empty."""
    parts = r"^[^:/?#]+://([^/?#]*)([^#]*)"
    host = F.translate(F.regexp_replace(F.regexp_extract(url, parts, 1), r"^.*@", ""), UPPER, UPPER.lower())
    turned = F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")), ","), F.regexp_extract(host, r":[0-9]*$", 0))
    key = F.when(url.rlike(parts), F.concat(turned, F.lit(")"), F.regexp_extract(url, parts, 2))).otherwise(F.concat(F.lit(")"), url))
    cut = F.when(F.length(key) > LONGEST, F.concat(F.substring(key, 1, LONGEST - 65), F.lit("~"), F.sha2(key, 256))).otherwise(key)
    return F.coalesce(cut, F.lit(""))


# -- records ---------------------------------------------------------------------


def record_id(seed: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(seed.encode()).hexdigest()[:32])}>"


def render(headers: dict[str, str | None], payload: bytes) -> bytes:
    """A record: version, header lines, an empty line, the payload and two line ends."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items() if v is not None], f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:size]


def _shown(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _place(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else FileSystem.from_uri(f"file://{uri}")


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = {"size": pa.int64(), "start": pa.int64(), "length": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(columns, names, strict=True)], names)


# -- writing ---------------------------------------------------------------------


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        fs, root = _place(folder)
        try:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    first = row["first"]
                    headers = {
                        "WARC-Type": "response" if first is not None else "revisit",
                        "WARC-Record-ID": record_id(row["digest"] if first else f"{name} {at}"),
                        "WARC-Target-URI": _shown(row["url"]),
                        "WARC-Payload-Digest": f"sha256:{row['digest']}",
                        "WARC-Refers-To": record_id(row["digest"]) if first is None else None,
                        "X-Capture-Id": json.dumps(row["id"]),
                    }
                    data = gzip.compress(render(headers, row["payload"] or b""), LEVEL, mtime=0)
                    out.write(data)
                    found.append((row["key"], name, at, len(data)))
                    at += len(data)
                yield _batch(found, CAPTURE_NAMES)
        finally:
            if out is not None:
                out.close()

    return write


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row into ``folder``/archive; returns key, file, start and length of each.

    Only groups of copies are looked up by the rows with payloads; where they are few Spark
    broadcasts them, so that payloads aren't shuffled at all.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.make_valid_utf8(F.col(url_col).cast("string")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    same = rows.where(F.col("size") >= LEAST).groupBy("digest", "page", "url").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page").isNull(), "page", F.col("url").isNull(), "url", "n")
    groups = same.groupBy("digest").agg(F.sum("n").alias("copies"), F.min(order).alias("least")).where("copies > 1")
    at = f"{folder}/groups-{uuid.uuid4().hex}"
    groups.select("digest", F.col("least.page").alias("page1"), F.col("least.url").alias("url1"), F.col("least.n").alias("n1")).write.parquet(at)
    groups = spark.read.parquet(at)
    joined = rows.join(groups.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    chosen = F.col("page").eqNullSafe(F.col("page1")) & F.col("url").eqNullSafe(F.col("url1"))
    # first: true for a response that others may refer to, false for one alone, null for a revisit
    first = F.when(F.col("of").isNull(), F.col("size") >= LEAST).when(chosen, F.lit(True))
    joined = joined.select("page", "url", "payload", "digest", "n1", first.alias("first"))
    alike = groups.where("n1 > 1").limit(1).count() > 0
    if alike:  # several rows alike in all are the chosen ones: one of them is written in full
        twins = F.coalesce(F.col("first") & (F.col("n1") > 1), F.lit(False))
        whole = joined.where(twins).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("page", "url", "payload", "n1")])
        rest = whole.select("page", "url", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n1") - 2) / 4096))).alias("k"), "n1")
        rest = rest.select("page", "url", F.lit(None).cast("binary").alias("payload"), "digest", F.explode(F.sequence(F.col("k") * 4096, F.least((F.col("k") + 1) * 4096, F.col("n1") - 1) - 1)), F.lit(None).cast("boolean").alias("first"))
        full = whole.select("page", "url", "payload", "digest", F.lit(True).alias("first"))
        joined = joined.where(~twins).drop("n1").unionByName(full).unionByName(rest.drop("col"))
    kept = F.when(F.col("first").isNotNull(), F.col("payload")).alias("payload")
    rows = joined.select(url_key(F.col("url")).alias("key"), F.col("page").cast("string").alias("id"), "url", kept, "digest", "first")
    return cut_lineage(rows.mapInArrow(_writer(f"{folder}/archive"), CAPTURE))


# -- index -----------------------------------------------------------------------


def _indexer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, at, out, last = TaskContext.get().partitionId(), [], 0, None, None
        fs, root = _place(folder)
        name = f"index-{part:05d}-{uuid.uuid4().hex}"
        pending: list[list] = []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, pending)).encode())
            out.write(data)
            blocks.append([pending[0][0], at, len(data)])
            at += len(data)
            pending.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for row in batch.to_pylist():
                pending.append([row["key"], row["file"], row["start"], row["length"]])
                last = row["key"]
                if len(pending) == BLOCK:
                    flush()
        if out is None:
            return
        if pending:
            flush()
        directory = zlib.compress(json.dumps(blocks).encode())
        out.write(directory + len(directory).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([blocks[0][0]]), pa.array([last]), pa.array([name])], ["first", "last", "index"])

    return write


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Writes the index files of the captures; returns first key, last key and name of each, in order.

    That is a row per range partition, however many captures there are.
    """
    keys = ["key", "file", "start"]
    dealt = captures.repartitionByRange(*keys).sortWithinPartitions(*keys)
    shards = cut_lineage(dealt.mapInArrow(_indexer(f"{folder}/index"), "first string, last string, index string"))
    return sorted((r["first"], r["last"], r["index"]) for r in shards.collect())


def _directory(fs: FileSystem, path: str) -> list[list]:
    """First key, offset and length of each block, from an index file's end."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n = int.from_bytes(f.read_at(8, size - 8), "little")
        return json.loads(zlib.decompress(f.read_at(n, size - 8 - n)))


def _finder(folder: str, shards: list[tuple[str, str, str]]):
    """Blocks that can hold a key."""
    firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        name, blocks, starts = None, [], []
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                for shard in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    if shards[shard][2] != name:
                        name = shards[shard][2]
                        blocks = _directory(fs, f"{root}/{name}")
                        starts = [b[0] for b in blocks]
                    low = max(0, bisect.bisect_left(starts, key) - 1)
                    out += [(key, name, b[1], b[2]) for b in blocks[low : bisect.bisect_right(starts, key)]]
            yield _batch(out, CAPTURE_NAMES)

    return find


def _picker(folder: str):
    """Captures of a key in a block."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        at, entries, keys = None, [], []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["file"], row["start"]) != at:
                    at = (row["file"], row["start"])
                    with fs.open_input_file(f"{root}/{row['file']}") as f:
                        entries = [json.loads(x) for x in zlib.decompress(f.read_at(row["length"], row["start"])).split(b"\n")]
                    keys = [e[0] for e in entries]
                out += entries[bisect.bisect_left(keys, row["key"]) : bisect.bisect_right(keys, row["key"])]
            yield _batch(out, CAPTURE_NAMES)

    return pick


def lookup(urls: DataFrame, folder: str, shards: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """Every capture of every distinct key among ``urls``: key, file, start and length."""
    keys = urls.select(url_key(F.make_valid_utf8(F.col(url_col).cast("string"))).alias("key")).distinct()
    keys = keys.repartitionByRange("key").sortWithinPartitions("key")
    blocks = keys.mapInArrow(_finder(f"{folder}/index", shards), CAPTURE)
    blocks = blocks.repartitionByRange("file", "start", "key").sortWithinPartitions("file", "start", "key")
    return blocks.mapInArrow(_picker(f"{folder}/index"), CAPTURE)


# -- reading ---------------------------------------------------------------------

RECORD = "record_id string, kind string, id string, url string, refers string, digest string, size long"


def _reader(folder: str, with_payload: bool):
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("file", "start", "length")], strict=True))
            at, out, held = 0, [], 0
            while at < len(rows):
                end, stop = at + 1, rows[at][1] + rows[at][2]
                while end < len(rows) and rows[end][0] == rows[at][0] and rows[end][1] == stop and stop + rows[end][2] - rows[at][1] <= READ_BYTES:
                    stop += rows[end][2]
                    end += 1
                if rows[at][0] != name:
                    if source is not None:
                        source.close()
                    name = rows[at][0]
                    source = fs.open_input_file(f"{root}/{name}")
                data = source.read_at(stop - rows[at][1], rows[at][1])
                for _, start, length in rows[at:end]:
                    low = start - rows[at][1]
                    headers, payload = parse(gzip.decompress(data[low : low + length]))
                    digest, whole = hashlib.sha256(payload).hexdigest(), headers["WARC-Type"] == "response"
                    told = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if whole and told != digest:
                        raise ValueError(f"{name} at {start}: payload and digest differ")
                    out.append((headers["WARC-Record-ID"], headers["WARC-Type"], json.loads(headers["X-Capture-Id"]), headers.get("WARC-Target-URI"), headers.get("WARC-Refers-To"), told, len(payload) if whole else None, *[payload] * with_payload))
                    held += len(payload) * with_payload
                    if held > READ_BYTES:
                        yield _batch(out, names)
                        out, held = [], 0
                at = end
            yield _batch(out, names)

    return read


def fetch(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at the captures' ranges; a revisit has neither size nor payload of its own."""
    # a capture is some bytes, its record thousands: partitions that look small aren't joined
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")
    return dealt.mapInArrow(_reader(f"{folder}/archive", with_payload), RECORD + ", payload binary" * with_payload)


def resolved(records: DataFrame) -> DataFrame:
    """Every record with the size of its full payload and the id of the capture it revisits."""
    records = cut_lineage(records)
    named = records.where(F.col("refers").isNotNull()).select("refers").distinct()
    named = named.join(records.where("kind = 'response'").select("record_id", F.col("id").alias("refers_to"), F.col("size").alias("full")), F.col("refers") == F.col("record_id")).drop("record_id")
    out = records.join(named, "refers", "left")
    return out.select("id", "url", "kind", "digest", F.coalesce("size", "full").alias("size"), "refers_to")


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all pages, indexes them, looks every URL up and reads what is found: a row per page."""
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archive(pages, folder, id_col, url_col, payload_col)
    shards = build_index(captures, folder)
    records = resolved(fetch(lookup(pages, folder, shards, url_col), folder))
    kind = pages.schema[id_col].dataType
    return records.select(
        F.col("id").cast(kind).alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLE = """
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least_id THEN least_id END AS refers_to
    FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
      CASE WHEN strlen(coalesce(html, '')) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS least_id FROM pages)"""
