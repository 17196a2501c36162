"""SimHash near-deduplication by multi-index hashing.

A fingerprint is cut into two halves.  Two fingerprints that differ in at most
three bits differ in at most one bit in one of the halves, so each fingerprint
looks up the Hamming ball of radius one around each of its halves in a table
keyed by (half, value), and the whole distance is verified on what is found.
Only bits that are zero are flipped: of two halves that differ in one bit,
exactly one finds the other that way, and every link is found all the same.

Distinct fingerprints are linked, not documents, so copies cost nothing here.
Components come from alternating large-star and small-star steps.

``drop_similar`` decides by the shingles themselves.  Its candidates are the components
of fingerprints within three bits and, as these miss most pairs of edited texts, rows that
share a band of minima besides.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; a null doc_id is never a component's name unless all of them are
null; rows that repeat a doc_id are judged each by their text; ids may be of any
type that has an order; texts of any length are read whole, a row at a time;
columns of the input other than the two named ones are not read and can't clash; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_of

#: Words of a shingle, seed of the hash, most differing bits.
SHINGLE = 3
SEED = 42
DISTANCE = 3
HALVES = ((32, "hi"), (0, "lo"))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; ``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(p), SEED) for p in parts), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        block = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def word_set_fingerprint(text: str) -> int:
    """Fingerprint over the distinct words: an edited word moves one of them, but several shingles."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(words)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int | None = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (``fp``, the 64 bits as a signed long); without a shingle size over word sets."""
    of = word_set_fingerprint if shingle is None else lambda text: fingerprint(text, shingle)

    def run(batches):
        for batch in batches:
            found = np.array([of(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within DISTANCE bits, from a column ``fp`` without repeats."""
    flips = F.array(*[F.lit(m) for m in (0, *(1 << k for k in range(32)))])
    found = None
    for number, (shift, _) in enumerate(HALVES):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))
        halves = fps.select("fp", value.alias("value"))
        probes = halves.select(
            F.col("fp").alias("a"),
            F.explode(F.filter(flips, lambda m: F.col("value").bitwiseAND(m) == 0)).alias("flip"),
            "value",
        ).select("a", (F.col("flip") == 0).alias("same"), F.col("value").bitwiseOR(F.col("flip")).alias("value"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
        pairs = probes.join(halves.withColumnRenamed("fp", "b"), "value").filter(
            near & (~F.col("same") | (F.col("a") < F.col("b")))
        )
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in ``pairs`` (a, b), root the component's smallest node."""
    edges = cut_lineage(pairs.select(F.col("a").alias("lo"), F.col("b").alias("hi")))
    state = None
    while True:
        both = edges.union(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.first("lo")).alias("root"))
        large = both.join(least, "lo").filter("hi > lo").select(F.col("root").alias("lo"), "hi").distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(smallest, "hi").select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("root").alias("lo"))
        edges = cut_lineage(small.filter("hi > lo").select("lo", "hi").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo"), F.col("lo")).distinct()
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int | None = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = distinct.join(components(links(distinct)), distinct.fp == F.col("node"), "left")
    rooted = joined.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int | None = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, one with its smallest doc_id.

    Of rows of a component that share that doc_id one stays, chosen by a hash of the text; rows of
    other components that share it are left alone.
    """
    # numbered, so that a row of ``docs`` meets its own fingerprint again
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("mark"), F.col("__row").alias("row"))
    prints = near_groups(rows.select(key.alias("key"), text_of(text_col).alias("text")), "key", "text", shingle)
    stay = prints.filter(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: What makes two texts near copies: words of a shingle and least share of common shingles.
NEAR_SHINGLE = 5
NEAR_SHARE = 0.8
#: Minima of a text's hashed shingles: ``BANDS`` bands of ``BAND`` minima each.  Two texts that share
#: 0.8 of their shingles miss each other in all bands with a chance of 1 in 20,000.
BANDS = 25
BAND = 5
#: Four bits of each minimum, as planes of two longs; pairs in which more minima differ are no
#: candidates (for texts that share 0.8 of their shingles a chance of 1 in 10,000).
PLANES = 4
MOST_DIFFERENT = 40
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int = NEAR_SHINGLE) -> set[tuple[bytes, ...]]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def alike(a: set, b: set, share: float = NEAR_SHARE) -> bool:
    """Whether two sets of shingles have at least ``share`` of all in common; texts without words are equal."""
    both = len(a & b)
    return both >= share * max(1, len(a) + len(b) - both) or not (a or b)


def minima(text: str, size: int = NEAR_SHINGLE) -> np.ndarray:
    """The least values of a text's shingles under ``BANDS * BAND`` hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    least = np.full(len(_ODD), (1 << 64) - 1 if words else 0, dtype=np.uint64)
    if not words:
        return least
    one = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - size + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(0, n, 2048):
        least = np.minimum(least, (mixed[k : k + 2048, None] * _ODD).min(axis=0))
    return least


def _sketch(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's band keys, and the planes of its minima's upper bits."""
    least = minima(text, size)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND))]
    bits = np.zeros((PLANES, 128), dtype=np.uint8)
    spread = least * np.uint64(0x9E3779B97F4A7C15)
    for k in range(PLANES):
        bits[k, : len(least)] = (spread >> np.uint64(60 + k)) & np.uint64(1)
    return np.array(keys, dtype=np.uint64).view(np.int64), np.packbits(bits, axis=1).reshape(-1).view(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, share: float, size: int) -> DataFrame:
    """Those of the pairs (a, b) of rows whose texts are alike, compared shingle by shingle."""

    def run(batches):
        last, mine = None, set()
        for batch in batches:
            near = []
            for one, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if one != last:
                    last, mine = one, shingles(one, size)
                near.append(alike(mine, shingles(text, size), share))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    kind = pairs.select("a", "b").schema
    both = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("other")), "b")
    both = both.join(texts.select(F.col("row").alias("a"), F.col("text").alias("one")), "a")
    return cut_lineage(both.select("a", "b", "one", "other").mapInArrow(run, kind))


def similar_rows(rows: DataFrame, share: float = NEAR_SHARE, size: int = NEAR_SHINGLE) -> DataFrame:
    """The rows (``row``) that go: each shares at least ``share`` of its shingles with a row that stays.

    Rows of a component of fingerprints and rows of a band are candidates, in the order of
    how many others they meet and then of ``row``; a component counts as one more band.  A row that is the first in all its bands stays, and only it is compared with the rest of them: that settles large
    groups in linear work.  Rows left over are compared in pairs within their
    bands, and settled in order along the pairs that are alike.
    """

    def run(batches):
        for batch in batches:
            got = [_sketch(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                schema=pa.schema([("row", batch.schema.field(0).type), ("keys", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))]),
            )

    kind = rows.schema["row"].dataType.simpleString()
    sketched = cut_lineage(rows.select("row", "text").mapInArrow(run, f"row {kind}, keys array<long>, planes array<long>"))
    linked = near_groups(rows, "row", "text").select(F.col("doc_id").alias("row"), F.xxhash64("component_id").alias("key"))
    keyed = sketched.select("row", F.explode("keys").alias("key")).unionByName(linked)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    meets = cut_lineage(keyed.join(shared, "key"))
    # rows that meet many others come first: the text that a group was edited from settles the group
    ranks = cut_lineage(meets.groupBy("row").agg(F.struct((-F.sum("rows")).alias("met"), F.col("row").alias("row")).alias("rank")))
    named = lambda df: df.join(ranks, "row").drop("row").withColumnRenamed("rank", "row")
    texts, sketched = cut_lineage(named(rows.select("row", "text"))), named(sketched.select("row", "planes"))
    members = cut_lineage(named(meets.select("row", "key")))
    bands = cut_lineage(members.join(members.groupBy("key").agg(F.min("row").alias("least")), "key"))

    later = bands.filter("row <> least").select("row").distinct()
    pairs = bands.filter("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b")).distinct()
    pairs = pairs.join(later.withColumnRenamed("row", "a"), "a", "left_anti")
    gone = _verified(pairs, texts, share, size).select(F.col("b").alias("row")).distinct()

    # the first rows of all their bands are done: they have met all others there
    left = later.join(gone, "row", "left_anti").join(sketched, "row")
    left = cut_lineage(bands.select("row", "key").join(left, "row"))
    a, b = (left.select("key", F.col("row").alias(n), F.col("planes").alias(f"{n}s")) for n in "ab")
    differs = lambda word: F.bit_count(F.expr(" | ".join(f"(as[{2 * k + word}] ^ bs[{2 * k + word}])" for k in range(PLANES))))
    pairs = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (differs(0) + differs(1) <= MOST_DIFFERENT))
    edges = _verified(pairs.select("a", "b").distinct(), texts, share, size)
    while not edges.isEmpty():
        # a row without a smaller one alike stays; what is alike to it goes
        waits = edges.select(F.col("b").alias("a")).distinct()
        now = cut_lineage(edges.join(waits, "a", "left_anti").select("b").distinct())
        gone = gone.union(now)
        edges = cut_lineage(edges.join(now, "b", "left_anti").join(now.withColumnRenamed("b", "a"), "a", "left_anti"))
    return gone.select("row.row")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = NEAR_SHARE, size: int = NEAR_SHINGLE) -> DataFrame:
    """The rows of ``docs`` but those whose text shares at least ``share`` of its shingles with one that stays.

    Of two rows alike the one that meets more others stays, then that with the
    smaller doc_id.  Rows alike in all keep one; texts
    without words are equal.
    """
    known = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    # 128 bits, so that different rows aren't taken for one however many there are
    key = F.unhex(F.md5(F.concat(F.octet_length(known).cast("string"), known, text_of(text_col)).cast("binary")))
    rows = docs.withColumn("__node", key)
    none = F.lit("0").cast(docs.schema[id_col].dataType)
    row = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), none).alias("id"), F.col("__node").alias("node"))
    gone = similar_rows(rows.select(row.alias("row"), text_of(text_col).alias("text")), share, size)
    stay = rows.join(gone.select(F.col("row.node").alias("__node")), "__node", "left_anti")
    nth = F.row_number().over(Window.partitionBy("__node").orderBy(F.lit(0)))
    return stay.withColumn("__nth", nth).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
