"""Vector code compression: product codes by partial-distance search.

A vector's components become integers and are cut into parts; each part is replaced
by the index of its nearest entry in that part's codebook.  Codebooks start from the
rows with the smallest ids and are refined by rounds of assignment and means, all in
integer arithmetic, so that results depend on neither order nor partitioning.

Search (`nearest`): dimensions go by falling variance of the codebook's entries; after the
first half of them the entry nearest so far is completed and gives a distance that is reached; each
further dimension is added only for pairs of vector and entry that are still open, and a
pair is closed once its sum strictly exceeds the best complete distance.  Ties stay open to
the end, so the smallest index wins them.

A round reads the vectors once: each task sums its own vectors by part and entry, tasks'
sums are added by Spark, and the codebooks (256 entries, however long the table)
go through the driver.

Defined results: vectors that are null, empty or hold null or non-finite components are
left out, and so are those of another length than the kept one with the smallest id.  Null
ids come last; equal ids are ordered by their vectors; every row gets its own code.
With fewer rows than entries the codebook is smaller.  Lengths that the number of parts
doesn't divide give the first parts one component more.  Components beyond 2**43 in amount
count as that.  An error beyond a long is null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, with_fields

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: The largest amount of an integer component, exact in doubles and longs.
LARGEST = 2.0**53
#: Vectors a step: their sums with all entries stay in a processor's cache.
STEP = 256
#: Distances of smaller components than this fit a long for up to 2,048 dimensions.
SMALL = 1 << 25


def integers(vectors: DataFrame, id_col: str, column: str, label: str) -> DataFrame:
    """``__id``, ``__label`` and ``__v``, the integer components, of the rows that can be coded."""
    x = F.col(column).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(label).alias("__label"), F.when(x.isNotNull() & (F.size(x) > 0) & good, whole).alias("__v"))
    return rows.where(F.col("__v").isNotNull())


def _cuts(width: int, parts: int) -> list[slice]:
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(width), parts)])
    return [slice(int(e) - len(p), int(e)) for e, p in zip(ends, np.array_split(np.arange(width), parts), strict=True)]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each point's nearest entry, the smaller index of equals."""
    if not points.shape[1]:
        return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    # a dimension is one row, so that it is read in one piece
    points, book = np.ascontiguousarray(points[:, order].T), np.ascontiguousarray(book[:, order].T)
    codes, errors = [], []
    for at in range(0, points.shape[1], STEP):
        code, error = _nearest(points[:, at : at + STEP], book)
        codes.append(code)
        errors.append(error)
    return np.concatenate(codes), np.concatenate(errors)


def _nearest(p: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width, n = book.shape
    first = max(1, width // 2)
    sums = (p[0][:, None] - book[0]) ** 2
    for j in range(1, first):
        more = p[j][:, None] - book[j]
        more *= more
        sums += more
    best = ((p - book[:, sums.argmin(axis=1)]) ** 2).sum(axis=0)
    flat = np.flatnonzero(sums <= best[:, None])
    rows, entries, open_sums = flat // n, flat % n, sums.ravel()[flat]
    for j in range(first, width):
        more = p[j][rows] - book[j][entries]
        open_sums = open_sums + more * more
        if j == (first + width) // 2:  # the nearest by now is completed as well
            _, at = _least(rows, open_sums)
            best = np.minimum(best, ((p - book[:, entries[at]]) ** 2).sum(axis=0))
        stay = open_sums <= best[rows]
        rows, entries, open_sums = rows[stay], entries[stay], open_sums[stay]
    least, at = _least(rows, open_sums)
    return entries[at], least


def _least(rows: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (ascending, none without an entry) the smallest sum and where it first stands."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    least = np.minimum.reduceat(sums, starts)
    hits = np.flatnonzero(sums == least[rows])
    return least, hits[np.flatnonzero(np.r_[True, rows[hits][1:] != rows[hits][:-1]])]


def _matrix(column: pa.Array, large: bool) -> np.ndarray:
    """The vectors of a batch; Python's integers where products could leave a long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = flat.reshape(len(column), -1)
    return out.astype(object) if large or np.abs(out).max(initial=0) >= SMALL else out


def _large(books: list[np.ndarray]) -> bool:
    return any(int(np.abs(b).max(initial=0)) >= SMALL for b in books)


def _assigned(column: pa.Array, books: list[np.ndarray], cuts: list[slice]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its points, their entries and squared distances."""
    points = _matrix(column, _large(books))
    for cut, book in zip(cuts, books, strict=True):
        own = points[:, cut]
        yield own, *nearest(own, book.astype(own.dtype))


def _sums(books: list[np.ndarray], cuts: list[slice]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for part, (own, codes, _) in enumerate(_assigned(batch.column("__v"), books, cuts)):
                more = np.zeros(books[part].shape, dtype=own.dtype)
                np.add.at(more, codes, own)
                sums[part] += more.astype(object)
                counts[part] += np.bincount(codes.astype(np.int64), minlength=len(books[part]))
        used = [(part, e) for part, c in enumerate(counts) for e in np.flatnonzero(c)]
        kind = pa.list_(pa.decimal128(38, 0))
        values = [[Decimal(int(s)) for s in sums[part][e]] for part, e in used]
        columns = [pa.array([p for p, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()), pa.array([int(counts[p][e]) for p, e in used], pa.int64()), pa.array(values, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return add


def refine(vectors: DataFrame, books: list[np.ndarray], cuts: list[slice]) -> list[np.ndarray]:
    """One round: each entry becomes the componentwise floor of its vectors' mean; unused ones stay."""
    rows = vectors.mapInArrow(_sums(books, cuts), "part int, entry int, n long, sums array<decimal(38,0)>")
    widest = max(b.shape[1] for b in books)
    totals = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(widest)]).alias("sums"))
    new = [b.copy() for b in books]
    for r in totals.collect():  # a row per part and entry
        new[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"][: books[r["part"]].shape[1]]]
    return new


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[slice]]:
    """Codebooks of the rows of `integers`, and where the parts are cut; none for an empty table."""
    first = [r["__v"] for r in vectors.orderBy(F.col("__id").asc_nulls_last(), "__v").select("__v").limit(entries).collect()]
    if not first:
        return [], []
    width = len(first[0])
    fit = vectors.where(F.size("__v") == width)
    if any(len(v) != width for v in first):
        first = [r["__v"] for r in fit.orderBy(F.col("__id").asc_nulls_last(), "__v").select("__v").limit(entries).collect()]
    cuts = _cuts(width, parts)
    start = np.array(first, dtype=np.int64)
    books = [start[:, cut] for cut in cuts]
    for _ in range(rounds):
        books = refine(fit, books, cuts)
    return books, cuts


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], cuts: list[slice]) -> DataFrame:
    """``__id``, ``__label``, ``code`` (two hex digits a part) and ``error`` of the rows of `integers`."""
    schema = with_fields(vectors.select("__id", "__label").schema, code="string", error="long")
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = [], 0
            for _, code, distance in _assigned(batch.column("__v"), books, cuts):
                codes.append(code)
                error = error + distance
            texts = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8).tolist()]
            fits = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), pa.array(texts, pa.string()), pa.array(fits, pa.int64())], ["__id", "__label", "code", "error"])

    width = sum(b.shape[1] for b in books)
    return vectors.where(F.size("__v") == width).mapInArrow(add, schema)


def decode(code: str, books: list[np.ndarray]) -> list[int]:
    """The integer components that a code stands for."""
    return [int(x) for part, b in zip(bytes.fromhex(code), books, strict=True) for x in b[part]]


def compress(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Codes, errors, errors by label and the codebooks' digest of all rows that can be coded.

    The join back is on the label; of few labels the sums are small and Spark broadcasts
    them, of many it splits a hot one.
    """
    rows = integers(vectors, id_col, column, label)
    books, cuts = train(rows)
    coded = cut_lineage(encode(rows, books, cuts))
    total = coded.groupBy(F.col("__label").alias("__of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(total, F.col("__label").eqNullSafe(F.col("__of")), "left")
    return joined.select(F.col("__id").alias(id_col), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Codebooks round by round, every distance computed."""
    parts = """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
      book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)"""
    ctes = [parts]
    for r in range(ROUNDS + 1):
        ctes.append(
            f"""near{r} AS MATERIALIZED (SELECT vec_id, label, p, x, min({{'d': CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT), 'e': e}}) AS m
              FROM parts JOIN book{r} USING (p) GROUP BY vec_id, label, p, x)"""
        )
        if r < ROUNDS:
            ctes.append(
                f"""mean{r} AS (SELECT p, e, list(s ORDER BY j) AS c FROM (SELECT p, m.e AS e, j, floor(sum(x[j]) / count(*)) AS s FROM near{r}, range(1, 17) t(j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
              book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} n USING (p, e))"""
            )
    return f"""WITH {", ".join(ctes)},
      coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY 1, 2),
      seal AS (SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{ROUNDS}, range(1, 17) t(j))
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, seal"""


#: For vectors of 64 components.
ORACLE = _oracle()
