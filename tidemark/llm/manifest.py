"""Merkle manifest of a dataset, by superblock reduction.

Every row is a leaf: the SHA-256 of its fields.  The leaves of a tree (a language)
stand in order of an id; two consecutive nodes become one until one is left, the
subroot, and the subroots become the root in the same way.  Neither a tree nor a level
is ever in one task: leaves get their places from a distributed sort, places are
bucketed by ``2**LEVELS``, each bucket is collapsed ``LEVELS`` levels in one group of
bounded size, and bucket roots are nodes that are reduced again.  On the way down each
bucket gets the proof of its own root and puts its inner siblings before it.

Defined results: null fields are ``-``, so null and empty texts differ; a null tree comes
first and is one of its own; rows with equal ids (null ids first) stand in order of
their leaves, and equal rows are leaves each; a long text is hashed on the JVM and goes
no further; an empty table has no rows.  Columns besides the fields are only kept if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut_lineage, with_fields

#: Levels that one group collapses: it has at most ``2**LEVELS`` nodes.
LEVELS = 10
NODE = "__tree string, __i long, __n long, __digest string"


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each its byte count, a colon and its value, or ``-`` where null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _halve(digests: list[str]) -> list[str]:
    return [_h("".join(digests[j : j + 2])) for j in range(0, len(digests), 2)]


def _height(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


# -- places ----------------------------------------------------------------------


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds the place ``__i`` of each row in its ``__tree`` (a string, not null) and the tree's size ``__n``.

    One range partitioning over all trees; a partition counts its rows of each tree as they
    stream by, and sums of those counts (a row per tree and partition) give where it starts.
    """
    keys = ["__tree", *order, "__row"]
    dealt = nodes.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys]).drop("__row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for tree in batch.column("__tree").to_pylist():
                if tree != last:
                    last, seen = tree, 0
                local.append(seen)
                seen += 1
            columns = [*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__part", "__local"])

    schema = with_fields(dealt.schema, __part="int", __local="long")
    rows = cut_lineage(dealt.mapInArrow(number, schema))
    counts = rows.groupBy("__tree", "__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.expr("sum(__rows) OVER (PARTITION BY __tree ORDER BY __part) - __rows")
    starts = counts.select("__tree", "__part", before.alias("__start"), F.expr("sum(__rows) OVER (PARTITION BY __tree)").alias("__n"))
    return rows.join(starts, ["__tree", "__part"]).withColumn("__i", F.col("__start") + F.col("__local")).drop("__part", "__local", "__start")


# -- up and down -----------------------------------------------------------------


def _collapse(levels: int):
    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__i")
        tree, place, n = rows["__tree"].iloc[0], int(rows["__i"].iloc[0]), int(rows["__n"].iloc[0])
        digests, up = list(rows["__digest"]), min(levels, _height(n))
        for _ in range(up):
            digests = _halve(digests)
        return pd.DataFrame({"__tree": [tree], "__i": [place >> levels], "__n": [-(-n >> up)], "__digest": digests})

    return collapse


def reduced(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes, their buckets' roots, those roots' buckets' roots and so on; the last has one node a tree."""
    most = nodes.agg(F.max("__n")).first()[0] or 1
    chain = [nodes]
    for _ in range(max(1, -(-_height(most) // levels))):
        below = chain[-1].select("__tree", "__i", "__n", "__digest")
        chain.append(cut_lineage(below.groupBy("__tree", F.shiftright("__i", levels)).applyInPandas(_collapse(levels), NODE)))
    return chain


def _lower(levels: int, extra: list[str]):
    def prove(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__i")
        n, start = int(rows["__n"].iloc[0]), int(rows["__i"].iloc[0])
        digests, siblings = list(rows["__digest"]), [[] for _ in range(len(rows))]
        for level in range(min(levels, _height(n))):
            for j, found in enumerate(siblings):
                other = (j >> level) ^ 1
                if other < len(digests):
                    found.append(digests[other])
            digests = _halve(digests)
        if digests[0] != above["__digest"].iloc[0] or start & ((1 << levels) - 1):
            raise ValueError("a bucket's rows are not those its root was made of")
        upper = above["__proof"].iloc[0]
        out = rows.assign(__proof=[bytes.fromhex("".join(found)) + upper for found in siblings])
        return out.assign(**{c: above[c].iloc[0] for c in extra})

    return prove


def proved(chain: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The chain's first nodes with ``__proof``: siblings' digests of 32 bytes each from below up, then ``tops``' proof.

    ``tops`` has a row per tree (``__tree``, ``__proof`` and any more columns, which go to each node).
    """
    extra = [c for c in tops.columns if c not in ("__tree", "__proof")]
    above = chain[-1].select("__tree", "__i", "__digest").join(tops, "__tree")
    for nodes in reversed(chain[:-1]):
        schema = StructType([*with_fields(nodes.schema, __proof="binary").fields, *[tops.schema[c] for c in extra]])
        left = nodes.groupBy("__tree", F.shiftright("__i", levels))
        above = left.cogroup(above.groupBy("__tree", "__i")).applyInPandas(_lower(levels, extra), schema)
    return above


# -- the operator ----------------------------------------------------------------


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: the order column, ``leaf``, ``subroot``, ``root``, ``proof`` and places.

    ``proof`` is binary, 32 bytes a sibling, from the leaf to the root; ``position`` of
    ``leaves`` and ``tree_position`` of ``trees`` tell which of them stand left (see `folded`).
    ``keep`` names further columns of the result, made from those of ``docs``.
    """
    keep = keep or {}
    key = F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    leaves = docs.select(key.alias("__tree"), F.col(order).alias("__id"), leaf(*[F.col(c) for c in fields]).alias("__digest"), *[c.alias(f"__keep_{name}") for name, c in keep.items()])
    chain = reduced(placed(leaves, ["__id", "__digest"]))
    subroots = chain[-1].select(F.lit("").alias("__tree"), F.col("__tree").alias("__name"), "__digest")
    upper = reduced(placed(subroots, ["__name"]))
    tops = proved(upper, upper[-1].select("__tree", F.lit(b"").alias("__proof"), F.col("__digest").alias("__root")))
    tops = cut_lineage(tops.select(F.col("__name").alias("__tree"), "__proof", F.col("__digest").alias("__subroot"), "__root", F.col("__i").alias("__place"), F.col("__n").alias("__trees")))
    rows = proved(chain, tops)
    return rows.select(
        F.col("__id").alias(order), F.col("__digest").alias("leaf"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), F.col("__proof").alias("proof"),
        F.col("__i").alias("position"), F.col("__n").alias("leaves"), F.col("__place").alias("tree_position"), F.col("__trees").alias("trees"),
        *[F.col(f"__keep_{name}").alias(name) for name in keep],
    )


def fold(digest: str, proof: bytes, *places: tuple[int, int]) -> str:
    """The root that a leaf and its siblings give; places: (position, nodes) of its tree, then of the tree of subroots."""
    at = 0
    for place, n in places:
        for _ in range(_height(n)):
            if place ^ 1 < n:
                other = proof[at : at + 32].hex()
                at += 32
                digest = _h(other + digest if place & 1 else digest + other)
            else:
                digest = _h(digest)
            place, n = place >> 1, (n + 1) >> 1
    return digest


def folded(rows: DataFrame, leaf_column: str) -> DataFrame:
    """Adds ``proof_sha256`` and ``folded_root``, the root recomputed from a column of leaves and the proofs of `manifest`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in ("proof", "position", "leaves", "tree_position", "trees", leaf_column)}
            seals = [_h(p.hex()) for p in of["proof"]]
            roots = [fold(d, p, (i, n), (j, m)) for d, p, i, n, j, m in zip(of[leaf_column], of["proof"], of["position"], of["leaves"], of["tree_position"], of["trees"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seals, pa.string()), pa.array(roots, pa.string())], [*batch.schema.names, "proof_sha256", "folded_root"])

    return rows.mapInArrow(add, with_fields(rows.schema, proof_sha256="string", folded_root="string"))


def tampered(docs: DataFrame) -> Column:
    """The leaf a document would have with 1 added to its ``n_chars`` where 7 divides its id's checksum; null elsewhere."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit & F.col("n_chars").isNotNull(), leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))


ORACLE = """
    WITH RECURSIVE
    docs AS (SELECT *, CAST(doc_id AS VARCHAR) AS key,
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
    leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
      sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other,
      xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(key) + 1), lambda p: CAST(ascii(key[p]) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS hit FROM docs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
    levels AS (SELECT lang, 0 AS l, list(leaf ORDER BY i) AS nodes FROM ranked GROUP BY lang
      UNION ALL SELECT lang, l + 1, list_transform(range((len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], ''))) FROM levels WHERE len(nodes) > 1),
    subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, max(l) OVER () AS most FROM levels WHERE len(nodes) = 1),
    tops AS (SELECT 0 AS l, list(subroot ORDER BY i) AS nodes FROM subs
      UNION ALL SELECT l + 1, list_transform(range((len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], ''))) FROM tops WHERE len(nodes) > 1),
    steps AS (
      SELECT r.doc_id, v.l, (r.i >> v.l) & 1 AS side, v.nodes[xor(r.i >> v.l, 1) + 1] AS sibling FROM ranked r JOIN levels v ON r.lang IS NOT DISTINCT FROM v.lang AND len(v.nodes) > 1
      UNION ALL SELECT r.doc_id, s.most + 1 + t.l, (s.i >> t.l) & 1, t.nodes[xor(s.i >> t.l, 1) + 1] FROM ranked r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON len(t.nodes) > 1),
    proofs AS (SELECT doc_id, coalesce(string_agg(sibling, '' ORDER BY l), '') AS proof,
      list(CASE WHEN sibling IS NULL THEN '-' WHEN side = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY l) AS path FROM steps GROUP BY doc_id),
    roots AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1),
    result AS (SELECT r.doc_id, r.leaf, s.subroot, o.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
      list_reduce(list_prepend(CASE WHEN r.hit THEN r.other ELSE r.leaf END, coalesce(p.path, [])),
        lambda a, s: CASE s[1] WHEN '-' THEN sha256(a) WHEN 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
      FROM ranked r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN roots o LEFT JOIN proofs p ON p.doc_id = r.doc_id)
    SELECT *, folded_root = root AS verified FROM result"""
