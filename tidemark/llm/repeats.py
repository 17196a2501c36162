"""Removal of long repeated passages with a run-length (r-)index.

Sharding.  Every window of ``length`` bytes picks an anchor: the smallest of the
hashes of its ``gram``-byte strings.  Equal windows pick equal anchors, so all
occurrences of a window meet under one key, whatever documents they are in.
Runs of window starts with one key are shipped as one region by its digest
(``DIGEST`` bits of BLAKE2b, so that equal digests are equal bytes) alone.  A map task ships
two of each kind; what equals these two in its own rows is repeated all over
and goes no further.  Keys with one region have no match, and only for the rest the
bytes of each kind are fetched, once.

Index.  The kinds of some keys form one text.  Its suffixes are sorted once, to get the
Burrows-Wheeler transform as runs, each with its symbol, its first row, where its rows
lead one step to the left, and how often it stands in the whole collection, copies
included: copies lengthen runs and add none.  At both ends of a run a sample tells how
far the suffix there agrees with its neighbour in the other run.  Then the sorted
suffixes are dropped.  Matching statistics are streamed from the runs: every kind is
followed from its end by backward steps, all at once, until its start; where a step
meets an end of a run, the sample gives the statistic there, and to the right of
it the statistic falls by one a byte, for between two samples nothing else can change
it.  The start of a kind that stands twice agrees with its copy to the end.
A statistic of at least ``length`` marks its bytes, in all regions of the kind.

Hot keys.  A key whose different regions have many bytes is anchored again with
longer strings, which splits it; with strings as long as the window all regions of a key
are alike.  Every level is exact, nothing is capped.

Defined results: null text is empty; texts shorter than ``length`` are left as
they are; equal rows repeat each other; a null doc_id is told apart from others
by its text; ids that aren't whole numbers are told apart by hash; very long texts
are hashed and cut in slices; columns of the input other than the two named ones
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_number, text_of

LENGTH = 400
#: Anchor lengths by level, as shares of the window; the last is the window.
LEVELS = (0.4, 0.7, 0.85, 0.925, 0.97, 1.0)
#: Bytes of a key's regions beyond which it goes to the next level.
HOT = 1 << 22
#: Bits of a region's digest.
DIGEST = 128
#: Window starts that are hashed at once, and bytes that are indexed at once.
SLICE = 1 << 20
BATCH = 1 << 20
#: Bytes of regions that a task indexes.
TASK = 1 << 25
#: Kinds of regions that a map task remembers; beyond that it forgets them and ships more.
KINDS = 300_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, for the longest slice."""
    global _powers
    if _powers is None:
        size = 2 * SLICE + 1
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        up, down = (np.full(size, f, dtype=np.uint64) for f in (_FACTOR, inverse))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes of ``data``, equal for equal bytes."""
    up, down = _power_tables()
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: minima from both ends of blocks, combined."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def regions(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(text number, key, first start, number of starts, more than one anchor) of each region."""
    batch: list[tuple[int, int, memoryview]] = []
    size = 0
    for number, text in enumerate(texts):
        view = memoryview(text)
        for at in range(0, len(text) - length + 1, SLICE):
            part = view[at : at + SLICE + length - 1]
            if size + len(part) > SLICE + length and batch:
                yield from _regions(batch, length, gram)
                batch, size = [], 0
            batch.append((number, at, part))
            size += len(part)
    if batch:
        yield from _regions(batch, length, gram)


def _regions(batch: list[tuple[int, int, memoryview]], length: int, gram: int) -> Iterator[tuple[int, int, int, int, bool]]:
    data = np.frombuffer(b"".join(p for _, _, p in batch), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in batch])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key = h[anchor].view(np.int64)
    starts = sizes - length + 1  # window starts of each part
    owner = np.repeat(np.arange(len(batch)), starts)
    at = np.arange(len(owner)) + np.repeat(begin - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts)
    key, anchor = key[at], anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    several = anchor[first] != anchor[last]
    for o, k, s, n, m in zip(owner[first].tolist(), key[first].tolist(), (at[first] - begin[owner[first]]).tolist(), (last - first + 1).tolist(), several.tolist()):
        yield batch[o][0], k, batch[o][1] + s, n, m


#: d, sig: the document's row; p: first start; n: starts; several: more than one
#: anchor; copies: 1, or 2 if it is known to occur elsewhere as a whole, or 0 if two
#: equal ones of the same map task are shipped.
_REGION = "key long, hash binary, d long, sig long, p long, n long, several boolean, copies int"
_FIELDS = [f.split()[0] for f in _REGION.split(", ")]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


_TYPES = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.int32()]


def _digest(part: bytes | memoryview) -> bytes:
    return blake2b(part, digest_size=DIGEST // 8).digest()


def _document_regions(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        seen: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            d, sig = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t.as_py() for t in batch.column(2)]
            views = [memoryview(t) for t in texts]
            rows = []
            for i, key, p, n, several in regions(texts, length, gram):
                kind = key, _digest(views[i][p : p + n + length - 1])
                before = seen.get(kind, 0)
                if before < 2:
                    if len(seen) >= KINDS:
                        seen.clear()
                    seen[kind] = before + 1
                rows.append((*kind, d[i], sig[i], p, n, several, int(before < 2)))
                if len(rows) >= 20_000:
                    yield _batch(rows, _FIELDS, _TYPES)
                    rows = []
            if rows:
                yield _batch(rows, _FIELDS, _TYPES)

    return docs.select("d", "sig", F.encode("text", "UTF-8").alias("bytes")).mapInArrow(run, _REGION)


def _meet(found: DataFrame) -> DataFrame:
    """Regions that met under a key: ``covered`` ones, which equal two that are shipped, and those
    to index, for keys where there is something to compare: the first of each kind is its ``lead``."""

    def run(batches):
        out: list[tuple] = []
        now: tuple | None = None
        waiting: tuple | None = None  # the kind's first region, while it is the only one
        held: tuple | None = None  # the key's only kind, which has one region and one anchor
        kinds = 0

        def end_kind() -> None:
            """The kind had one region: it is worth indexing if the key has others, or it several anchors."""
            nonlocal waiting, held, kinds
            kinds += 1
            if waiting is not None:
                if kinds == 1 and not waiting[6]:
                    held = waiting
                else:
                    release()
                    out.append((*waiting, False, True))
                waiting = None

        def release() -> None:
            nonlocal held
            if held is not None:
                out.append((*held, False, True))
                held = None

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[7] == 0:
                    out.append((*row, True, False))
                    continue
                if row[:2] != now:
                    if now is not None:
                        end_kind()
                        if row[0] != now[0]:
                            held, kinds = None, 0
                    now, waiting = row[:2], row
                else:
                    if waiting is not None:
                        release()
                        out.append((*waiting[:7], 2, False, True))
                        waiting = None
                    out.append((*row[:7], 2, False, False))
                if len(out) >= 20_000:
                    yield _batch(out, names, types)
                    out.clear()
        if now is not None:
            end_kind()
        if out:
            yield _batch(out, names, types)

    names, types = [*_FIELDS, "covered", "lead"], [*_TYPES, pa.bool_(), pa.bool_()]
    by = F.when(F.col("copies") == 0, F.xxhash64("d", "sig", "p")).otherwise(F.col("key"))
    return found.repartition(by).sortWithinPartitions("key", "hash", "d", "sig", "p").mapInArrow(run, _REGION + ", covered boolean, lead boolean")


def _meet_again(found: DataFrame) -> DataFrame:
    """Regions with bytes that met under a longer anchor: ``covered`` ones, which occur twice as a
    whole, and those to index: one of each kind, for keys where something is left to compare."""
    names, types = [*_FIELDS, "bytes"], [*_TYPES, pa.binary()]

    def run(batches):
        out: list[tuple] = []
        pending: list[tuple] = []  # one region of each kind of the key, none handed on yet
        kinds, left = 0, False  # kinds of the key; whether one of them isn't covered as a whole

        def settle(members: list[tuple]) -> None:
            """Ends a run of equal regions."""
            nonlocal kinds, left
            one, twice = members[0], len(members) > 1 or members[0][7] > 1
            if twice:
                out.extend((*m, True) for m in members if m[7] == 1)
            kinds += 1
            left |= not twice
            pending.append((*one[:7], 2 if twice else 1, *one[8:]))
            if left and (kinds > 1 or one[6]):
                out.extend((*m, False) for m in pending)
                pending.clear()

        def send() -> pa.RecordBatch:
            done = _batch(out, [*names, "covered"], [*types, pa.bool_()])
            out.clear()
            return done

        now: tuple | None = None
        members: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != now:
                    if members:
                        settle(members)
                    if now is None or row[0] != now[0]:
                        pending.clear()
                        kinds, left = 0, False
                    now, members = row[:2], []
                if len(members) < 2:
                    members.append(row)
                elif row[7] == 1:  # a run can be long: beyond its first two, members go straight out
                    out.append((*row, True))
                if len(out) >= 20_000:
                    yield send()
        if members:
            settle(members)
        if out:
            yield send()

    schema = _REGION + ", bytes binary, covered boolean"
    return found.repartition("key").sortWithinPartitions("key", "hash", "d", "sig", "p").mapInArrow(run, schema)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some different byte strings, each with
    the number of its copies, and samples at both ends of every run."""

    def __init__(self, texts: list[bytes], copies: list[int] | None = None):
        self.copies = np.array(copies if copies is not None else [1] * len(texts), dtype=np.int64)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum([len(t) + 1 for t in texts])  # one past each terminator
        self.begins = self.ends - np.array([len(t) + 1 for t in texts])
        # UTF-8 has no byte 255, so bytes plus one fit and 0 ends a text
        self.symbols = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8) + np.uint8(1)
        self.symbols[self.ends - 1] = 0
        self.owner = np.repeat(np.arange(len(texts)), self.ends - self.begins)
        self.left = self.ends[self.owner] - np.arange(len(self.symbols))  # symbols to the end, with the terminator
        self.words = self._words()
        order = self._suffixes()
        self._runs(order)
        self.agree = self._agreements(order[self.run_starts[1:] - 1], order[self.run_starts[1:]])
        # the runs and their samples are all that statistics need
        del self.symbols, self.words, self.left, self.owner, order

    def _words(self) -> np.ndarray:
        """The eight symbols from each place on as a number, nothing beyond the terminator."""
        padded = np.concatenate([self.symbols, np.zeros(8, dtype=np.uint8)])
        n, words = len(self.symbols), np.zeros(len(self.symbols), dtype=np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | np.where(self.left > k, padded[k : n + k], 0).astype(np.uint64)
        return words

    def _suffixes(self) -> np.ndarray:
        """All suffixes in order, by doubling; suffixes that are settled take no further part.
        Equal terminators are ordered by their text's number."""
        n = len(self.symbols)
        order = np.argsort(self.words, kind="stable")
        sorted_words = self.words[order]
        new = np.ones(n, dtype=bool)
        new[1:] = sorted_words[1:] != sorted_words[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        shared = ~new
        shared[:-1] |= ~new[1:]
        slots = np.flatnonzero(shared)
        width = 8
        while len(slots):
            at = order[slots]
            ended = self.left[at] <= width
            second = np.where(ended, self.owner[at], rank[np.where(ended, at, at + width)])
            first = rank[at]
            by = np.argsort(first * np.int64(n + 1) + second, kind="stable")
            at, first, second = at[by], first[by], second[by]
            order[slots] = at
            new = np.ones(len(at), dtype=bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            shared = ~new
            shared[:-1] |= ~new[1:]
            slots = slots[shared]
            width *= 2
        return order

    def _runs(self, order: np.ndarray) -> None:
        """Symbols, first rows and numbers of occurrences of the runs, and where their first rows lead.

        Terminators are told apart, so each of them is a run of its own.
        """
        transform = self.symbols[order - 1]  # a text's first suffix has a terminator there
        edge = np.flatnonzero((transform[1:] != transform[:-1]) | (transform[1:] == 0)) + 1
        self.run_starts = np.concatenate([[0], edge])
        self.rows = len(transform)
        self.run_symbols = transform[self.run_starts]
        self.run_counts = np.add.reduceat(self.copies[self.owner[order]], self.run_starts)
        # rows that end with a symbol lead, in order, to the rows that begin with it
        lengths = np.diff(np.append(self.run_starts, self.rows))
        by = np.argsort(self.run_symbols, kind="stable")
        self.leads = np.empty(len(by), dtype=np.int64)
        self.leads[by] = np.cumsum(lengths[by]) - lengths[by]

    def _agreements(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``a`` and ``b`` have in common, before a text's end."""
        reach = np.zeros(len(a), dtype=np.int64)
        going = np.arange(len(a))
        while len(going):
            x, y = self.words[a[going] + reach[going]], self.words[b[going] + reach[going]]
            whole = (x == y) & ((x & np.uint64(255)) != 0)
            ended = going[~whole]
            x, y = x[~whole], y[~whole]
            same = np.ones(len(x), dtype=bool)
            for k in range(8):
                shift = np.uint64(56 - 8 * k)
                p, q = (x >> shift) & np.uint64(255), (y >> shift) & np.uint64(255)
                same &= (p == q) & (p != 0)
                reach[ended] += same
            going = going[whole]
            reach[going] += 8
        return reach

    def statistics(self, length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Texts, a distance from their ends, and statistics of at least ``length`` that samples give there.

        All texts take their backward steps at once, from the rows of their terminators,
        which come first and in order.
        """
        if not ((self.agree >= length).any() or (self.copies > 1).any()):
            return
        before, after = np.append(0, self.agree), np.append(self.agree, 0)  # at a run's first row, and at its last
        last = np.append(self.run_starts[1:], self.rows) - 1
        text = rows = np.arange(len(self.copies))
        step = 0
        while len(rows):
            run = np.searchsorted(self.run_starts, rows, "right") - 1
            first = self.run_starts[run]
            found = np.maximum(np.where(rows == first, before[run], 0), np.where(rows == last[run], after[run], 0))
            ended = self.run_symbols[run] == 0
            found = np.where(ended & (self.copies[text] > 1), self.sizes[text], found)
            far = found >= length
            if far.any():
                yield text[far], step, found[far]
            going = ~ended
            text, rows = text[going], (self.leads[run] + rows - first)[going]
            step += 1


def repeated_spans(texts: list[bytes], length: int = LENGTH, copies: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each text the merged spans covered by strings of ``length`` bytes that start elsewhere too.

    Texts are different; ``copies`` tells how often each stands.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not texts:
        return spans
    index = RunLengthIndex(texts, copies)
    found = [(t, index.sizes[t] - step, reach) for t, step, reach in index.statistics(length)]
    if not found:
        return spans
    owner, start, reach = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort([start, owner])
    for o, s, e in zip(owner[by].tolist(), start[by].tolist(), (start + reach)[by].tolist()):
        if spans[o] and s <= spans[o][-1][1]:
            spans[o][-1] = (spans[o][-1][0], max(e, spans[o][-1][1]))
        else:
            spans[o].append((s, e))
    return spans


def _parts(left: DataFrame) -> int:
    """Tasks for the index: sorting suffixes takes far longer than reading them, so
    small inputs are dealt to all tasks a shuffle has, and large ones by ``TASK`` bytes."""
    size = left.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    return max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))


def _indexed(found: DataFrame, length: int, parts: int, every: bool) -> DataFrame:
    """Spans (d, sig, start, stop) of regions; keys are indexed in batches.

    A kind's first row has its bytes; its other rows, without bytes, get the same spans.
    Unless ``every``, rows of kinds with copies are there for others only.
    """

    def run(batches):
        kinds: list[tuple[bytes, int, list[tuple]]] = []  # bytes, copies, regions
        size = 0

        def flush():
            rows = []
            for (_, _, regions_), spans in zip(kinds, repeated_spans([k[0] for k in kinds], length, [k[1] for k in kinds])):
                rows += [(d, sig, p + s, p + e) for d, sig, p in regions_ for s, e in spans]
            return _batch(rows, ["d", "sig", "start", "stop"], [pa.int64()] * 4) if rows else None

        last = None
        for batch in batches:
            for key, hash_, d, sig, p, copies, text in zip(*[c.to_pylist() for c in batch.columns]):
                if last is not None and key != last[0] and size >= BATCH:
                    if done := flush():
                        yield done
                    kinds, size = [], 0
                if (key, hash_) != last or text is not None:
                    kinds.append((text, copies if every else 1, []))
                    size += len(text)
                last = key, hash_
                if every or copies == 1:
                    kinds[-1][2].append((d, sig, p))
        if kinds and (done := flush()):
            yield done

    # dealt by a hash of the key: by the key itself Spark leaves the shuffle out after a join by key, and then may read
    # the join's rows where they lie, which parts a key's regions
    rows = found.select("key", "hash", "d", "sig", "p", "copies", "bytes").repartition(parts, F.xxhash64("key"))
    return rows.sortWithinPartitions("key", "hash", F.col("bytes").isNull()).mapInArrow(run, "d long, sig long, start long, stop long")


def _with_bytes(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``found`` with the bytes of its regions, cut out where the text is."""
    lists = found.groupBy("d", "sig").agg(F.collect_list(F.struct(*[f for f in _FIELDS if f not in ("d", "sig")])).alias("wanted"))
    joined = docs.join(lists.hint("shuffle_hash"), ["d", "sig"])
    cut = joined.select("d", "sig", F.encode("text", "UTF-8").alias("text"), "wanted").withColumn("w", F.explode("wanted"))
    bytes_ = F.substring(F.col("text"), F.col("w.p") + 1, F.col("w.n") + (length - 1))
    return cut.select("w.key", "w.hash", "d", "sig", "w.p", "w.n", "w.several", "w.copies", bytes_.alias("bytes"))


def _anchored_again(found: DataFrame, length: int, gram: int) -> DataFrame:
    """Regions of ``found`` split by longer anchors."""

    def run(batches):
        for batch in batches:
            rows_in = list(zip(*[c.to_pylist() for c in batch.columns]))
            texts = [r[4] for r in rows_in]
            rows = []
            for i, key, p, n, several in regions(texts, length, gram):
                d, sig, at, copies, text = rows_in[i]
                part = text[p : p + n + length - 1]
                rows.append((key, _digest(part), d, sig, at + p, n, several, copies, part))
                if len(rows) >= 20_000:
                    yield _batch(rows, [*_FIELDS, "bytes"], [*_TYPES, pa.binary()])
                    rows = []
            if rows:
                yield _batch(rows, [*_FIELDS, "bytes"], [*_TYPES, pa.binary()])

    return found.select("d", "sig", "p", "copies", "bytes").mapInArrow(run, _REGION + ", bytes binary")


def _spans_of(covered: DataFrame, length: int) -> DataFrame:
    return covered.select("d", "sig", F.col("p").alias("start"), (F.col("p") + F.col("n") + (length - 1)).alias("stop"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(id_number(docs, id_col), F.lit(-1)).alias("d"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("sig"),
        text.alias("text"),
    )


def find_repeats(docs: DataFrame, length: int = LENGTH, levels=LEVELS, hot: int = HOT) -> DataFrame:
    """Spans (d, sig, start, stop) of repeated bytes, overlapping, of rows made by ``_keyed``."""
    grams = [max(1, min(length, round(length * share))) for share in levels]
    met = cut_lineage(_meet(_document_regions(docs, length, grams[0])))
    spans = _spans_of(met.filter("covered"), length)
    met = met.filter("not covered").drop("covered")
    others = met.filter("not lead").drop("lead").withColumn("bytes", F.lit(None).cast("binary"))
    left = cut_lineage(_with_bytes(docs, met.filter("lead").drop("lead"), length).unionByName(others))
    parts, every = _parts(left), True
    for gram in grams[1:]:
        crowded = cut_lineage(left.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size")).filter(F.col("size") > hot).select("key"))
        if crowded.isEmpty():
            break
        few = F.broadcast(crowded)  # each stands for ``hot`` bytes
        spans = spans.union(_indexed(left.join(few, "key", "left_anti"), length, parts, every))
        split = left.join(few, "key", "left_semi")
        if every:  # regions of kinds with copies are repeated all over, and are split for the sake of others
            spans = spans.union(_spans_of(split.filter("copies = 2"), length))
            split = split.filter("bytes is not null")
        met = cut_lineage(_meet_again(_anchored_again(split, length, gram)))
        spans = spans.union(_spans_of(met.filter("covered"), length))
        left, every = met.filter("not covered").drop("covered"), False
    return spans.union(_indexed(left, length, parts, every))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, levels=LEVELS, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of start, stop; merged, in order), kept (binary)."""
    rows = _keyed(docs, id_col, text_col)
    spans = find_repeats(rows, length, levels, hot).groupBy("d", "sig").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    joined = rows.join(spans.hint("shuffle_hash"), ["d", "sig"], "left").select("doc_id", F.encode("text", "UTF-8").alias("text"), "found")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            kept, merged = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans: list[dict] = []
                for s, e in sorted((x["start"], x["stop"]) for x in found or ()):
                    if spans and s <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(e, spans[-1]["stop"])
                    else:
                        spans.append({"start": s, "stop": e})
                at, parts = 0, []
                for x in spans:
                    parts.append(text[at : x["start"]])
                    at = x["stop"]
                kept.append(b"".join([*parts, text[at:]]))
                merged.append(spans)
            size = pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(merged, span_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
