"""Packing documents into sequences by sum-of-squares online packing.

A document is its token ids and one end id.  Whole windows are cut off its
front; the rest is placed online: of all fill levels that can take it, and a new
window, the one is chosen that leaves the smallest sum of squared counts of
partially filled windows, kept in an array by level.  What is open when a task's
input ends is closed without padding: the fullest windows are filled up with
tokens cut from the emptiest, and the last is cut into lengths that are powers
of two, which need no padding.

Every task packs its own rows and holds the open windows only, so there is no
shuffle, and a task that is lost is run again with the same result.

Defined results: null text is empty (the end id alone); rows with equal doc_id
are packed apart; doc_ids may be of any type; a text of any length is cut into whole
windows and a rest; further columns are not read and can't clash; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_of

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space as the pattern knows it, for the matcher of Arrow.
_SPACE = r"[\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


class PieceTokenizer:
    """Ids of whole texts by ``tokenizers``, from ids of their distinct space-separated pieces.

    A byte-level vocabulary never joins a word with what precedes the single space
    before it, so pieces can be encoded apart, each once for many texts, unless one is
    empty or has white space at an end: such a text is encoded as a whole, and so is
    one that holds a special token's string.  With a file of another kind every text
    is encoded as a whole.
    """

    #: Bytes of pieces and ids remembered from batch to batch, in two generations: once the
    #: young one has half of them, the old one is forgotten and the young one is old.
    MOST_BYTES = 192 << 20
    #: Characters of the longest piece that is remembered, bytes that an entry takes besides its contents, pieces encoded at once.
    LONGEST, ENTRY, PART = 64, 250, 5_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        kind = self.whole.to_str()
        self.by_piece = self._has_byte_level_words(json.loads(kind)) and not any(" " in s for s in self.special)
        self.known: dict[str, bytes] = {}  # the young generation
        self.old: dict[str, bytes] = {}
        self.held = 0  # by the young one

    @staticmethod
    def _has_byte_level_words(spec: dict) -> bool:
        kind = spec.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space", True)
        return plain and not spec.get("normalizer")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _remember(self, names: list[str], found: list[bytes]) -> None:
        if max(map(len, names), default=0) > self.LONGEST:
            short = [k for k, name in enumerate(names) if len(name) <= self.LONGEST]
            names, found = [names[k] for k in short], [found[k] for k in short]
        size = self.ENTRY * len(names) + 4 * sum(map(len, names)) + sum(map(len, found))
        if self.held + size > self.MOST_BYTES // 2:
            self.old, self.known, self.held = self.known, {}, 0
        self.held += size
        self.known.update(zip(names, found))

    def _recalled(self, names: list[str]) -> list[bytes | None]:
        """Ids of the pieces that are remembered; what only the old generation has is young again."""
        found = list(map(self.known.get, names))
        if self.old:
            old = [(k, ids) for k, f in enumerate(found) if f is None and (ids := self.old.get(names[k])) is not None]
            for k, ids in old:
                found[k] = ids
            for at in range(0, len(old), self.PART):
                part = old[at : at + self.PART]
                self._remember([names[k] for k, _ in part], [ids for _, ids in part])
        return found

    def _head(self, piece: str) -> np.ndarray:
        """Ids of a text's first piece, which has no space before it; kept under a name that no other piece has."""
        [ids] = self._recalled([f"  {piece}"])
        if ids is None:
            ids = self._whole(piece).tobytes()
            self._remember([f"  {piece}"], [ids])
        return np.frombuffer(ids, dtype="<u4")

    def _learn(self, names: list[str]) -> list[bytes]:
        """Ids of pieces, each after a space; short ones are remembered."""
        out: list[bytes] = []
        for at in range(0, len(names), self.PART):
            part = names[at : at + self.PART]
            done = self.whole.encode_batch_fast([f" {n}" for n in part], add_special_tokens=False)
            ids = [array("I", e.ids).tobytes() for e in done]
            self._remember(part, ids)
            out += ids
        return out

    def _pool(self, pieces: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces that aren't odd, where each one's begin and how many they are."""
        names = _strings(pieces)
        found = self._recalled(names)
        new = [k for k, (f, o) in enumerate(zip(found, odd.tolist())) if f is None and not o]
        for k, ids in zip(new, self._learn([names[k] for k in new])):
            found[k] = ids
        found = [f or b"" for f in found]
        count = np.array(list(map(len, found)), dtype=np.int64) // 4
        return np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(count) - count, count

    def ids_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none may be null."""
        if not self.by_piece:
            return [self._whole(t) for t in texts.to_pylist()]
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        odd = pc.match_substring_regex(pieces, f"^$|^{_SPACE}|{_SPACE}$").to_numpy(zero_copy_only=False)
        for special in self.special:
            odd = odd | pc.match_substring(pieces, special).to_numpy(zero_copy_only=False)
        pool, begin, count = self._pool(pieces, odd)
        heads = bounds[:-1]
        bad = odd[index]
        bad[heads] &= pc.not_equal(pieces, "").to_numpy(zero_copy_only=False)[index[heads]]  # a space may come first
        bad_before = np.concatenate([[0], np.cumsum(bad)])
        size = count[index]
        size[heads] = 0
        ends = np.cumsum(size)
        # the ids of all pieces after the first of each text, one after another
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[index] - (ends - size), size)
        ids, ends = pool[where], np.append(0, ends)
        out = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if bad_before[b] - bad_before[a]:
                out.append(self._whole(texts[k].as_py()))
            else:
                out.append(np.concatenate([self._head(pieces[int(index[a])].as_py()), ids[ends[a] : ends[b]]]))
        return out


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


class SumOfSquares:
    """Online packer of (key, start, ids, doc_tokens) pieces into windows."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` tokens on; 0 is a new window."""
        counts, top = self.counts, self.window - size
        levels = np.flatnonzero(counts[1 : top + 1]) + 1
        if not len(levels):
            return 0
        after = levels + size
        # change of the sum of squares: (n-1)^2 - n^2 at the old level, (m+1)^2 - m^2 at the new
        change = 1 - 2 * counts[levels] + np.where(after < self.window, 2 * counts[after] + 1, 0)
        best = len(levels) - 1 - int(np.argmin(change[::-1]))  # the fullest of equals
        return int(levels[best]) if change[best] <= 2 * counts[size] + 1 else 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Place a piece shorter than a window; a window that is full now is returned."""
        size = len(piece[2])
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        return None

    def drain(self) -> Iterator[list[tuple]]:
        """Close all open windows without padding."""
        left = [(level, w) for level in range(1, self.window) for w in self.open[level]]
        self.open, self.counts[:] = [[] for _ in range(self.window + 1)], 0
        low, high = 0, len(left) - 1
        while low < high:
            fill, pieces = left[high]
            while fill < self.window and low < high:
                level, others = left[low]
                taken, others = cut(others, self.window - fill)
                pieces, fill = pieces + taken, fill + sum(len(p[2]) for p in taken)
                if others:
                    left[low] = (level, others)
                else:
                    low += 1
            if fill < self.window:
                left[high] = (fill, pieces)
                break
            yield pieces
            high -= 1
        if low <= high:
            pieces = left[high][1]
            while pieces:
                size = sum(len(p[2]) for p in pieces)
                taken, pieces = cut(pieces, 1 << (size.bit_length() - 1))
                yield taken


def cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` tokens of the pieces, and the others."""
    taken = []
    for k, (key, start, ids, total) in enumerate(pieces):
        if size == 0:
            return taken, pieces[k:]
        taken.append((key, start, ids[:size], total))
        if len(ids) > size:
            return taken, [(key, start + size, ids[size:], total), *pieces[k + 1 :]]
        size -= len(ids)
    return taken, []


def pack_documents(docs: Iterator[tuple[int, np.ndarray]], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Sequences (lists of pieces) of (doc_id, ids with the end id) documents."""
    packer = SumOfSquares(window)
    for key, ids in docs:
        total = len(ids)
        for start in range(0, total - window + 1, window):
            yield [(key, start, ids[start : start + window], total)]
        if (rest := total % window) and (full := packer.place((key, total - rest, ids[total - rest :], total))):
            yield full
    yield from packer.drain()


def portions(batch: pa.RecordBatch, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (key, text), of about ``size`` bytes of text each."""
    sums = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sums):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; see SCHEMA."""
    rows_in = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = to_arrow_type(rows_in.schema["doc_id"].dataType)

    def run(batches):
        encode = tokenizer(tokenizer_path).ids_of
        end = np.array([end_id], dtype="<u4")
        base = TaskContext.get().partitionId() << 33

        def rows():
            for batch in batches:
                for part in portions(batch):
                    for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                        yield key, np.concatenate([ids, end])

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out: list[tuple] = []
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else id_type) for k, c in enumerate(zip(*out))], names)
        for n, pieces in enumerate(pack_documents(rows(), window)):
            offset = 0
            for key, start, ids, total in pieces:
                out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + n, offset))
                offset += len(ids)
            if len(out) >= 5000:
                yield send()
                out.clear()
        if out:
            yield send()

    return rows_in.mapInArrow(run, SCHEMA.format(rows_in.schema["doc_id"].dataType.simpleString()))
