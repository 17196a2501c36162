"""Chat formatting by schema fingerprinting.

A record's nested field paths are hashed; the hash selects a declarative mapping
that says which fields hold roles and texts.  The mapped record becomes
canonical turns, the turns become one string with turn marks, and control
strings inside roles and texts are escaped so that the string can be read back.

Marks: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per turn.  Escaping adds one
backslash after each ``<`` that backslashes (none or more) and ``|`` follow, so
no ``<|`` is left inside; in roles backslashes and line feeds are escaped too.

A record may have fields besides those of its layout: if the fingerprint of all its
paths selects no mapping, the largest mapping whose paths are among them does, its
fingerprint being that of the shared paths.  This is worked out once for each
different set of paths.

Defined results: null roles and texts are empty; a record whose paths no mapping
has gives no turns and layout null; turns with the same number are ordered by
their formatted strings, so repeated rows all stay; rows without a conversation id
form one conversation with a null id; a text of any length is one value of its row
and is read whole; further columns, whatever their names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Declarative mappings.  ``turns`` entries: a list field with the names of role
#: and text in its items, or a fixed role with the field of its text.  A text
#: may name several fields, joined by a blank line where not empty.
MAPPINGS = [
    {"layout": "turn", "paths": ["role", "text"], "turns": [{"role_field": "role", "text": ["text"]}]},
    {"layout": "messages", "paths": ["messages[].content", "messages[].role"], "turns": [{"list": "messages", "role": "role", "text": "content"}]},
    {"layout": "conversations", "paths": ["conversations[].from", "conversations[].value"], "turns": [{"list": "conversations", "role": "from", "text": "value"}]},
    {"layout": "turns", "paths": ["turns[].role", "turns[].text"], "turns": [{"list": "turns", "role": "role", "text": "text"}]},
    {"layout": "prompt-completion", "paths": ["completion", "prompt"], "turns": [{"fixed": "user", "text": ["prompt"]}, {"fixed": "assistant", "text": ["completion"]}]},
    {"layout": "prompt-response", "paths": ["prompt", "response"], "turns": [{"fixed": "user", "text": ["prompt"]}, {"fixed": "assistant", "text": ["response"]}]},
    {"layout": "question-answer", "paths": ["answer", "question"], "turns": [{"fixed": "user", "text": ["question"]}, {"fixed": "assistant", "text": ["answer"]}]},
    {"layout": "instruction", "paths": ["instruction", "output"], "turns": [{"fixed": "user", "text": ["instruction"]}, {"fixed": "assistant", "text": ["output"]}]},
    {"layout": "instruction-input", "paths": ["input", "instruction", "output"], "turns": [{"fixed": "user", "text": ["instruction", "input"]}, {"fixed": "assistant", "text": ["output"]}]},
    {"layout": "system-instruction", "paths": ["instruction", "output", "system"], "turns": [{"fixed": "system", "text": ["system"]}, {"fixed": "user", "text": ["instruction"]}, {"fixed": "assistant", "text": ["output"]}]},
]
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Paths of a record's leaves; items of lists share one path."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


class Layouts:
    """Mappings by the fingerprint of their paths; a list layout also stands for its empty list."""

    def __init__(self, mappings):
        self.paths = [(frozenset(m["paths"]), m) for m in mappings]
        self.paths += [(frozenset([f"{t['list']}[]"]), m) for m in mappings for t in m["turns"] if "list" in t]
        self.index = {fingerprint(p): m for p, m in self.paths}
        self.chosen: dict[frozenset[str], dict | None] = {}

    def select(self, record) -> dict | None:
        """The mapping for a record, None if there is none."""
        if not isinstance(record, dict):
            return None
        paths = frozenset(field_paths(record))
        if paths not in self.chosen:
            if len(self.chosen) > 10_000:
                self.chosen.clear()
            # the whole set first, then what the record shares with each mapping, the largest first
            shared = sorted((paths & wanted for wanted, _ in self.paths), key=len, reverse=True)
            found = (self.index.get(fingerprint(p)) for p in (paths, *shared) if p)
            self.chosen[paths] = next((m for m in found if m), None)
        return self.chosen[paths]


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    plain = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    turns = []
    for t in mapping["turns"]:
        if "list" in t:
            for item in record[t["list"]] or []:
                item = item if isinstance(item, dict) else {}
                role = plain(item.get(t["role"]))
                turns.append((ROLE_NAMES.get(role, role), plain(item.get(t["text"]))))
        else:
            role = t["fixed"] if "fixed" in t else plain(record[t["role_field"]])
            parts = [plain(record[f]) for f in t["text"]]
            turns.append((role, parts[0] if len(parts) == 1 else "\n\n".join(filter(None, parts))))
    return turns


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn's string and the span of it under the loss mask (texts of assistants)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if role == "assistant" else None


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def formatted(text: str | None, layouts: Layouts) -> tuple[str | None, int, str, list[dict[str, int]]]:
    """Layout, number of turns, string and loss spans of a record in JSON; text that isn't an object has no layout."""
    try:
        record = json.loads(text) if isinstance(text, str) else None
    except ValueError:
        record = None
    mapping = layouts.select(record)
    turns = canonical_turns(record, mapping) if mapping else []
    out, spans, at = [], [], 0
    for piece, span in (render(*t) for t in turns):
        out.append(piece)
        if span:
            spans.append({"start": at + span[0], "stop": at + span[1]})
        at += len(piece)
    return mapping and mapping["layout"], len(turns), "".join(out), spans


def format_records(df: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``df`` plus layout, n_turns, formatted and loss_spans of the JSON records in ``record_col``."""
    added = ["layout", "n_turns", "formatted", "loss_spans"]
    kept = [c for c in df.columns if c not in added]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts = Layouts(mappings)
        for frame in frames:
            rows = [formatted(text, layouts) for text in frame[record_col]]
            yield frame[kept].assign(**dict(zip(added, map(list, zip(*rows)))) if rows else {c: [] for c in added})

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    schema = schema.add("layout", "string").add("n_turns", "long").add("formatted", "string")
    spans = df.sparkSession.createDataFrame([], "loss_spans array<struct<start:long,stop:long>>").schema[0]
    return df.mapInPandas(run, schema.add(spans))


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", mappings=MAPPINGS) -> DataFrame:
    """Formatted turns of conversations stored as rows in order.

    Each row without its two keys is a record: its fields are fingerprinted and
    mapped like those of any other.  A row that is a single turn goes before other
    layouts, as its number says that it is one.  Returns conv_id, turn, layout,
    formatted, loss_spans; a conversation is its formatted strings in order.
    ValueError if no mapping fits the table's columns.
    """
    known = {p.split(".")[0].removesuffix("[]") for m in mappings for p in m["paths"]}
    fields = [c for c in rows.columns if c in known and c not in (conv_col, turn_col)]
    single = [m for m in mappings if "role_field" in m["turns"][0] and set(m["paths"]) <= set(fields)]
    if single:
        fields = [c for c in fields if c in single[0]["paths"]]
    elif not any({p.split(".")[0].removesuffix("[]") for p in m["paths"]} <= set(fields) for m in mappings):
        raise ValueError(f"no mapping for the columns {rows.columns}")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
    keyed = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), record.alias("record"))
    return format_records(keyed, "record", mappings).select("conv_id", "turn", "layout", "formatted", "loss_spans")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What each formatted conversation reads back to, as digests.

    A conversation's turns are sorted, not gathered: hashes run along the sorted
    rows, so memory doesn't depend on a conversation's length.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        close = lambda: (None if now[0] else now[1], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for frame in frames:
            done = []
            for conv, piece, spans in zip(frame["conv_id"], frame["formatted"], frame["loss_spans"]):
                key = (True, 0) if pd.isna(conv) else (False, int(conv))
                if key != now:
                    if state:
                        done.append(close())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    learnt = unescape(piece[span["start"] : span["stop"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([close()], columns=names).astype({"conv_id": "Int64"})

    ordered = turns.select("conv_id", "turn", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInPandas(run, schema)
