"""Token counts by section: encode a document once, then attribute its tokens by their offsets.

A document is encoded whole, so tokens are those a model would see.  Token ends come from summed
byte lengths and are turned into characters; a sorted interval search joins each token to the section
its characters lie in.  A token that crosses a boundary goes to one section by an explicit rule:
``first`` (the section of its first character), ``last`` (of its last) or ``most`` (that holds most
of its characters, the earlier one in a tie).  Counts of sections therefore sum to the whole.

Sections are the parts of the text between ``split`` strings; a section includes the ``split`` that
ends it.  Defined results: a null or empty text is one empty section with no tokens; an empty
table gives no rows; repeated rows are counted one by one; columns named like a result are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packspark.llm.common import texts

RULES = ("first", "last", "most")
ADDED = "section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint"


class Ranks:
    """A byte-level BPE encoder from a rank file and a splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.n_bytes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.n_bytes[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character (exclusive) of each token; a token inside a character spans it."""
        ids = self.encode(text)
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.n_bytes[ids])
        starts = np.concatenate(([0], ends[:-1]))
        lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
        nth = np.cumsum(lead) - 1                    # character of each byte
        return nth[starts], nth[ends - 1] + 1


def sections_of(text: str, split: str) -> np.ndarray:
    """Bounds of the sections: 0, the end of each ``split``, and the length of the text."""
    bounds, at = [0], 0
    while split and (at := text.find(split, at)) >= 0:
        at += len(split)
        bounds.append(at)
    if bounds[-1] != len(text) or len(bounds) == 1:
        bounds.append(len(text))
    return np.array(bounds, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many of them cross the section's bounds."""
    last_section = len(bounds) - 2
    a = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, last_section)
    b = np.clip(np.searchsorted(bounds, ends - 1, "right") - 1, 0, last_section)
    to = a if rule == "first" else b.copy()
    if rule == "most":
        for i in np.flatnonzero(a != b).tolist():
            s = np.arange(a[i], b[i] + 1)
            held = np.minimum(bounds[s + 1], ends[i]) - np.maximum(bounds[s], starts[i])
            to[i] = s[np.argmax(held)]
    n = last_section + 1
    return np.bincount(to, minlength=n), np.bincount(to[a != b], minlength=n)


def section_tokens(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", split: str = "\n",
                   rule: str = "first") -> DataFrame:
    """One row per section: the other columns, ``section``, ``start``, ``end`` (characters, end exclusive),
    ``n_tokens`` and ``n_crossing``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    added = T._parse_datatype_string(ADDED)
    keep = [c for c in df.columns if c not in added.names and c != text]
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    made: list[Ranks] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Ranks(*shared.value))
        for batch in batches:
            row, cols = [], [[] for _ in added]
            for i, t in enumerate(texts(batch.column(text))):
                t = t or ""
                bounds = sections_of(t, split)
                counts, crossing = attribute(*made[0].spans(t), bounds, rule)
                n = len(bounds) - 1
                row.append(np.full(n, i))
                for col, v in zip(cols, (np.arange(n), bounds[:-1], bounds[1:], counts, crossing)):
                    col.append(v)
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64), pa.int64())
            own = [batch.column(c).take(take) for c in keep]
            new = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int32() if f.name == "section" else pa.int64())
                   for f, c in zip(added, cols)]
            yield pa.RecordBatch.from_arrays(own + new, [*keep, *added.names])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + list(added)))


def count_tokens(df: DataFrame, ranks: bytes, pattern: str, columns: list[str], shown: Callable[..., str],
                 name: str) -> DataFrame:
    """Adds ``name``, the tokens of the text that ``shown`` makes of a row's string ``columns``."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    made: list[Ranks] = []
    keep = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Ranks(*shared.value))
        for batch in batches:
            values = zip(*(texts(batch.column(c)) for c in columns))
            n = pa.array([len(made[0].encode(shown(*v))) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], [*keep, name])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.LongType())]))
