"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items are lower-cased (A-Z) and cut into words; all items enter one automaton whose
states carry the items they occur in.  Each document's words are streamed through it; the longest
match ending at each word says which words lie in a window of ``window`` consecutive item words
(an item of fewer words is one window).  ``scan`` reports, ``decontaminate`` cuts hit spans and
drops documents beyond the coverage limit.

Items go to the tasks in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark is streamed
block by block over the documents, each result being written before the next block.  An
automaton has at most two states per word, so the memory of a task is bounded.

Defined results: null texts have no words and no hits; null item texts are no items; a null
item_id is called "null"; rows that repeat an item_id are one item; an empty benchmark hits
nothing; columns named like a result are replaced, all others kept; repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspark.llm.common import lean, materialise, texts

WINDOW = 10
BLOCK_WORDS = 1_000_000
MAX_COVERAGE = 0.5

# words are runs of ASCII letters, digits and non-ASCII characters
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def words_of_text(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8; one byte table does case and separators."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton over word numbers of many items; states know the items they occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in rows:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.min_window = min([window, *(len(ids) for _, ids in rows)]) if rows else 0
        self.items: dict[int, set[str]] = {}      # window state -> items
        self.short: dict[int, list[tuple[int, str]]] = {}  # state -> (length, item) of items under the window
        for name, ids in rows:
            self._mark(name, ids)
        self._find_nearest()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:                        # the factor is known from an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _mark(self, name: str, ids: list[int]) -> None:
        s = 0
        for c in ids:
            s = self.next[s][c]
            if len(ids) >= self.window:
                up = s
                while up > 0 and self.length[up] >= self.window:
                    if self.length[self.link[up]] < self.window:
                        self.items.setdefault(up, set()).add(name)
                    up = self.link[up]
        if len(ids) < self.window:
            self.short.setdefault(s, []).append((len(ids), name))

    def _find_nearest(self) -> None:
        """For each state, the ancestor-or-self that holds its window and the nearest with a short item."""
        n = len(self.next)
        self.window_state, self.short_state = [0] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.window_state[s] = s if self.length[up] < self.window else self.window_state[up]
            self.short_state[s] = s if s in self.short else self.short_state[up] if up >= 0 else -1

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans of words (start, end exclusive, merged), items hit, longest match."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        longest = 0
        if not self.vocab or len(words) < self.min_window:
            return spans, names, longest
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):   # runs of words that items use
            if b - a >= self.min_window:
                longest = max(longest, self._walk(ids[a:b].tolist(), a, spans, names))
        return spans, names, longest

    def _walk(self, ids: list[int], at: int, spans: list, names: set) -> int:
        nxt, link, length = self.next, self.link, self.length
        s = n = longest = 0
        for i, c in enumerate(ids, at + 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            longest = max(longest, n)
            hit = 0
            if n >= self.window:
                hit = self.window
                names.update(self.items[self.window_state[s]])
            up = self.short_state[s]
            while up >= 0:
                for m, name in self.short[up]:
                    if m <= n:
                        hit = max(hit, m)
                        names.add(name)
                up = self.short_state[link[up]] if link[up] >= 0 else -1
            if hit:
                start = i - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return longest


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Item rows in blocks of at most BLOCK_WORDS words (a longer single item is a block), one at a time."""
    rows = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("k"), "text").toLocalIterator()
    block, words = [], 0
    for k, text in rows:
        n = len(text) // 2 + 1                     # an upper bound on its words
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((k, text))
        words += n
    yield block


RESULT = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, longest int"


def _scan_block(df: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """Adds what one block of items hits to the result columns (null before the first block)."""
    shared = df.sparkSession.sparkContext.broadcast(items)
    made = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Automaton([(k, words_of_text(t)) for k, t in shared.value], window))
        auto = made[0]
        for batch in batches:
            old = [batch.column(c) for c in ("spans", "items", "longest")]
            counts, spans, items, longest = [], [], [], []
            for i, text in enumerate(texts(batch.column("text"))):
                words = words_of_text(text)
                found, names, most = auto.match(words)
                if old[2][i].is_valid:             # an earlier block has been here
                    found = _union(found + [(x["start"], x["end"]) for x in old[0][i].as_py()])
                    names = names | set(old[1][i].as_py())
                    most = max(most, old[2][i].as_py())
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(names))
                longest.append(most)
            new = {"n_words": pa.array(counts, pa.int64()),
                   "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                   "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(longest, pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(lean(run), df.schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds n_words, spans (hit word ranges, merged), items (sorted ids) and longest (match length) per row."""
    kinds = T._parse_datatype_string(RESULT)
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in kinds.names],
                     *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
    first = True
    for block in _blocks(benchmark):
        df = _scan_block(df if first else materialise(df, "decontaminate"), block, window)
        first = False
    return df


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + (s["end"] - s["start"]))


MARK = "\u2026"


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span of words (and what lies between them) replaced by MARK."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return MARK.join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents (their own columns) with hit spans cut out of ``text``; those of which more than
    ``max_coverage`` of the words is hit are dropped.  MARK stands for a cut span: it is a word of its own,
    so the neighbours of a cut don't join into a new window.  ``n_chars`` follows a changed text."""
    found = scan(docs, benchmark, window).where(n_hit() <= max_coverage * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            spans = batch.column("spans").to_pylist()
            left = [cut_spans(t, [(x["start"], x["end"]) for x in s]) if s else t
                     for t, s in zip(batch.column("text").to_pylist(), spans)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(left, batch.schema.field(i).type))

    out = found.mapInArrow(lean(run), found.schema)
    changed = F.size("spans") > 0
    return out.select(*[F.when(changed, F.length("text").cast(f.dataType)).otherwise(F.col("n_chars")).alias("n_chars")
                        if f.name == "n_chars" else F.col(f"`{f.name}`") for f in docs.schema])


def contamination_sql(window: int = WINDOW) -> str:
    """DuckDB text of the per-document digest over ``documents`` and ``benchmark``."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), {window}) AS m, list_aggregate(w[p:p + least(len(w), {window}) - 1], 'string_agg', ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, m, p, list_aggregate(w[p:p + m - 1], 'string_agg', ' ') AS k
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw))),
hit AS (SELECT r, p, iw.m, item FROM dw JOIN iw ON dw.k = iw.k AND dw.m = iw.m),
cov AS (SELECT r, count(DISTINCT p + j) AS n FROM (SELECT r, p, unnest(range(0, m)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""
