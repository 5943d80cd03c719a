"""Language-model scoring over the subword lattice: the probability of a text under all its segmentations.

A text is lower-cased (A-Z) and cut into words; each word with a leading word mark, and a closing end, are the
units of a unigram model over the pieces of a public vocabulary.  The probability of a unit is the sum over
all ways to cut it into pieces, by a forward recursion in log space; a text's is the product over its
units, which is the lattice of the whole text, as no piece spans two units.  A character without
a piece of its own is spelled by byte pieces.

The vocabulary's own scores weight the segmentations at first (unigram scores are log weights; in a
merge vocabulary a score is a negative rank, read by Zipf's law).  Expectation-maximisation rounds over the counted words
of the training texts then re-estimate the weights, with the vocabulary's weights as a prior.

Work on words is done once per distinct word: words of all texts are counted, the count table is the input
of the rounds, and one pass gives every word its lattice probability.  A second pass over the texts adds
up; the most frequent words (a bounded table) come from memory, all others by a join on the word, and so no
key of that join is common.

Defined results: null and empty texts consist of the end alone; words and texts of any length are scored whole; rows
without an id are neither held out nor learnt from; repeated rows count each; without training rows the
vocabulary's weights hold; an empty table gives an empty result; columns named like a result are replaced, others kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspark.llm.common import by_bytes, materialise
from packspark.llm.pieces import MARK, _fields

FREQUENT = 100_000      # words kept in memory, the most frequent; bounds memory, not results
FREQUENT_BYTES = 48     # ... and none longer than this
COUNTED = 200_000       # words counted in a task before they are passed on
CELLS = 1 << 16         # characters of a block of the lattice
STRETCH = 1 << 12       # characters of a longer word that are learnt from together
ROUNDS = 2
PRIOR = 1000.0          # pieces that the vocabulary's own weights speak for
END_SHARE = 1e-3        # the end's weight before any text is seen
GRID = 1 << 16          # expected counts are added up as multiples of 1 / GRID, in any order
PAD = 0x110000          # no character
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
END = b" "              # the end among the words: no word holds a space


@dataclass
class Vocabulary:
    """Pieces that stand for text, by id; ``weight`` holds the log weights of the file, the end's last."""
    pieces: dict[str, int]
    byte_ids: np.ndarray
    weight: np.ndarray

    @property
    def end(self) -> int:
        return len(self.weight) - 1


def read_vocabulary(model: bytes) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file (unigram or merge)."""
    entries, unigram = [], True
    for number, value, _ in _fields(model):
        if number == 1:
            f = {n: (v, raw) for n, v, raw in _fields(value)}
            score = np.frombuffer(f[2][0], "<f4")[0] if 2 in f else 0.0
            entries.append((f[1][0].decode(), float(score), f[3][0] if 3 in f else 1))
        elif number == 2:
            unigram = {n: v for n, v, _ in _fields(value)}.get(3, 1) == 1
    pieces, byte_ids = {}, np.full(256, -1, np.int64)
    weight = np.full(len(entries) + 1, -np.inf)
    top = max((s for _, s, kind in entries if kind in (1, 4)), default=0.0)
    for i, (piece, score, kind) in enumerate(entries):
        if kind in (1, 4):                             # normal, user-defined
            pieces[piece] = i
            weight[i] = score if unigram else -math.log(min(top - score, len(entries)) + 10.0)
        elif kind == 6:
            byte_ids[int(piece[3:5], 16)] = i
    least = weight[weight > -np.inf].min(initial=0.0)
    if (byte_ids < 0).any():                           # no byte pieces: bytes get ids of their own, after the end's
        extra = np.nonzero(byte_ids < 0)[0]
        byte_ids[extra] = len(weight) - 1 + np.arange(len(extra))
        weight = np.concatenate([weight[:-1], np.full(len(extra), -np.inf), weight[-1:]])
    weight[byte_ids] = least
    weight[-1] = math.log(END_SHARE / (1 - END_SHARE)) + np.logaddexp.reduce(weight[:-1])
    return Vocabulary(pieces, byte_ids, weight - np.logaddexp.reduce(weight))


class Lattice:
    """Forward and backward recursions over many units at once.

    Pieces lie in a trie whose edges are sorted numbers (node, character), so a block of positions walks it
    together, one length after the other."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        nodes: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for piece, i in vocabulary.pieces.items():
            node = 0
            for ch in piece:
                node = nodes.setdefault((node, ord(ch)), len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            if node:
                piece_at[node] = i
        edges = sorted(((a << 21) | c, b) for (a, c), b in nodes.items())
        self.edge = np.array([e for e, _ in edges] or [-1], np.int64)
        self.to = np.array([b for _, b in edges] or [0], np.int64)
        self.piece_at = np.array(piece_at, np.int64)
        self.longest = max(map(len, vocabulary.pieces), default=1)
        root = {c: self.piece_at[b] for (a, c), b in nodes.items() if a == 0}
        self.single = np.array(sorted(c for c, i in root.items() if i >= 0), np.int64)

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per length, the id of the piece that begins at each cell (-1: none)."""
        out = []
        rows, cols = codes.shape
        at_row, at_col = (a.ravel() for a in np.indices(codes.shape))
        node = np.zeros(rows * cols, np.int64)
        for n in range(1, self.longest + 1):
            inside = at_col + n <= cols
            at_row, at_col, node = at_row[inside], at_col[inside], node[inside]
            key = (node << 21) | codes[at_row, at_col + n - 1]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            live = self.edge[k] == key
            at_row, at_col, node = at_row[live], at_col[live], self.to[k[live]]
            if not len(node):
                break
            found = np.full(codes.shape, -1, np.int64)
            found[at_row, at_col] = self.piece_at[node]
            out.append(found)
        return out or [np.full(codes.shape, -1, np.int64)]

    def spelled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of characters without a piece, and the byte counts (cell, 256) of their spelling."""
        k = np.minimum(np.searchsorted(self.single, codes), max(len(self.single) - 1, 0))
        alone = (codes != PAD) & (self.single[k] != codes if len(self.single) else True)
        kinds, at = np.unique(codes[alone], return_inverse=True)
        spelling = np.zeros((len(kinds), 256))
        for i, c in enumerate(kinds.tolist()):
            for b in chr(c).encode("utf-8", "surrogatepass"):
                spelling[i, b] += 1
        return alone, spelling[at]

    def arcs(self, codes: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (unit, begin, length - 1) and their log probabilities; a spelled character is an arc of length 1."""
        ids = np.stack(self.matches(codes), axis=2)
        p = np.append(logp, -np.inf)[ids]
        alone, spelling = self.spelled(codes)
        if alone.any():
            p[..., 0][alone] = spelling @ logp[self.vocabulary.byte_ids]
        return ids, p

    @staticmethod
    def forward(p: np.ndarray, before: np.ndarray | None = None, lead: int = 0) -> np.ndarray:
        """Log probability of each beginning, all its segmentations together: (unit, end).

        A window that continues another repeats its last ``lead`` characters; ``before`` has the values around these."""
        rows, cols, longest = p.shape
        a = np.full((rows, cols + 1), -np.inf)
        a[:, :lead + 1] = 0.0 if before is None else before
        lengths = np.arange(longest)
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(lead, cols):                # ends after character j: a piece of length n begins at j - n + 1
                begin = j - lengths
                s = np.where(begin >= 0, a[:, begin] + p[:, begin, lengths], -np.inf)
                top = s.max(axis=1)
                a[:, j + 1] = np.where(top > -np.inf, top + np.log(np.exp(s - top[:, None]).sum(axis=1)), -np.inf)
        return a

    def backward(self, size: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log probability of the rest of each unit from each place on: (unit, begin)."""
        rows, cols, longest = p.shape
        b = np.full((rows, cols + longest + 1), -np.inf)
        b[np.arange(rows), size] = 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            for i in range(cols - 1, -1, -1):
                s = p[:, i] + b[:, i + 1:i + 1 + longest]
                top = s.max(axis=1)
                rest = np.where(top > -np.inf, top + np.log(np.exp(s - top[:, None]).sum(axis=1)), -np.inf)
                b[:, i] = np.where(size == i, 0.0, rest)
        return b[:, :cols + 1]

    def blocks(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Units of like length together: (their places, code points padded, sizes)."""
        size = np.array([len(u) for u in units], np.int64)
        order = np.argsort(size, kind="stable")
        start = 0
        while start < len(order):
            end = start
            while end < len(order) and (end == start or (end + 1 - start) * size[order[end]] <= CELLS):
                end = min(len(order), end + 256)
            while end > start + 1 and (end - start) * size[order[end - 1]] > CELLS:
                end = start + max(1, (end - start) // 2)
            at = order[start:end]
            codes = np.full((len(at), max(int(size[at].max()), 1)), PAD, np.int64)
            for r, i in enumerate(at):
                if size[i]:
                    codes[r, :size[i]] = np.frombuffer(units[i].encode("utf-32-le", "surrogatepass"), "<u4")
            yield at, codes, size[at]
            start = end

    def log_probability(self, units: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each unit's probability.  A long unit goes through in windows of columns, with the
        last values carried on, so memory is bounded by CELLS and the longest piece."""
        out = np.zeros(len(units))
        for at, codes, size in self.blocks(units):
            before, lead = None, 0
            for start in range(0, codes.shape[1], CELLS):
                a = self.forward(self.arcs(codes[:, start - lead:start + CELLS], logp)[1], before, lead)
                lead = min(self.longest, a.shape[1] - 1)
                before = a[:, -lead - 1:]
            out[at] = a[np.arange(len(at)), size if len(at) > 1 else -1]
        return out

    def expected(self, units: list[str], n: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations of the units, each seen ``n`` times, in 1 / GRID.
        Units over STRETCH characters are cut into stretches of that length, all of which count."""
        out = np.zeros(len(logp), np.int64)
        n = np.repeat(n, [max(1, -(-len(u) // STRETCH)) for u in units])
        units = [u[i:i + STRETCH] for u in units for i in range(0, max(1, len(u)), STRETCH)]
        for at, codes, size in self.blocks(units):
            ids, p = self.arcs(codes, logp)
            a, b = self.forward(p), self.backward(size, p)
            rows, cols, longest = p.shape
            whole = a[np.arange(rows), size]
            ends = np.minimum(np.arange(cols)[:, None] + np.arange(1, longest + 1), cols)
            with np.errstate(invalid="ignore"):
                share = np.exp(a[:, :cols, None] + p + b[:, ends] - whole[:, None, None])
            share = np.nan_to_num(share) * (n[at] * float(GRID))[:, None, None]
            held = (ids >= 0) & (share > 0)
            np.add.at(out, ids[held], np.rint(share[held]).astype(np.int64))
            alone, spelling = self.spelled(codes)
            if alone.any():
                np.add.at(out, self.vocabulary.byte_ids,
                          np.rint(share[..., 0][alone] @ spelling).astype(np.int64))
        return out


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space."""
    return text.lower().split() if text else []


def unit(word: bytes) -> str:
    return MARK + word.decode("utf-8", "surrogatepass")


def count_words(docs: DataFrame, text: str, trains: Column) -> DataFrame:
    """(word, c, n): occurrences in training texts and in all, the end included; counted in tasks first."""
    def rows(n: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.binary()), pa.array([v[0] for v in n.values()], pa.int64()),
             pa.array([v[1] for v in n.values()], pa.int64())], ["word", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in by_bytes(batch, "t"):
                for t, train in zip(part.column("t").cast(pa.binary()).to_pylist(), part.column("train").to_pylist()):
                    for w, k in Counter([*words(t), END]).items():
                        own = n.get(w)
                        if own is None:
                            own = n[w] = [0, 0]
                        own[0] += k * train
                        own[1] += k
                    if len(n) >= COUNTED:
                        yield rows(n)
                        n.clear()
        yield rows(n)

    made = docs.select(F.col(f"`{text}`").alias("t"), trains.cast("int").alias("train")) \
        .mapInArrow(run, "word binary, c bigint, n bigint")
    return made.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_weights(counts: DataFrame, vocabulary: Vocabulary, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces and the end after ``rounds`` of expectation maximisation over the counted
    training words.  Each round sends the weights out and gets a sum per piece back."""
    logp = vocabulary.weight
    trained = counts.where(F.col("c") > 0).select("word", "c")
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((vocabulary, logp))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, logp = shared.value
            lattice = Lattice(vocabulary)
            total = np.zeros(len(logp), np.int64)
            for batch in batches:
                for part in by_bytes(batch, "word", 1 << 20):
                    own, n = part.column("word").to_pylist(), part.column("c").to_numpy()
                    ends = np.array([w == END for w in own])
                    total[vocabulary.end] += int(n[ends].sum()) * GRID
                    total += lattice.expected([unit(w) for w, e in zip(own, ends) if not e], n[~ends], logp)
            held = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["i", "s"])

        seen = np.zeros(len(logp))
        for r in trained.mapInArrow(run, "i int, s bigint").groupBy("i") \
                .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            seen[r["i"]] = int(r["s"]) / GRID
        with np.errstate(divide="ignore"):
            logp = np.log(seen + PRIOR * np.exp(vocabulary.weight)) - math.log(seen.sum() + PRIOR)
    return logp


def score_words(counts: DataFrame, vocabulary: Vocabulary, logp: np.ndarray) -> DataFrame:
    """Adds ``lp`` to the count table: log10 of the word's probability over all its segmentations."""
    shared = counts.sparkSession.sparkContext.broadcast((vocabulary, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logp = shared.value
        lattice = Lattice(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, "word", 1 << 20):
                own = part.column("word").to_pylist()
                lp = np.array([logp[vocabulary.end] if w == END else 0.0 for w in own])
                at = np.array([i for i, w in enumerate(own) if w != END], np.int64)
                lp[at] = lattice.log_probability([unit(own[i]) for i in at], logp)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lp / math.log(10))], [*part.schema.names, "lp"])

    return counts.select("word", "c", "n").mapInArrow(run, "word binary, c bigint, n bigint, lp double")


def add_up(docs: DataFrame, text: str, table: list) -> DataFrame:
    """Each row with the sums over its frequent words and the list of its other words.

    ``table`` has (word, c, lp) of the frequent ones.  Sums: known tokens, log10(c + 1), lp."""
    shared = docs.sparkSession.sparkContext.broadcast(
        ({w: i for i, (w, _, _) in enumerate(table)}, np.array([c for _, c, _ in table], np.int64),
         np.array([lp for _, _, lp in table])))
    keep = [c for c in docs.columns if c not in (*ADDED, "_lm_row")]
    added = T._parse_datatype_string("n_tokens bigint, _lm_known bigint, _lm_base double, _lm_score double, "
                                     "_lm_rare array<struct<word:binary,k:bigint>>")
    schema = T.StructType([docs.schema[c] for c in keep] + list(added))
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c, lp = shared.value
        log_c = np.log10(c + 1.0)
        get = at.get
        for batch in batches:
            for part in by_bytes(batch, text):
                sums, rares = [], []
                for t in part.column(text).cast(pa.binary()).to_pylist():
                    held = Counter([*words(t), END])
                    index, times, rare = [], [], []
                    for w, k in held.items():
                        i = get(w)
                        if i is None:
                            rare.append({"word": w, "k": k})
                        else:
                            index.append(i)
                            times.append(k)
                    i, k = np.array(index, np.int64), np.array(times, np.int64)
                    sums.append((sum(held.values()), int(k[c[i] > 0].sum()), float(log_c[i] @ k), float(lp[i] @ k)))
                    rares.append(rare)
                n, known, base, score = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in keep], pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rares, rare_type)], schema.names)

    return docs.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: bytes, trains: Column, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Every row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``trains`` says which rows are learnt from.  ``base_score`` is the log10 probability under add-one smoothed word
    counts, ``score`` the one of the subword lattice."""
    vocabulary = read_vocabulary(model)
    counts = materialise(count_words(docs, text, F.coalesce(trains, F.lit(False))), "word-counts")
    logp = fit_weights(counts, vocabulary, rounds)
    scored = materialise(score_words(counts, vocabulary, logp), "word-scores")
    total = scored.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("types")).first()
    tokens, types = int(total["tokens"] or 0), int(total["types"] or 0)
    short = scored.where(F.octet_length("word") <= FREQUENT_BYTES)
    table = [(bytes(r["word"]), r["c"], r["lp"])
             for r in short.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "c", "lp").collect()]
    parts = materialise(add_up(docs, text, table).withColumn("_lm_row", F.monotonically_increasing_id()), "text-sums")
    rare = parts.select("_lm_row", F.explode("_lm_rare").alias("r")).select("_lm_row", "r.word", "r.k") \
        .join(scored.select("word", "c", "lp"), "word")
    rest = rare.groupBy("_lm_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_lm_known2"),
        F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("_lm_base2"), F.sum(F.col("k") * F.col("lp")).alias("_lm_score2"))
    zero = F.lit(0.0)
    keep = [F.col(f"`{c}`") for c in parts.columns if not c.startswith("_lm_") and c != "n_tokens"]
    return parts.drop("_lm_rare").join(rest, "_lm_row", "left").select(
        *keep, "n_tokens", (F.col("_lm_known") + F.coalesce("_lm_known2", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("_lm_base") + F.coalesce("_lm_base2", zero)
         - F.col("n_tokens") * F.lit(math.log10(tokens + types + 1))).alias("base_score"),
        (F.col("_lm_score") + F.coalesce("_lm_score2", zero)).alias("score"))
