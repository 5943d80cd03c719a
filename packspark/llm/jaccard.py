"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct sets of word n-grams (equal sets are one row from the start), columns are
64-bit n-gram hashes.  Blocks of columns are multiplied in the shuffle by column.  Bounds from the
set sizes decide what enters the product and what leaves it:

* a set of n members links only with sets that share one of its first n/5 + 1 members in any fixed
  order, so only these columns enter (order: rare before frequent, so common passages come last);
* a common column at places i and j leaves at most min(i, j) + 1 + min(rest, rest) in common;
* sizes must be within a fifth of each other;
* the product of parity bitmaps (two bits a member) bounds the difference of two sets from below.

Pairs that pass have their overlap counted in full.  Copies don't multiply: a column pairs each row with
its most central row only, and after these links are merged only columns with rows in different
components are multiplied further, rows of one component never again.  After HUB_ROUNDS such rounds at most the block products
test all pairs that are left.  No link between different
components is left out, so the components are exact.

Defined results: sets of null and empty texts are empty and linked with nothing (their component is
their own id); texts of fewer than five words are one n-gram; rows without a doc_id have the
component of the rows of equal set that bear ids, else none; rows that repeat a doc_id are one document that
links as each of them; very long texts are shingled whole; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import lean, materialise
from packspark.llm.graph import components

WORDS = 5
FREQUENT_COLUMNS = 200_000    # columns known as frequent; they only shape the order, never the result
CHUNK_MEMBERS = 2_000_000     # members counted together when looking for frequent columns
FREQUENT_IN_CHUNK = 8
FILTER_WORDS = 1 << 17        # 64-bit words of the fixed-size filter of candidate ids
CHUNK_BYTES = 1 << 18         # bytes of text hashed together (a worker holds about thirty times as much while it does)
BLOCK_ROWS = 500              # rows of a column multiplied as one block
PAIRS_PER_ENTRY = 1000        # remaining pairs per matrix entry at which all of them are tested at once
HUB_ROUNDS = 6                # rounds of hubs at most; the block products take any number of pairs after them
SEEN_PAIRS = 1_000_000        # pairs a task remembers as tested

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct n-gram hashes of texts, straight from Arrow's UTF-8 buffers.

    A word's hash is the sum of (value of byte) * (value of place), mixed; an n-gram's hash mixes its
    words' hashes in turn.  Texts are worked on in pieces of about CHUNK_BYTES, cut at white space."""

    def __init__(self):
        with np.errstate(over="ignore"):
            value = _mixed(np.arange(1, 257, dtype=np.uint64) * _P)
            self.places = _mixed(np.arange(1, 4097, dtype=np.uint64) * _Q) | np.uint64(1)
        value[65:91] = value[97:123]
        value[_SPACES] = 0
        self.value = value

    def _place(self, n: int) -> np.ndarray:
        if n > len(self.places):
            with np.errstate(over="ignore"):
                self.places = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _Q) | np.uint64(1)
        return self.places

    def _words(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of a piece and where they start; ``cuts`` are starts of texts in it."""
        solid = ~_SPACES[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        cuts = cuts[cuts < len(b)]
        first[cuts] = solid[cuts]
        at = np.flatnonzero(first)
        if not len(at):
            return np.zeros(0, np.uint64), at
        size = np.diff(np.append(at, len(b)))
        place = np.arange(at[0], len(b)) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(self.value[b[at[0]:]] * self._place(int(size.max()))[place], at - at[0])
            return _mixed(h), at

    def columns(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Members of each text of an Arrow string column, in order."""
        if len(texts) == 0:
            return
        wide = pa.types.is_large_string(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK_BYTES, "right")) - 1)
            part = b[ends[i]:ends[j]]
            if j == i + 1 and len(part) > 2 * CHUNK_BYTES:
                yield self._grams(np.concatenate([h for h in self._pieces(part)]))
            else:
                cuts = (ends[i:j] - ends[i]).astype(np.int64)
                h, at = self._words(part, cuts)
                stop = np.searchsorted(at, np.append(cuts, len(part)))
                for k in range(j - i):
                    yield self._grams(h[stop[k]:stop[k + 1]])
            i = j

    def _pieces(self, b: np.ndarray) -> Iterator[np.ndarray]:
        """Word hashes of one long text, piece by piece."""
        at = 0
        while at < len(b):
            end = min(at + CHUNK_BYTES, len(b))
            while end < len(b):
                space = np.flatnonzero(_SPACES[b[end:end + CHUNK_BYTES]])
                if len(space):
                    end += int(space[0])
                    break
                end = min(end + CHUNK_BYTES, len(b))
            yield self._words(b[at:end], np.zeros(1, np.int64))[0]
            at = end

    @staticmethod
    def _grams(w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        n = min(WORDS, len(w))
        with np.errstate(over="ignore"):
            h = np.full(len(w) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ w[k:len(w) - n + 1 + k]) * _P
                h ^= h >> np.uint64(29)
            h = np.sort(_mixed(h))
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        return h[fresh]


def ordered_prefix(members: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n/5 + 1 members: rare ones by hash, then frequent ones by rank."""
    n = len(members) // 5 + 1 if len(members) else 0
    if len(frequent) and len(members):
        at = np.searchsorted(frequent, members)
        at[at == len(frequent)] = 0
        common = frequent[at] == members
        if common.any():
            rare = members[~common]
            late = members[common][np.argsort(rank[at[common]], kind="stable")]
            return np.concatenate((rare, late))[:n]
    return members[:n]


def bitmap(members: np.ndarray) -> bytes:
    """Parity bitmap with two bits a member or more (a power of two, 64 at least), so that few of the
    members that two sets don't share cancel out."""
    width = max(64, 2 << int(len(members) - 1).bit_length()) if len(members) else 64
    bits = np.bincount((members & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """Whether the bitmaps leave room for a Jaccard similarity of 0.8 (never false for a linked pair)."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)))
    elif len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)))
    return int(np.bitwise_count(x ^ y).sum()) <= na + nb - 2 * needed(na, nb)


def needed(na: int, nb: int) -> int:
    """Least overlap of linked sets: 100 * i >= 80 * (na + nb - i)."""
    return -(-4 * (na + nb) // 9)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b))


def _sets(docs: DataFrame) -> DataFrame:
    """One pass: per row (kind 0) its set size and 128-bit set hash, and (kind 1) columns frequent in a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        chunk: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for batch in batches:
            n, k1, k2 = [], [], []
            for m in s.columns(batch.column("text")):
                key = xxhash.xxh3_128_intdigest(m.tobytes())
                key = (_signed(key >> 64), _signed(key & (1 << 64) - 1))
                n.append(len(m)), k1.append(key[0]), k2.append(key[1])
                if len(m) and key not in chunk:
                    chunk[key] = m
                    held += len(m)
                    if held >= CHUNK_MEMBERS:
                        yield from _frequent(chunk)
                        chunk, held = {}, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(n), pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["kind", "doc_id", "n", "k1", "k2"])
        yield from _frequent(chunk)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lean(run), "kind int, doc_id bigint, n bigint, k1 bigint, k2 bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _frequent(chunk: dict) -> Iterator[pa.RecordBatch]:
    """Columns of FREQUENT_IN_CHUNK sets or more, with their counts.  The chunk is emptied: its members are sorted in one array
    and only columns that fill so many places there are counted."""
    if chunk:
        members = np.concatenate(list(chunk.values()))
        chunk.clear()
        members.sort()
        last = FREQUENT_IN_CHUNK - 1
        h = np.unique(members[last:][members[last:] == members[:max(0, len(members) - last)]])
        n = np.searchsorted(members, h, "right") - np.searchsorted(members, h, "left")
        h = h.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(h)), pa.int32()), pa.nulls(len(h), pa.int64()), pa.array(n, pa.int64()),
             pa.array(h, pa.int64()), pa.array(np.zeros(len(h)), pa.int64())], ["kind", "doc_id", "n", "k1", "k2"])


def _frequent_order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent columns (at most FREQUENT_COLUMNS), sorted by hash, with their ranks."""
    top = sets.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "k1").limit(FREQUENT_COLUMNS).toPandas()
    h = top["k1"].to_numpy(np.int64).astype(np.uint64)
    rank = np.lexsort((h, top["n"].to_numpy(np.int64)))
    place = np.empty(len(h), np.int64)
    place[rank] = np.arange(len(h))
    by = np.argsort(h)
    return h[by], place[by]


def _rows(docs: DataFrame, classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Matrix rows: one document per distinct set with its prefix columns and bitmap, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for batch in batches:
            n, prefix, bits = [], [], []
            for m in s.columns(batch.column("text")):
                n.append(len(m))
                prefix.append(ordered_prefix(m, *shared.value).astype(np.int64))
                bits.append(bitmap(m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())),
                 pa.array(bits, pa.binary())], ["doc", "n", "prefix", "bits"])

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL") \
        .mapInArrow(lean(run), "doc bigint, n bigint, prefix array<bigint>, bits binary").where("n > 0")
    return materialise(made.join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi"), "matrix-rows")


def _fits(nx: str, px: str, ny: str, py: str) -> Column:
    """Size and place bounds of a common column of two rows."""
    a, b, i, j = F.col(nx), F.col(ny), F.col(px), F.col(py)
    most = F.least(i, j) + F.least(a - i, b - j)
    return (100 * F.least(a, b) >= 80 * F.greatest(a, b)) & (9 * most >= 4 * (a + b))


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of columns with two rows or more, and how central their row is: the rows it meets in its columns
    against its size.  Among near copies the row with the fewest changes is the most central one."""
    held = entries.groupBy("h").agg(F.count("*").alias("_met")).where("_met > 1")
    met = materialise(entries.join(held, "h"), "shared")
    central = met.groupBy("doc").agg((F.sum("_met") / F.first("n")).alias("central"))
    return met.drop("_met", "central").join(central, "doc")


def _by_centre(entries: DataFrame) -> DataFrame:
    """Entries apart from each column's most central row, which is named beside (l...)."""
    names = [c for c in entries.columns if c not in ("h", "central")]
    order = F.struct(F.col("central"), -F.col("n"), -F.col("doc"))
    first = entries.groupBy("h").agg(F.max_by(F.struct(*[F.col(c).alias(f"l{c}") for c in names]), order).alias("_first"))
    return entries.drop("central").join(first.select("h", "_first.*"), "h").where("doc <> ldoc")


def _pairs(found: DataFrame) -> DataFrame:
    return found.where((F.col("ldoc") != F.col("doc")) & _fits("n", "pos", "ln", "lpos")) \
        .select(F.col("ldoc").alias("a"), F.col("doc").alias("b")).distinct()


def _by_bitmap(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    side = lambda k: rows.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"m{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("na", "ma", "nb", "mb")]
            keep = pa.array([may_link(*x) for x in zip(*cols)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a bigint, b bigint")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds every id's bit (others may be set too)."""
    words = ids.select(*_bit(F.col("doc"))).groupBy("_word").agg(F.bit_or("_mask").alias("_mask")).toPandas()
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[words["_word"].to_numpy(np.int64)] = words["_mask"].to_numpy(np.int64).astype(np.uint64)
    return table


def _bit(doc: Column) -> list[Column]:
    """Word and mask of an id in the filter."""
    h = F.xxhash64(doc)
    place = F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    return [F.pmod(h, F.lit(FILTER_WORDS)).cast("int").alias("_word"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), place).alias("_mask")]


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose sets, rebuilt in full from the texts, are linked."""
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    table = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for batch in batches:
            word, mask = batch.column("_word").to_numpy(), batch.column("_mask").to_numpy().astype(np.uint64)
            some = batch.filter(pa.array((table.value[word] & mask) != 0))
            for at in range(0, some.num_rows, 500):
                part = some.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array([m.tobytes() for m in s.columns(part.column("text"))],
                                                  pa.binary())], ["doc", "members"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    doc = F.col("doc_id").cast("bigint")
    full = docs.where(doc.isNotNull()).select(doc.alias("doc"), "text", *_bit(doc)) \
        .mapInArrow(lean(sets), "doc bigint, members binary").join(ids, "doc", "left_semi")
    full = materialise(full, "full-sets")
    side = lambda k: full.select(F.col("doc").alias(k), F.col("members").alias(f"m{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(test), "a bigint, b bigint")


def _remaining(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries of columns whose rows lie in different components, with these."""
    own = entries.join(comp.select(F.col("node").alias("doc"), "comp"), "doc", "left") \
        .withColumn("comp", F.coalesce("comp", "doc"))
    mixed = own.groupBy("h").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high")
    return own.join(mixed.select("h"), "h").select("h", "doc", "n", "pos", "comp")


def _cross_pairs(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of a column's rows in different components that pass all bounds, from products of blocks.

    A column's rows are dealt to blocks of about BLOCK_ROWS; a task multiplies two blocks at a time, so
    neither a column nor its pairs are ever rows of one task."""
    blocks = entries.groupBy("h").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_nb"))
    own = entries.join(blocks, "h").withColumn("_b", F.pmod(F.xxhash64("doc"), F.col("_nb")).cast("int"))
    dealt = own.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))) \
        .withColumn("_x", F.least("_b", "_c")).withColumn("_y", F.greatest("_b", "_c")) \
        .join(rows.select("doc", "bits"), "doc")
    ready = dealt.select("h", "_x", "_y", "_b", "doc", "n", "pos", "comp", "bits") \
        .repartition("h", "_x", "_y").sortWithinPartitions("h", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, seen = None, set()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("h", "_x", "_y")])
            edge = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))), batch.num_rows) \
                if batch.num_rows else np.zeros(0, np.int64)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                now = tuple(keys[:, a])
                if now != key:
                    if held:
                        yield from _block_pairs(held, seen)
                    held, key = [], now
                held.append(batch.slice(a, b - a))
        if held:
            yield from _block_pairs(held, seen)

    return ready.mapInArrow(lean(run), "a bigint, b bigint").distinct()


def _folded(bits: list[bytes], width: int) -> dict[int, np.ndarray]:
    """Bitmaps of at least ``width`` bytes, folded to it, by row (others are left out)."""
    return {i: np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8))
            for i, x in enumerate(bits) if width <= len(x) <= 2 * width}


def _block_pairs(held: list[pa.RecordBatch], seen: set) -> Iterator[pa.RecordBatch]:
    """Pairs of one block product; ``seen`` leaves out what the task has found in other columns.

    Sizes within a fifth of each other make bitmaps of one width or of neighbouring ones."""
    t = pa.Table.from_batches(held)
    x, y = t.column("_x")[0].as_py(), t.column("_y")[0].as_py()
    b, doc, n, pos, comp = (t.column(c).to_numpy() for c in ("_b", "doc", "n", "pos", "comp"))
    bits = t.column("bits").to_pylist()
    width = np.array([len(v) for v in bits])
    tables = {}
    for w in set(width.tolist()):
        rows = _folded(bits, w)
        tables[w] = np.zeros((len(bits), w // 8), np.uint64)
        tables[w][list(rows)] = list(rows.values())
    left = np.flatnonzero(b == x)
    right = left if x == y else np.flatnonzero(b == y)
    a_out, b_out = [], []
    for i in left.tolist():
        j = right[right > i] if x == y else right
        j = j[comp[j] != comp[i]]
        lo, hi, both = np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), n[i] + n[j]
        most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        j = j[(100 * lo >= 80 * hi) & (9 * most >= 4 * both)]
        for w in {min(v, int(width[i])) for v in set(width[j].tolist())}:
            k = j[np.minimum(width[j], width[i]) == w]
            apart = np.bitwise_count(tables[w][k] ^ tables[w][i]).sum(1, dtype=np.int64)
            for m in k[apart <= n[i] + n[k] + 2 * (-4 * (n[i] + n[k]) // 9)].tolist():
                pair = (int(min(doc[i], doc[m])), int(max(doc[i], doc[m])))
                if pair not in seen:
                    if len(seen) >= SEEN_PAIRS:
                        seen.clear()
                    seen.add(pair)
                    a_out.append(pair[0]), b_out.append(pair[1])
    if a_out:
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def links_and_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of all rows, classes of equal sets with their smallest doc_id, components of these ids)."""
    both = materialise(_sets(docs), "sets")
    sets = both.where("kind = 0").drop("kind")
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    rows = _rows(docs, classes, _frequent_order(both))
    entries = rows.select("doc", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "doc", "n", "pos")
    rest = materialise(_by_centre(_shared(entries)), "entries")
    links = materialise(_verify(_by_bitmap(_pairs(rest), rows), docs), "links")
    rest = rest.select("h", "doc", "n", "pos")
    for k in range(HUB_ROUNDS + 1):
        comp = components(links)
        rest = materialise(_remaining(rest, comp), "entries")
        size = rest.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(
            F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).agg(
            F.sum("s"), F.sum(F.col("s") * F.col("s") - F.col("q"))).first()
        if not size[0]:
            break
        last = k == HUB_ROUNDS or size[1] / 2 <= PAIRS_PER_ENTRY * size[0]
        if last:
            pairs = _cross_pairs(rest, rows)
        else:
            rest = materialise(_by_centre(_shared(rest)), "entries")
            pairs = _by_bitmap(_pairs(rest.where("comp <> lcomp")), rows)
            rest = rest.select("h", "doc", "n", "pos")
        links = materialise(links.unionByName(_verify(pairs, docs)), "links")
        if last:
            comp = components(links)
            break
    return sets, classes, comp


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (columns doc_id and text)."""
    sets, classes, comp = links_and_classes(docs)
    named = classes.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left") \
        .select("k1", "k2", F.coalesce("comp", "rep").alias("comp"))
    return sets.join(named, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("comp")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) of which each group keeps the one with the smallest id, then the smallest text.

    Rows are linked and chosen by a key of their own, written once, so rows that share an id are judged each by its
    text.  Of a group's rows without an id one stays as well, that with the smallest text."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed-rows")
    found = materialise(jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text")), "components")
    others = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    members = others.unionByName(others.select(F.col("_group").alias("_row"), "_group").distinct())
    best = members.join(rows.select("_row", "doc_id", "text"), "_row") \
        .groupBy("_group", F.col("doc_id").isNull().alias("_no_id")).agg(F.min(F.struct("doc_id", "text", "_row")).alias("_best"))
    gone = members.join(best.select(F.col("_best._row").alias("_row")), "_row", "left_anti").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*[rows[c] for c in docs.columns])
