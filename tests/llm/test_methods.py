"""The methods themselves against brute force on generated inputs."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packspark.llm import decontaminate as D
from packspark.llm import jaccard as J
from packspark.llm.graph import components
from packspark.llm.pieces import CharMap, Encoder
from packspark.llm.queries import PIECE_MODEL, vocabulary

from .test_queries import brute_components

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5), WORDS, st.integers(1, 5))
def test_automaton_finds_every_window(items, doc, window):
    auto = D.Automaton([(str(i), w) for i, w in enumerate(items)], window)
    spans, names, longest = auto.match(doc)
    hit, want = set(), set()
    for i, w in enumerate(items):
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for p in range(len(doc) - m + 1):
                if doc[p:p + m] == w[k:k + m]:
                    hit.update(range(p, p + m))
                    want.add(str(i))
    assert {p for a, b in spans for p in range(a, b)} == hit and names == want
    if hit:
        best = max(n for n in range(1, 31) if any(doc[p:p + n] == w[k:k + n] for w in items
                   for p in range(len(doc) - n + 1) for k in range(len(w) - n + 1)))
        assert longest == best


def test_benchmark_in_blocks_equals_one_block(spark, monkeypatch):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs = spark.createDataFrame([(i, text(60)) for i in range(30)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, text(8)) for i in range(40)], "item_id bigint, text string")
    one = sorted(map(str, D.scan(docs, bench, 4).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    assert sum(1 for _ in D._blocks(bench)) > 2
    assert sorted(map(str, D.scan(docs, bench, 4).collect())) == one


def near_copies(seed):
    """Groups of exact and near copies, chains whose ends don't link, common passages and hot lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    passage = [word() for _ in range(25)]
    out = []
    for size, n in ((24, 40), (5, 30), (2, 80), (12, 12)):
        base = [word() for _ in range(n)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(n)] = word()
            out.append(w)
    chain = [word() for _ in range(120)]
    for _ in range(25):                                  # drifts: neighbours link, the ends don't
        out.append(list(chain))
        at = r.randrange(120)
        chain[at] = word()
        chain = chain[2:] + [word(), word()]
    for _ in range(60):
        w = [word() for _ in range(r.randrange(1, 60))]
        k = r.randrange(len(w) + 1)
        out.append(w[:k] + passage + w[k:])
    out += [out[0], out[3], out[3], ["One"], ["one"], ["a", "b"], []]
    r.shuffle(out)
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("block_rows, pairs", [(1000, 1000), (7, 4)])
def test_components_of_near_copies(spark, monkeypatch, block_rows, pairs):
    rows = near_copies(11)
    monkeypatch.setattr(J, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(J, "PAIRS_PER_ENTRY", pairs)
    monkeypatch.setattr(J, "FREQUENT_IN_CHUNK", 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=90), st.sets(st.integers(0, 2 ** 64 - 1), max_size=20),
       st.integers(0, 20))
def test_bounds_never_lose_a_link(base, more, drop):
    import numpy as np

    a, b = np.array(sorted(base), np.uint64), np.array(sorted(set(list(base)[drop:]) | more), np.uint64)
    if not len(b):
        return
    common = len(set(a.tolist()) & set(b.tolist()))
    true = 100 * common >= 80 * (len(a) + len(b) - common)
    assert J.linked(a, b) == true
    if true:
        assert J.may_link(len(a), J.bitmap(a), len(b), J.bitmap(b))
        frequent = np.sort(a[::3])
        rank = np.arange(len(frequent))[::-1]
        assert set(J.ordered_prefix(a, frequent, rank).tolist()) & set(J.ordered_prefix(b, frequent, rank).tolist())


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    r = random.Random(2)
    texts = ["  ".join(r.choice(["Ab", "ünï", "x", "long" * 30]) for _ in range(r.randrange(0, 400))) for _ in range(30)] + [None, "\n"]
    whole = [m.tolist() for m in J.Shingler().columns(pa.array(texts))]
    monkeypatch.setattr(J, "CHUNK_BYTES", 64)
    assert [m.tolist() for m in J.Shingler().columns(pa.array(texts))] == whole


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 1)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}


def char_map(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map: a double-array trie over the keys, then the zero-ended targets."""
    targets, place = b"", {}
    for v in rules.values():
        if v not in place:
            place[v] = len(targets)
            targets += v + b"\0"
    size = 4096
    units, used = [0] * size, {0}
    children = lambda p: sorted({k[len(p)] for k in rules if len(k) > len(p) and k.startswith(p)})

    def build(prefix: bytes, node: int) -> None:
        labels = children(prefix)
        codes = ([0] if prefix in rules else []) + labels
        base = next(o for o in range(1, size - 256) if all((node ^ o ^ c) not in used for c in codes))
        units[node] |= base << 10
        if prefix in rules:
            units[node] |= 1 << 8
        at = {c: node ^ base ^ c for c in codes}
        used.update(at.values())
        if prefix in rules:
            units[at[0]] = (1 << 31) | place[rules[prefix]]
        for c in labels:
            units[at[c]] = c
        for c in labels:
            build(prefix + bytes([c]), at[c])

    build(b"", 0)
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *units) + targets


RULES = {k.encode(): v.encode() for k, v in {"A": "a", "AB": "xy", "ABC": "", "é": "e", "ﬁ": "fi", "\t": " ", "　": " ",
                                              "“": '"', "…": "..."}.items()}


def patched(squeeze: bool, prefix: bool) -> bytes:
    """The public model with another normaliser: a character map, and white space squeezed or not."""
    from packspark.llm.pieces import _fields

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    blob = char_map(RULES)
    spec = b"\x0a\x03own\x12" + varint(len(blob)) + blob + bytes([0x18, prefix, 0x20, squeeze, 0x28, 1])
    rest = b"".join(raw for n, _, raw in _fields(vocabulary(PIECE_MODEL)) if n != 3)
    return rest + b"\x1a" + varint(len(spec)) + spec


def test_longest_prefix_of_the_character_map():
    m = CharMap(char_map(RULES))
    assert m.longest(b"ABD", 0) == (2, b"xy") and m.longest(b"ABC", 0) == (3, b"") and m.longest(b"AC", 0) == (1, b"a")
    assert m.longest(b"b", 0) is None and CharMap(b"").longest(b"A", 0) is None


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_normalised_encoding_equals_the_library(squeeze, prefix):
    import sentencepiece

    model = patched(squeeze, prefix)
    own, library = Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(4)
    texts = ["", " ", "   ", "ABC", " ABC x", "A  B\tC", "café “ﬁne”… ", "　　x　"] + [
        "".join(r.choice(["A", "B", "C", " ", "  ", "é", "ﬁ", "\t", "z", "…", "\n", "中", "▁"]) for _ in range(r.randrange(0, 25)))
        for _ in range(400)]
    for t in texts:
        ids, shown, starts, ends = own.encode(t)
        assert ids == library.encode(t), t
        assert shown == ",".join(map(str, ids))
        n = len(t.encode())
        assert all(0 <= a <= b <= n for a, b in zip(starts, ends)) and all(starts[i] <= starts[i + 1] for i in range(len(ids) - 1))


def test_jaccard_workers_hold_little_beside_their_members():
    import tracemalloc
    rng = np.random.default_rng(5)
    rare = rng.integers(0, 1 << 63, (300, 1000), dtype=np.uint64)
    sets = {i: np.unique(np.append(m, np.arange(i % 40, dtype=np.uint64))) for i, m in enumerate(rare)}
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    texts = pa.array([" ".join(map(str, m)) for m in rare[:150]])
    tracemalloc.start()
    got = list(J._frequent(sets))[0]
    held = tracemalloc.get_traced_memory()[1] / counts.sum() / 8
    tracemalloc.reset_peak()
    n = [len(m) for m in J.Shingler().columns(texts)]
    hashing = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got.column("k1").to_numpy().astype(np.uint64), values[counts >= J.FREQUENT_IN_CHUNK])
    assert np.array_equal(got.column("n").to_numpy(), counts[counts >= J.FREQUENT_IN_CHUNK])
    assert held < 2 and hashing < 16e6 and n == [996] * 150
    assert [b.num_rows for b in J._frequent({0: np.arange(3, dtype=np.uint64)})] == [0] and not list(J._frequent({}))
