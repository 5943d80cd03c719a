"""Subword lattice, centroid clustering and importance resampling against brute force, and their defined results."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packspark.llm import centroids, lattice, resample
from packspark.llm.queries import PIECE_MODEL, vocabulary

from .conftest import SF

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def vocab():
    return lattice.read_vocabulary(vocabulary(PIECE_MODEL))


def cuts(unit, vocab):
    """All segmentations of a unit, as lists of ids."""
    def from_(i):
        if i == len(unit):
            yield []
        for j in range(i + 1, len(unit) + 1):
            k = vocab.pieces.get(unit[i:j])
            if k is not None:
                first = [k]
            elif j == i + 1:
                first = [int(vocab.byte_ids[b]) for b in unit[i:j].encode()]
            else:
                continue
            for rest in from_(j):
                yield first + rest

    return from_(0)


UNITS = ["▁hello", "▁the", "▁Größe", "▁中\U0001F600x", "▁", "▁▁▁a▁", "▁12-a"]


def test_lattice_sums_over_all_segmentations(vocab):
    lat = lattice.Lattice(vocab)
    p = np.exp(vocab.weight)
    want = [math.log(sum(math.prod(p[s]) for s in cuts(u, vocab))) for u in UNITS]
    assert np.allclose(lat.log_probability(UNITS, vocab.weight), want, rtol=1e-12)


def test_expected_counts_are_posterior_means(vocab):
    lat = lattice.Lattice(vocab)
    p = np.exp(vocab.weight)
    want = np.zeros(len(p))
    for u, n in zip(UNITS, range(1, 9)):
        every = list(cuts(u, vocab))
        z = sum(math.prod(p[s]) for s in every)
        for s in every:
            for k in s:
                want[k] += n * math.prod(p[s]) / z
    got = lat.expected(UNITS, np.arange(1, 8), vocab.weight) / lattice.GRID
    assert np.abs(got - want).max() < 1e-4


def test_long_units_go_through_in_windows(vocab, monkeypatch):
    lat = lattice.Lattice(vocab)
    units = ["▁" + "thequickbrown中é" * 30, "▁abc"]
    whole = lat.log_probability(units, vocab.weight)
    monkeypatch.setattr(lattice, "CELLS", 41)
    assert np.allclose(lat.log_probability(units, vocab.weight), whole, rtol=1e-12)


def test_a_round_of_learning_raises_the_likelihood(spark, vocab):
    rows = [(b"hello", 50), (b"help", 30), (b"yellow", 7), (lattice.END, 12)]
    counts = spark.createDataFrame([(bytearray(w), c, c) for w, c in rows], "word binary, c bigint, n bigint")
    lat = lattice.Lattice(vocab)

    def likelihood(logp):
        lp = lat.log_probability([lattice.unit(w) for w, _ in rows[:-1]], logp)
        return lp @ [c for _, c in rows[:-1]] + 12 * logp[vocab.end]

    steps = [likelihood(lattice.fit_weights(counts, vocab, k)) for k in range(4)]
    assert steps[0] < steps[1] < steps[2]
    assert abs(np.exp(lattice.fit_weights(counts, vocab, 2)).sum() - 1) < 1e-9


def brute_base(docs, trains):
    toks = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII)) if w] + [None] for _, t in docs]
    c = Counter(w for ws, use in zip(toks, trains) if use for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in toks]


def test_text_scores_equal_brute_force(got, texts, vocab, spark):
    folds = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]
    r = got("op11_lm_scoring").set_index("doc_id")
    for (i, _), use, (n, known, total, base) in zip(texts, folds, brute_base(texts, folds)):
        x = r.loc[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not use, n, known, total)
        assert abs(x.base_score - base) < 1e-9 * max(1, -base)
    # the score is the product of the units' lattice probabilities under the fitted weights
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = lattice.count_words(docs, "text", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).cache()
    logp = lattice.fit_weights(counts, vocab, lattice.ROUNDS)
    lat = lattice.Lattice(vocab)
    for i, t in texts[:40]:
        ws = lattice.words((t or "").encode())
        want = (lat.log_probability([lattice.unit(w) for w in ws], logp).sum() + logp[vocab.end]) / math.log(10)
        assert abs(r.score[i] - want) < 1e-9 * max(1, -want)


def test_frequent_table_changes_no_score(odd, monkeypatch):
    def scores():
        out = lattice.score_texts(odd, vocabulary(PIECE_MODEL), F.col("doc_id") != 5)
        return sorted(out.drop("text").toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False), key=repr)

    usual = scores()
    monkeypatch.setattr(lattice, "FREQUENT", 2)
    for a, b in zip(usual, scores()):
        assert a[:-2] == b[:-2] and np.allclose(a[-2:], b[-2:], rtol=1e-9)


def test_lm_defined_results(odd, none):
    out = lattice.score_texts(odd, vocabulary(PIECE_MODEL), F.col("doc_id") != 5)
    assert set(odd.columns) | set(lattice.ADDED) == set(out.columns)
    r = out.toPandas()
    assert len(r) == odd.count() and (r[r.text.isna() | (r.text == "")].n_tokens == 1).all()
    same = r[(r.doc_id == 4)]
    assert len(same) == 2 and same.score.nunique() == 1
    assert r[r.doc_id == 5].n_tokens.item() == 30001 and r.score.notna().all()
    assert lattice.score_texts(none, vocabulary(PIECE_MODEL), F.lit(True)).count() == 0
    untrained = lattice.score_texts(odd, vocabulary(PIECE_MODEL), F.lit(False)).toPandas()
    assert (untrained.train_tokens == 0).all() and (untrained.base_score == 0).all() and (untrained.score < 0).all()


def test_distances_equal_the_plain_formula():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-90, 90, (50, 7)), rng.integers(-90, 90, (4, 7))
    assert (centroids.distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(2)).all()


def brute_clusters(rows, k, rounds, seed=1):
    q = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows}
    cs = [q[i] for i in sorted(q, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cs)), key=lambda j: (dist(v, cs[j]), j))
    for _ in range(rounds):
        own = {}
        for v in q.values():
            own.setdefault(near(v), []).append(v)
        cs = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else c for j, c in enumerate(cs)]
    return {i: (near(v), dist(v, cs[near(v)])) for i, v in q.items()}, cs


def test_clusters_equal_brute_force(spark, got):
    rows = [tuple(r) for r in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()]
    want, cs = brute_clusters(rows, 16, 3)
    r = got("op12_centroid_clustering")
    assert {x.vec_id: (x.cluster, x.distance) for x in r.itertuples()} == want
    assert (r.inertia == sum(d for _, d in want.values())).all()
    for c, g in r.groupby("cluster"):
        assert (g.cluster_inertia == g.distance.sum()).all()
        assert (g.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()).all()


def test_clustering_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.1], "a"), (1, [0.0, 0.1], "a"), (None, [5.0, -5.0], "b"), (2, None, "c"), (3, [1.0], "d"), (4, [nan, 0.0], "e"),
            (5, [0.0, -inf], "f"), (6, [None, 0.0], "g"), (7, [1e300, -1e300], "h"), (8, [0.0, 0.1], "i")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster string")
    r = centroids.cluster(df, dims=2, clusters=3, rounds=2).toPandas()
    assert len(r) == 5 and list(r.columns) == ["vec_id", *centroids.ADDED]
    assert r[r.vec_id.isin([1, 8])].cluster.nunique() == 1
    assert centroids.cluster(df.limit(0), dims=2).count() == 0
    few = centroids.cluster(df.where("vec_id = 1"), dims=2).toPandas()
    assert len(few) == 2 and (few.distance == 0).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_grams(t, orders):
    w = WORD.findall((t or "").translate(ASCII))
    return [" ".join(w[i:i + n]) for n in orders for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("orders", [range(1, 2), range(1, 4), range(2, 3)])
def test_grams_equal_brute_force(orders):
    rng = np.random.default_rng(5)
    some = [None, "", "One", "  a b a b a b", "a", "ünï-a ünï A B", "x" * 10, "1 2 3"] + [
        " ".join(rng.choice(["a", "b", "Cé", "d1"], rng.integers(0, 9))) + "." for _ in range(60)]
    g = resample.Grams(pa.array(some), orders, 997)
    gains = rng.integers(-500, 500, 997)
    bucket = lambda x: zlib.crc32(x.encode()) % 997
    own = [[bucket(x) for x in brute_grams(t, orders)] for t in some]
    assert sum(g.lengths).tolist() == [len(o) for o in own]
    assert g.sums(gains).tolist() == [int(gains[o].sum()) if o else 0 for o in own]
    assert (g.counts(997) == np.bincount(list(itertools.chain(*own)), minlength=997)).all()


def test_drawn_documents_equal_brute_force(got, texts, con):
    own = {i: [zlib.crc32(x.encode()) % 10_000 for x in brute_grams(t, range(1, 2))] for i, t in texts}
    s = Counter(itertools.chain(*own.values()))
    t = Counter(zlib.crc32(x.encode()) % 10_000 for (b,) in con.execute("SELECT text FROM benchmark").fetchall()
                for x in brute_grams(b, range(1, 2)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    want = {}
    for i, o in own.items():
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in o)
        want[i] = [len(o), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in want if want[i][0] >= 20), key=lambda i: (-want[i][2], i))
    for k, i in enumerate(able[:10 * len(able) // 100]):
        want[i][3] = k + 1
    r = got("op13_importance_resampling")
    assert {x.doc_id: [x.n_features, x.weight, x.score, None if math.isnan(x.rank) else int(x.rank)] for x in r.itertuples()} == want


def test_resampling_defined_results(spark, odd, none):
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    r = resample.resample(odd, target, percent=50, min_words=1, max_n=2).toPandas()
    assert len(r) == odd.count() and set(odd.columns) - {"n_words"} <= set(r.columns)
    empty = r[r.text.isna() | (r.text == "")]
    assert (empty.n_features == 0).all() and (empty.weight == 0).all() and empty["rank"].isna().all()
    able = (r.n_words >= 1).sum()
    assert sorted(r["rank"].dropna()) == list(range(1, able // 2 + 1))
    assert resample.resample(none, target).count() == 0
    assert resample.resample(odd, none, min_words=1).count() == odd.count()
