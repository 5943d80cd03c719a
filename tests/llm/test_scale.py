"""Long runs and many matches (secret scan), frequent passages (n-gram join)."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from packspark.llm import jaccard, secrets

B64 = string.ascii_letters + string.digits + "+/"


@pytest.mark.parametrize("n", [100_000, 1_000_000])
def test_a_long_run_is_one_span(spark, n):
    text = "".join(random.Random(n).choices(B64, k=n))
    r = secrets.scan_secrets(spark.createDataFrame([(text,), ("ab" * (n // 2),)], "text string")).select(
        F.size("base").alias("base"), F.transform("secrets", lambda s: s["end"] - s["start"]).alias("sizes")).collect()
    assert r[0].base == 0 and r[0].sizes == [n] and r[1].base == 1 and r[1].sizes == [n]


def test_many_matches_have_exact_offsets(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(["é ", "x", " "]) + "".join(rng.choices("0123456789abcdef", k=rng.randint(14, 20))) + " "
                   for _ in range(100_000))
    r = secrets.scan_secrets(spark.createDataFrame([(text,)], "text string")).select(secrets.span_text(F.col("base")).alias("s")).first()
    assert r.s == ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", text))


def battery(value):
    """(random, prose) p-values of a run, written out; None for decimal runs."""
    if re.fullmatch("[0-9=]+", value):
        return 0.0, 1.0
    alphabet = next(a for _, p, a in secrets.ENCODINGS if not p or re.match(p, value))
    mean0, var0 = secrets._prose(alphabet)
    x = [alphabet.index(c) for c in value if c in alphabet]
    n, size = len(x), len(alphabet)
    chi = sum((x.count(a) - n / size) ** 2 for a in range(size)) * size / n
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1))
    high = [v >= size // 2 for v in x]
    mu = 1 + 2 * sum(high) * (n - sum(high)) / n
    spread = math.sqrt(max(0.0, (mu - 1) * (mu - 2) / (n - 1)))
    z_runs = (1 + sum(a != b for a, b in zip(high, high[1:])) - mu) / spread if spread > 0 else 99.0
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    z_serial = (sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n) if var > 0 else 99.0
    below = lambda z: 1 / (1 + math.exp(min(700, -(1.5976 * z + 0.070565988 * z ** 3))))
    worst = max(abs(z_chi), abs(z_runs), abs(z_serial))
    z_prose = (chi - (size - 1) - (n - 1) * mean0) / math.sqrt(2 * (size - 1) + n * var0)
    return min(1.0, 6 * below(-worst)), below(z_prose)


def test_added_spans_equal_the_battery_written_out(spark):
    rng = random.Random(11)
    words = ["internationalization", "Untersuchungskommissionen", "aaaaaaaaaaaaaaaaaaaaaaaa", "path/to/some/long/file/name", "12345678901234567890123"]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(20, 60)
            parts.append(rng.choice([*words, "".join(rng.choices(B64, k=k)), "".join(rng.choices(string.ascii_lowercase + string.digits, k=k)),
                                     "token=" + "".join(rng.choices(B64, k=k)), "".join(rng.choices("0123456789abcdef", k=k)),
                                     "".join(rng.choices(string.ascii_uppercase + "234567", k=k)) + "=="]))
        texts.append(" und ".join(parts))
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).select(
        "i", "base", "secrets").collect()
    added = 0
    for r in got:
        t = texts[r.i]
        base = [(s.start, s.end) for s in r.base]
        runs = [(m.start(), m.end()) for m in re.finditer(secrets.RUN, t)
                if not any(a < m.end() and m.start() < b for a, b in base)]
        p = [battery(t[a:b]) for a, b in runs]
        want = []
        if runs:
            mean = sum(b - a for a, b in runs) / len(runs)
            weighted = [q[1] * mean / (b - a) for (a, b), q in zip(runs, p)]
            passed = [v for k, v in enumerate(sorted(weighted)) if v <= secrets.FDR * (k + 1) / len(runs)]
            cut = max(passed, default=-1.0)
            want = [x for x, v, q in zip(runs, weighted, p) if v <= cut and q[0] >= secrets.ALPHA]
        assert [(s.start, s.end) for s in r.secrets if s.kind == "random"] == want
        added += len(want)
    assert added > 20


def frequent_texts(n):
    """Each text six of twenty frequent passages in a fixed order, with words of its own between."""
    rng = random.Random(3)
    passages = [" ".join(f"p{k}w{i}" for i in range(120)) for k in range(20)]
    return [(i, " ".join(p for k in sorted(rng.sample(range(20), 6)) for p in (passages[k], f"own{i}x{k}"))) for i in range(n)]


def test_frequent_passages_end_in_few_rounds(spark, monkeypatch):
    texts = frequent_texts(160)
    texts += [(1000 + i, t + " and a tail") for i, t in texts[:20]]
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", 1)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    rounds = []
    usual = jaccard._remaining
    monkeypatch.setattr(jaccard, "_remaining", lambda *a: rounds.append(1) or usual(*a))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(
        spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert len(rounds) <= 3
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    assert got == comp and len(set(comp.values())) < len(ids)
