"""Registered corpus queries against their DuckDB twins or against brute force on the smallest tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from packspark.llm.queries import ORACLES, QUERIES
from packspark.plans.verify import compare

SF = "/root/testdata/sf0.001"

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(got, con, name):
    assert compare(got(name), con.execute(ORACLES[name]()).df()) is None


def test_every_operator_is_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


def test_shards_hold_every_row_with_gapless_slots(got, texts):
    r = got("op2_sharding")
    assert sorted(r.doc_id) == sorted(i for i, _ in texts)
    sizes = r.groupby("shard").size()
    assert set(r["shard"]) == set(range(16)) and sizes.max() - sizes.min() <= 1
    for _, g in r.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    own = {i: ((t or "").encode()) for i, t in texts}
    assert all(x.size == len(own[x.doc_id]) + 1 and x.text_crc32 == zlib.crc32(own[x.doc_id])
               for x in r.rename(columns={"size": "size_"}).assign(size=r["size"]).itertuples())


def test_pieces_equal_the_library(got, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = got("op5_sentencepiece").set_index("doc_id")
    for i, t in texts:
        ids = sp.encode(t or "")
        x = r.loc[i]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256, x.n_bytes) == (
            len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), len((t or "").encode()))


def test_section_tokens_equal_a_token_walk(got, texts):
    import base64

    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    r = got("op6_token_counts")
    own = r.groupby("doc_id")
    for i, t in texts[:60]:
        t = t or ""
        parts = [m.group() for m in re.finditer(r"[^\n]*\n|[^\n]+", t)] or [""]
        want, at, byte = [0] * len(parts), [], 0
        for k, p in enumerate(parts):
            at += [k] * len(p.encode())
        for token in enc.encode_ordinary(t):
            want[at[byte]] += 1
            byte += len(enc.decode_single_token_bytes(token))
        g = own.get_group(i).sort_values("section")
        assert g.n_tokens.tolist() == want
        assert [t[a:b] for a, b in zip(g["start"], g["end"])] == parts


def test_secret_spans_equal_finditer(got, texts):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    r = got("op7_secret_scan").set_index("doc_id")
    for i, t in texts:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds)
                       for m in re.finditer(p, t or "") if len(m[g]) >= n)
        assert r.base_sha256[i] == sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans))
        assert [r[f"n_{k}"][i] for k, *_ in kinds] == [sum(s[1] == j for s in spans) for j in range(3)]
        assert {f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans} <= set(r.spans[i].split(",")) | {""}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """doc_id -> (set size, smallest reachable id), by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in held[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            held[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_equal_all_pairs(got, texts):
    r = got("op8_ngram_jaccard")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in r.itertuples()} == brute_components(texts)


def test_toxicity_held_out_fold_and_accuracy(got):
    r = got("op9_toxicity").set_index("doc_id")
    assert all(bool(r.held_out[i]) == (zlib.crc32(str(i).encode()) % 4 == 2) for i in r.index)
    assert ((r.score >= 0.3) == (r.predicted == 1)).all() and r.score.between(0, 1).all()
    lab = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").df().set_index("doc_id").toxic
    pos, neg = [r.score[i] for i in lab.index[lab == 1]], [r.score[i] for i in lab.index[lab == 0]]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.75


def test_toxicity_on_the_held_out_fold_alone(spark):
    """A fold of 94 labelled rows that no label of was seen (sf0.001 holds out two toxic rows only)."""
    sf = SF.replace("sf0.001", "sf0.01")
    r = QUERIES["op9_toxicity"](spark, sf).where("held_out").toPandas().set_index("doc_id")
    lab = duckdb.sql(f"SELECT doc_id, max(toxic) AS toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").df()
    lab = lab.set_index("doc_id").toxic
    lab = lab[lab.index.isin(r.index)]
    pos, neg = [r.score[i] for i in lab.index[lab == 1]], [r.score[i] for i in lab.index[lab == 0]]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.75
    assert sum(n >= 0.3 for n in neg) <= 0.05 * len(neg) and sum(p >= 0.3 for p in pos) >= 0.6 * len(pos)


def test_toxicity_learns_from_unlabelled_texts(spark):
    """A word that no labelled row holds gets weight from the votes it goes along with: labels only anchor the label model."""
    from packspark.llm import toxicity

    bad, other = ["vile", "scum", "rot"], ["field", "river", "stone", "cloud"]
    rng = random.Random(5)
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choices(other, k=30) + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = {i for i, _, t in rows if t == 0 and i % 40 == 1}                  # clean texts marked toxic by mistake
    marks = spark.createDataFrame([(i, 0, 1 if i in wrong else t) for i, _, t in rows], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in rows if i in held)
    assert all(got[i] < 0.3 for i in wrong)                                    # a row's own label isn't its target


def test_newton_steps_equal_a_plain_fit(spark):
    from packspark.llm import toxicity

    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(" ".join(rng.choice(["a1", "vile", "scum", "rot", "calm"], 6)),) for _ in range(300)], "text string")
    lexicon = [b"vile", b"scum", b"rot"]
    size = toxicity.Features(lexicon).size
    rate = lambda x: np.full(toxicity.VOTERS, x)
    model = toxicity.LabelModel(rate(0.6), rate(0.3), rate(0.5), 0.2)
    patterns = toxicity.vote_patterns(docs, lexicon).cache()
    w = toxicity.fit_logistic(patterns, model, size)
    rows = patterns.collect()
    assert sum(r.n for r in rows) == 300
    x = np.zeros((len(rows), size + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, list(r.features)] = 1
    n = np.array([r.n for r in rows])
    soft = model.posterior(toxicity._bits(np.array([r.mask for r in rows])).astype(float))
    penalty = np.append(np.full(size, 0.05), 1e-6)
    slope = x.T @ (n * (soft - 1 / (1 + np.exp(-x @ w)))) - penalty * w       # the optimum: no slope left
    assert np.abs(slope).max() < 0.01


def test_chat_reads_back(got):
    r = got("op10_chat_formatting").set_index("conv_id")
    said = "\\### Assistant: </turn> ok"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall()
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    seen = 0
    for k, g in itertools.groupby(rows, key=lambda x: x[0]):
        g = list(g)
        loss = "".join(t for _, _, role, t in g if role == "assistant")
        x = r.loc[k]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (
            len(g), sha("".join(f"{role}\n{t}\n" for _, _, role, t in g)), len(loss), sha(loss))
        seen += 1
    assert seen == len(r)


def test_pipeline_equals_its_stages_by_hand(got, spark):
    """Brute-force checks of what the pipeline leaves: one per group, no toxic text, no benchmark window."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    toxic, near, clean, masked = kept
    called = got("op9_toxicity").set_index("doc_id").predicted
    assert set(toxic) == set(called.index[called == 0])
    comp = brute_components([(i, r.text) for i, r in toxic.items()])
    assert set(near) == {i for i, (_, c) in comp.items() if c == i}
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
             for t, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k:k + 10]) for w in items for k in range(len(w) - 9)}
    for r in clean.values():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(ASCII))
        assert not any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))
        assert r.n_chars == len(r.text or "")
    assert any(clean[i].text != near[i].text for i in clean)
    for i, r in masked.items():
        for found in re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)", clean[i].text or ""):
            assert found not in r.text
    assert set(got("pipeline").doc_id) == set(masked) == set(clean)
