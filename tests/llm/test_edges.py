"""Null, empty, very long, repeated and id-less rows, clashing columns and empty tables, per operator."""

import numpy as np
from pyspark.sql import functions as F

from packspark.llm import chat, decontaminate, jaccard, pieces, pii, quality, secrets, sharding, tokens, toxicity
from packspark.llm.queries import PIECE_MODEL, RANKS, split_pattern, vocabulary

from .conftest import ODD

N = len(ODD)
HIT = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_quality(odd, none):
    r = rows(quality.quality(odd))
    assert len(r) == N and {"lang", "n_words", "kept"} <= set(r[0])
    by = {x["text"]: x for x in r}
    assert by[None]["n_words"] == 0 and by[None]["base_failed"] and not by[None]["kept"]
    assert by["x " * 30000]["n_words"] == by["x " * 30000]["n_repeat_words"] == 30000
    assert by["line\n\nline\nline \t end"]["n_dup_lines"] == 1
    assert quality.quality(none).count() == 0


def test_sharding(odd, none, spark):
    r = rows(sharding.shard_rows(odd.withColumn("slot", F.lit("x")), ["doc_id", "text"], 4, "k"))
    assert sorted(x["row_number"] for x in r) == sorted(x["position"] for x in r) == list(range(N))
    assert sharding.shard_rows(none, ["doc_id"], 4, "k").count() == 0
    one = [sharding.locate(x["shard"], x["slot"], N, 4, "k") for x in r]
    assert one == [x["row_number"] for x in r]


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 5, 64, 1000, 1025):
        p = sharding.permute(np.arange(n), n, "k")
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, "k", inverse=True).tolist() == list(range(n))
    assert sharding.permute(np.arange(1000), 1000, "a").tolist() != sharding.permute(np.arange(1000), 1000, "b").tolist()


def test_shards_are_written_whole(odd, spark, tmp_path):
    sharding.write_shards(sharding.shard_rows(odd, ["doc_id", "text"], 3, "k"), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == N and back.select("shard", "slot").distinct().count() == N


def test_decontamination(odd, none, spark):
    bench = spark.createDataFrame([(1, HIT), (2, "Word"), (3, None), (4, ""), (None, "no such item")], "item_id bigint, text string")
    found = rows(decontaminate.scan(odd, bench))
    r = {(x["doc_id"], x["lang"]): x for x in found}
    assert len(found) == N and r[(3, "c")]["items"] == ["2"] and r[(1, "a")]["n_words"] == 0
    assert decontaminate.scan(none, bench).count() == 0
    assert all(x["items"] == [] for x in rows(decontaminate.scan(odd, bench.limit(0))))
    docs = spark.createDataFrame([(1, f"Before it, {HIT.upper()}; after it comes more text of its own, and more still.", 5),
                                  (2, HIT, 5), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    left = {x["doc_id"]: x for x in rows(decontaminate.decontaminate(docs, bench, max_coverage=0.6))}
    assert set(left) == {1, 3} and left[1]["n_chars"] == len(left[1]["text"])
    assert left[1]["text"] == "Before it, …; after it comes more text of its own, and more still."


def test_pii(odd, none, spark):
    extra = odd.withColumn("n_mail", F.lit("x"))
    r = rows(pii.pseudonymise(extra))
    assert len(r) == N and sorted(str(x["text"]) for x in r) == sorted(str(x[1]) for x in ODD)
    assert all(x["n_mail"] == 0 for x in r) and pii.pseudonymise(none).count() == 0
    values = ["4111111111111111", "4111 1111 1111 1111", "+1 (415) 555-2671", "415-555-2671", "123-45-6789", "10.0.0.255",
              "1984-02-29", "29.02.1984", "GB82WEST12345698765432", "ann.b@mail.example.com"]
    t = spark.createDataFrame([(" ".join(values) + " 2024-13-01 300.1.1.1 GB83WEST12345698765432",), (values[0],)], "text string")
    out = pii.pseudonymise(t)
    one, two = (x["text"] for x in rows(out))
    assert two == one.split()[0] and sum(rows(out)[0][f"n_{k}"] for k in pii.KINDS) == len(values)
    assert one.endswith("2024-13-01 300.1.1.1 GB83WEST12345698765432") and not any(v in one for v in values)
    assert _luhn_ok(two) and _luhn_ok("".join(one.split()[1:5]))
    assert [x["text"] for x in rows(pii.pseudonymise(out.select("text"), reverse=True))] == [x["text"] for x in rows(t)]
    assert rows(pii.pseudonymise(t, key="other"))[1]["text"] != two


def _luhn_ok(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pieces(odd, none):
    model = vocabulary(PIECE_MODEL)
    r = rows(pieces.decode(pieces.encode(odd, model), model))
    assert len(r) == N and all(x["decoded"] == (x["text"] or "") for x in r)
    for x in r:
        b, spans = (x["text"] or "").encode(), list(zip(x["starts"], x["ends"]))
        assert b"".join(b[i:j] for i, j in spans) == b
    assert pieces.encode(none, model).count() == pieces.digest(none, model).count() == 0


def test_tokens(odd, none):
    r = rows(tokens.section_tokens(odd.withColumn("section", F.lit("x")), vocabulary(RANKS), split_pattern()))
    assert sum(x["lang"] == "f" for x in r) == 4 and [x["n_tokens"] for x in r if x["lang"] == "a"] == [0]
    assert tokens.section_tokens(none, vocabulary(RANKS), split_pattern()).count() == 0


def test_boundary_rules():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 9])
    got = {rule: tokens.attribute(starts, ends, bounds, rule)[0].tolist() for rule in tokens.RULES}
    assert got == {"first": [2, 1], "last": [1, 2], "most": [1, 2]}
    assert tokens.attribute(starts, ends, bounds, "first")[1].tolist() == [1, 0]


def test_secrets(odd, none, spark):
    r = rows(secrets.scan_secrets(odd.withColumn("base", F.lit("x"))))
    assert len(r) == N and all(x["base"] == [] and x["secrets"] == [] for x in r)
    assert secrets.scan_secrets(none).count() == 0
    rng = np.random.default_rng(5)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(alphabet, 48)) for _ in range(20)]
    prose = ["Internationalisierungsbestrebungen", "the_quick_brown_fox_jumps_over_it", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "12345678901234567890123", "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"]
    t = spark.createDataFrame([(f"see {k} there",) for k in keys + prose], "text string")
    found = [sum(s["kind"] == "random" for s in x["secrets"]) for x in secrets.scan_secrets(t).collect()]
    assert sum(found[:20]) >= 18 and sum(found[20:]) == 0
    short = secrets.scan_secrets(spark.createDataFrame([("token=abc token=abcdefghijkl",)], "text string")).first()
    assert [(s["start"], s["end"]) for s in short["base"]] == [(10, 28)]


def test_jaccard(odd, none):
    r = rows(jaccard.jaccard_components(odd))
    assert len(r) == N
    assert sorted((x["doc_id"] or 0, x["component_id"]) for x in r) == [
        (0, 4), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert jaccard.jaccard_components(none).count() == 0
    left = rows(jaccard.one_per_group(odd))
    assert sorted(x["doc_id"] or 0 for x in left) == [0, 1, 2, 3, 4, 5, 6, 7] and set(left[0]) == set(odd.columns)


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    r = rows(toxicity.score(odd.withColumn("score", F.lit("x")), model))
    assert len(r) == N and len({x["score"] for x in r}) == 1 and 0 <= r[0]["score"] <= 1
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    docs = spark.createDataFrame([(i, f"some words {i} here" + " vilest" * (i % 4 == 0)) for i in range(400)] + [(None, "vilest")],
                                 "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(8, 0, None), (None, 0, 0)],
                                  "doc_id bigint, quality int, toxic int")
    r = rows(toxicity.score(docs, toxicity.fit(docs, marks)))
    assert all(x["predicted"] == int("vilest" in x["text"]) for x in r)


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, window string"
    turns = spark.createDataFrame([(1, 0, "system", "be # <brief> \\", "w"), (1, 1, "user", None, "w"), (1, 2, None, "x", "w"),
                                   (1, 2, "assistant", "### a: </turn>\n", "w"), (1, None, "user", "first", "w"),
                                   (None, 0, "user", "no id", "w"), (2, 0, "assistant", "again", "w"),
                                   (2, 0, "assistant", "again", "w")], schema)
    windows = chat.format_windows(turns, vocabulary(RANKS), split_pattern()).cache()
    r = {x["conv_id"]: x for x in rows(chat.read_back(windows))}
    assert {k: x["n_turns"] for k, x in r.items()} == {None: 1, 1: 5, 2: 2} and r[2]["loss_chars"] == 10
    texts = [t for x in windows.where("conv_id = 1").collect() for t in chat.read_turns(x["formatted"])]
    assert texts == [("user", "first"), ("system", "be # <brief> \\"), ("user", ""), ("", "x"), ("assistant", "### a: </turn>\n")]
    assert chat.read_back(chat.format_windows(turns.limit(0), vocabulary(RANKS), split_pattern())).count() == 0


def test_windows_keep_the_budget():
    rng = np.random.default_rng(3)
    turns = [("system", "s", 20)] + [(("user", "assistant")[i % 2], f"t{i}", int(rng.integers(1, 90))) for i in range(300)] \
        + [("user", "long", 900)]
    w = chat.Windows(128, 4, 32)
    made = [x for t in turns for x in w.add(*t)] + list(w.end())
    new = []
    for k, (window, n_context, n_new, used, formatted, loss) in enumerate(made):
        got = list(chat.read_turns(formatted))
        assert window == k and len(got) == n_context + n_new and (k == 0 or got[0] == ("system", "s"))
        assert used <= 128 or n_new == 1
        assert [formatted[a:b] for a, b in loss] == [t for role, t in got[n_context:] if role == "assistant"]
        assert n_context <= 5 and got[(1 if n_context and k else 0):n_context] == new[len(new) - max(0, n_context - 1):]
        new += got[n_context:]
    assert new == [t[:2] for t in turns]
