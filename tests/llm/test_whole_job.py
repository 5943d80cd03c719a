"""Operators do the whole job: cases that shortened versions got wrong."""

from packspark.llm import chat, jaccard, toxicity
from packspark.llm.queries import RANKS, split_pattern, vocabulary
from packspark.llm.tokens import Ranks


def test_shouting_reads_every_character():
    shouts = lambda t: 2 in toxicity.Features([])(t)  # noqa: E731  (the third pattern)
    assert not shouts("This.") and not shouts("Thtion.")
    assert shouts("aBBBBBB" * 20) and not shouts("Bbbbbbb" * 20)
    assert shouts("ÄÖÜ äö") and not shouts("ÄÖ äöü")


def test_encoded_windows_keep_the_budget(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, k, ("user", "assistant")[k % 2], ("ok", "a # <b> \\ c", " x\n", "\n")[k % 4])
                                              for k in range(1, 400)]
    turns += [(2, k, None, (None, "")[k % 2]) for k in range(300)] + [(3, 0, "user", "long " * 200), (3, 1, "user", "ok")]
    docs = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    ranks = Ranks(vocabulary(RANKS), split_pattern())
    made = chat.format_windows(docs, vocabulary(RANKS), split_pattern(), budget=64).collect()
    for w in made:
        assert len(ranks.encode(w.formatted)) == w.n_tokens and (w.n_tokens <= 64 or w.n_new == 1)
    assert sum(w.n_new for w in made) == len(turns) and sum(w.n_tokens > 64 for w in made) == 1
    assert sum(w.conv_id == 2 for w in made) > 10


def test_one_per_group_with_repeated_and_null_ids(spark):
    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    keep = [(1, text("a")), (1, text("b")), (4, None), (4, text("c")), (5, text("d")), (6, text("e")), (None, text("f")),
            (None, text("g"))]
    drop = [(2, text("a") + " more"), (3, text("b")), (5, text("a")), (6, text("e") + " more"), (None, text("f")),
            (None, text("f") + " more")]
    docs = spark.createDataFrame([(*r, "x") for r in drop + keep], "doc_id bigint, text string, lang string")
    left = jaccard.one_per_group(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(
        map(str, spark.createDataFrame(keep, "doc_id bigint, text string").collect()))
