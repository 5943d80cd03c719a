"""Secret scans: patterns, and a battery of randomness tests on long character runs.

``pattern_spans`` finds three kinds of secrets by pattern.  ``random_spans`` takes every other run
of 20 or more token characters, infers its encoding (the smallest alphabet that holds it) and tests
it: chi-squared against a uniform alphabet, runs about the middle of the alphabet, and lag-1
serial correlation.  A run is a secret if (a) the battery doesn't reject randomness (Bonferroni
over the three tests) and (b) its chi-squared is too small for written text.  (b) is a p-value under
the letter frequencies of prose; short runs have little power, so the document's p-values pass a
false-discovery control (Benjamini-Hochberg) with weights in proportion to length.

Only built-in column functions.  Offsets come from cutting the text at the matches: a span starts
after the gaps and matches before it.

Defined results: null and empty texts have no spans; spans count code points, end exclusive; runs that
overlap a pattern span are not tested; texts, runs and numbers of matches of any size are scanned whole; decimal runs carry no evidence and are never reported; equal
rows get equal results; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import let

# kind, pattern, group whose length counts, least length.  Hex and access runs end where their class
# ends, so the least length can stand in the pattern; an assignment below its length still uses up its text.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHA = 0.01    # level of the randomness battery
FDR = 0.01      # false-discovery rate of the report

# Letter frequencies of written text, in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0,
           2.4, 0.2, 2.0, 0.1)
_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
# encodings in the order of inference: the first whose alphabet holds the run
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _D + "abcdef"), ("HEX", "^[0-9A-F]+$", _D + "ABCDEF"), ("lower", "^[a-z]+$", _L),
    ("upper", "^[A-Z]+$", _U), ("base32", "^[A-Z2-7]+=*$", _U + "234567"), ("base36", "^[a-z0-9]+$", _D + _L),
    ("BASE36", "^[A-Z0-9]+$", _D + _U), ("base62", "^[A-Za-z0-9]+$", _D + _U + _L),
    ("base64", "^[A-Za-z0-9+/]+=*$", _U + _L + _D + "+/"), ("base64url", "^[A-Za-z0-9_-]+=*$", _U + _L + _D + "_-"),
    ("tokens", "", _U + _L + _D + "+/_-="),
)


def _prose(alphabet: str) -> tuple[float, float]:
    """Mean and variance per character of the chi-squared statistic for prose written in an alphabet."""
    seen = [f for c, f in zip(_L, LETTERS) if c in alphabet or c.upper() in alphabet]
    q = [f / sum(seen) for f in seen]
    q2, q3, size = sum(x * x for x in q), sum(x ** 3 for x in q), len(alphabet)
    return size * q2 - 1, 4 * size * size * (q3 - q2 * q2)


def running(values: Column, merge) -> Column:
    """For each place of an array of ints, ``merge`` of all values before it, from 0 on.

    In stretches of about the square root of the length: a fold that grows an array copies it at every
    step, so stretches are folded first, then their results, and the work grows as n^1.5."""
    def fold(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)).cast("array<int>"),
                           lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def cut(xs: Column) -> Column:
        m = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(xs), m), lambda at: fold(F.slice(xs, at, m)))

    def join(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, o: F.transform(
            F.slice(p, 1, F.size(p) - 1), lambda v: merge(o, v))))

    return F.when(F.size(values) > 0, let(let(values, cut), join)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has at least ``least`` characters."""
    def place(parts: Column) -> Column:
        before = running(F.transform(parts, lambda x: x["gap"] + F.length(x["whole"])), lambda a, b: a + b)

        def span(x: Column) -> Column:
            start = x["before"] + x["p"]["gap"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["p"]["whole"])).alias("end"),
                            F.lit(kind).alias("kind"), x["p"]["whole"].alias("value"))

        long = F.filter(F.arrays_zip(parts.alias("p"), before.alias("before")), lambda x: x["p"]["n"] >= least)
        return F.transform(long, span)

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.length(g))
    parts = F.arrays_zip(whole.alias("whole"), lengths.alias("n"), gaps.alias("gap"))
    parts = F.filter(parts, lambda x: x["whole"].isNotNull())     # the gap after the last match has none
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), let(parts, place)).otherwise(empty)


def _apart(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of ``taken``: one sweep over the ends of the first and the starts of the second, with
    the furthest end so far."""
    events = F.sort_array(F.concat(
        F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("reach"), s.alias("span"))),
        F.transform(taken, lambda b: F.struct(b["start"].alias("at"), b["end"].alias("reach"),
                                              F.get(spans, -1).alias("span")))))

    def sweep(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        free = F.filter(F.arrays_zip(events.alias("e"), reach.alias("reach")),
                        lambda x: x["e"]["span"].isNotNull() & (x["reach"] <= x["e"]["span"]["start"]))
        return F.transform(free, lambda x: x["e"]["span"])

    return let(events, sweep)


def _below(z: Column) -> Column:
    """Chance that a standard normal is below z (logistic approximation, error under 0.0002)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565988 * z * z * z)))


def _encoding(value: Column) -> Column:
    """The inferred encoding: alphabet, its size, and the prose law of its chi-squared; null for decimal runs."""
    out = F.when(value.rlike("^[0-9=]+$"), F.lit(None))
    for _, pattern, alphabet in ENCODINGS:
        mean0, var0 = _prose(alphabet)
        e = F.struct(F.lit(alphabet).alias("alphabet"), F.lit(len(alphabet)).alias("size"),
                     F.lit(mean0).alias("mean0"), F.lit(var0).alias("var0"))
        out = out.when(value.rlike(pattern), e) if pattern else out.otherwise(e)
    return out


def _numbers(value: Column, alphabet: Column) -> Column:
    """Positions of the characters in the alphabet; padding outside it is left out."""
    return F.filter(F.transform(F.split(value, ""), lambda c: F.when(c == "", -1).otherwise(F.instr(alphabet, c) - 1)),
                    lambda v: v >= 0)


def _battery(x: Column, e: Column) -> Column:
    """struct(random: p-value of randomness, prose: p-value of written text) of one run of alphabet positions."""
    size, half, n = e["size"], F.floor(e["size"] / 2), F.size(x)
    # sum of squared counts: over the sorted positions, the k-th of a symbol adds 2k - 1
    square = F.aggregate(F.sort_array(x), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("k"), F.lit(0.0).alias("sum")),
                         lambda acc, v: let(F.when(acc["last"] == v, acc["k"] + 1).otherwise(1), lambda k: F.struct(
                             v.cast("int").alias("last"), k.alias("k"), (acc["sum"] + 2.0 * k - 1.0).alias("sum"))))["sum"]
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("runs"), F.lit(0).alias("high"),
                    *[F.lit(0.0).alias(k) for k in ("s", "ss", "sp")])

    def step(acc: Column, v: Column) -> Column:
        side = v >= half
        fresh = (acc["last"] < 0) | ((acc["last"] >= half) != side)
        return F.struct(v.cast("int").alias("last"), (acc["runs"] + fresh.cast("int")).alias("runs"),
                        (acc["high"] + side.cast("int")).alias("high"), (acc["s"] + v).alias("s"),
                        (acc["ss"] + v * v).alias("ss"),
                        (acc["sp"] + F.when(acc["last"] >= 0, acc["last"] * v).otherwise(0)).alias("sp"))

    def finish(t: Column) -> Column:
        w = t["w"]
        chi = t["sq"] * size / n - n
        z_chi = (chi - (size - 1)) / F.sqrt(2.0 * (size - 1))
        high = w["high"].cast("double")                # the product passes 32 bits in a long run
        mu = 1 + 2 * high * (n - high) / n
        spread = F.sqrt((mu - 1) * (mu - 2) / (n - 1))
        z_runs = F.when(spread > 0, (w["runs"] - mu) / spread).otherwise(99.0)
        m = w["s"] / n
        var = w["ss"] - n * m * m
        cov = w["sp"] - m * (2 * w["s"] - F.get(x, 0) - F.get(x, n - 1)) + (n - 1) * m * m
        z_serial = F.when(var > 0, (cov / var + 1 / n) * F.sqrt(n)).otherwise(99.0)
        worst = F.greatest(F.abs(z_chi), F.abs(z_runs), F.abs(z_serial))
        z_prose = (chi - (size - 1) - (n - 1) * e["mean0"]) / F.sqrt(2 * (size - 1) + n * e["var0"])
        return F.struct(F.least(F.lit(1.0), 6 * _below(-worst)).alias("random"), _below(z_prose).alias("prose"))

    return let(F.struct(F.aggregate(x, zero, step).alias("w"), square.alias("sq")), finish)


def _tested(span: Column) -> Column:
    none = F.struct(F.lit(0.0).alias("random"), F.lit(1.0).alias("prose"))
    p = let(_encoding(span["value"]), lambda e: F.when(e.isNull(), none).otherwise(
        let(_numbers(span["value"], e["alphabet"]), lambda x: F.when(F.size(x) < 2, none).otherwise(_battery(x, e)))))
    return F.struct(span.alias("span"), p.alias("p"))


def _discoveries(tested: Column) -> Column:
    """The spans that pass the weighted Benjamini-Hochberg step of one document."""
    m = F.size(tested)
    total = F.aggregate(tested, F.lit(0).cast("long"), lambda acc, x: acc + x["span"]["end"] - x["span"]["start"])

    def weigh(mean: Column) -> Column:
        return F.transform(tested, lambda x: F.struct(
            (x["p"]["prose"] * mean / (x["span"]["end"] - x["span"]["start"])).alias("p"), x["p"]["random"].alias("random"),
            x["span"].alias("span")))

    def step_up(weighted: Column) -> Column:
        ordered = F.sort_array(F.transform(weighted, lambda x: x["p"]))
        passed = F.filter(ordered, lambda p, i: p <= FDR * (i + 1) / F.size(weighted))
        return let(F.coalesce(F.array_max(passed), F.lit(-1.0)), lambda cut: F.transform(
            F.filter(weighted, lambda x: (x["p"] <= cut) & (x["random"] >= ALPHA)), lambda x: x["span"]))

    return F.when(m > 0, let(total / m, lambda mean: let(weigh(mean), step_up)))


def pattern_spans(text: Column) -> Column:
    """Pattern spans of all KINDS by start, then kind."""
    return F.sort_array(F.concat(*[spans_of(text, p, k, i, g, n) for i, (k, p, g, n) in enumerate(KINDS)]))


def random_spans(text: Column, taken: Column) -> Column:
    """Spans of runs that look random, apart from what ``taken`` covers."""
    runs = spans_of(text, RUN, "random", len(KINDS))
    free = let(F.struct(runs.alias("runs"), taken.alias("taken")), lambda x: _apart(x["runs"], x["taken"]))
    return F.when(text.rlike(RUN), let(F.transform(free, _tested), _discoveries))


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (pattern spans) and ``secrets`` (all spans), arrays of (start, rank, end, kind, value)."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("base", "secrets")]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = df.select(*keep, pattern_spans(t).alias("base"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    more = F.coalesce(random_spans(t, F.col("base")), F.slice("base", 1, 0))
    return found.withColumn("secrets", F.sort_array(F.concat("base", more)))


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
