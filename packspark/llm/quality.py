"""Quality rules: a threshold table compiled into one projection of counts and ratios.

``measure`` adds the counts of a text, ``compile_rules`` turns a rule table into one boolean
column, ``quality`` does both.  Only built-in column functions are used.

Defined results: a null text counts as empty (no words, base_failed); an empty table gives an
empty result; very long texts stay row-local (sorting, never pairs of windows); repeated rows are
measured one by one; extra columns of the input are kept unless they bear the name of a
measure, which then replaces them.  Windows of words are compared by their 64-bit hash: two
different windows of one text collide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import SPACE, let, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple("""
the and of to in is it for on with as was by be that this are at from or
der die das und ist in zu den von mit ein eine für auf im nicht des sich
le la les de des et un une est que qui dans pour sur par pas en du au
el los las y que un una en es por con para del se no al lo
""".split())

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
            "n_exclaims")


@dataclass(frozen=True)
class Rule:
    """Keeps a text when lo <= 100 * num / den <= hi (a missing bound is open; den 0 passes)."""
    name: str
    num: str
    den: str
    lo: int | None = None
    hi: int | None = None


# The threshold table: bounds are hundredths of the ratio num / den.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("exclaims", "n_exclaims", "n_words", None, 50),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 30),
)


def _repeat_words(h: Column) -> Column:
    """Words under the windows whose hash occurs at least twice, from the hashes in text order."""
    def positions(s):
        n = F.size(s)
        twin = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"]))
                        | ((k < n - 1) & (F.get(s, k + 1)["h"] == e["h"])))
        return F.sort_array(F.transform(twin, lambda e: e["i"]))

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    walk = F.aggregate(let(pairs, positions), start, lambda acc, x: F.struct(
        x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")))
    return walk["n"]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the MEASURES of ``text`` as long columns; every other column is kept."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in MEASURES]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    a = df.select(*keep, t.alias("_q_t"), words_of(t).alias("_q_w"), lines.alias("_q_l"))
    w = F.col("_q_w")
    windows = F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    b = a.withColumn("_q_h", F.coalesce(windows, F.array().cast("array<bigint>")))
    h, t = F.col("_q_h"), F.col("_q_t")
    chars = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    repeats = F.when(F.size(F.array_distinct(h)) < F.size(h), _repeat_words(h)).otherwise(0)
    out = {
        "n_words": F.size(w), "word_chars": chars(SPACE), "n_symbols": F.length(t) - chars(f"[{SYMBOLS}]+"),
        "n_dup_lines": F.size("_q_l") - F.size(F.array_distinct("_q_l")), "n_repeat_words": repeats,
        "n_lines": F.size("_q_l"), "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
        "n_exclaims": F.length(t) - chars("!+"),
    }
    return b.select(*keep, *[c.cast("long").alias(k) for k, c in out.items()])


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def compile_rules(rules=RULES) -> Column:
    """One boolean column: every rule of the table holds.  Integer arithmetic, so no rounding."""
    ok = F.lit(True)
    for r in rules:
        num, den = 100 * F.col(r.num), F.col(r.den)
        if r.lo is not None:
            ok = ok & (num >= r.lo * den)
        if r.hi is not None:
            ok = ok & (num <= r.hi * den)
    return ok


def quality(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Input columns, MEASURES, ``base_failed`` and ``kept`` (false if base_failed, else the table's verdict)."""
    m = measure(df.drop("base_failed", "kept"), text)
    return m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def rules_sql(rules=RULES) -> str:
    parts = [f"100 * {r.num} >= {r.lo} * {r.den}" for r in rules if r.lo is not None]
    parts += [f"100 * {r.num} <= {r.hi} * {r.den}" for r in rules if r.hi is not None]
    return " AND ".join(parts)


def quality_sql() -> str:
    """DuckDB text of the measures, base verdict and table verdict over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
win AS (
  SELECT r, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range(0, {WINDOW}) AS g(j) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[{SYMBOLS}]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(l) AS n_lines, len([x FOR x IN w IF x IN ({stop})]) AS n_stop_words,
         length(t) - length(regexp_replace(t, '!+', '', 'g')) AS n_exclaims
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, {', '.join(f'{c}::BIGINT AS {c}' for c in MEASURES)}, base_failed,
       NOT base_failed AND {rules_sql()} AS kept
FROM b"""
