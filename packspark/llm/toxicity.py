"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings (for stems with many endings) whose presence says most about
   the label in a bounded sample of labelled training rows (at most ``SAMPLE_ROWS``, chosen by a hash
   of the id; equal texts count once).
2. Voters: each of the strongest entries, groups of the others, and patterns (density, variety, shouting
   ...) fire or not on every document.  The different features and votes of all documents are counted.
3. Label model: expectation maximisation over the counted patterns, with the labelled sample as an
   anchor, estimates how often each voter fires on toxic and on other documents; the voters'
   correlations within a class discount those that repeat each other.
4. Classifier: logistic regression on the words and patterns, trained on the label model's
   posterior labels of all documents (each counted pattern by its count; Newton steps whose sums are taken over the
   table).  No row's own label is a target: labels choose entries and anchor the label model, no more.  It scores
   every whole text.

Labels come only from rows outside the held-out fold (crc32 of the id's text mod 4 is 2); labels,
language, source and id are never inputs of a score.

Defined results: null and empty texts score as the texts without any word; rows without an id are
not held out and never train; contradicting label rows of an id count as toxic; null labels are
left out; without toxic training rows no word is in the lexicon and all texts share one score; an empty
table gives an empty result; columns named like a result are replaced, others kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspark.llm.common import lean, materialise, texts

SAMPLE_ROWS = 20_000
LEXICON = 128           # entries at most
STEMS = range(3, 9)     # lengths of word beginnings, in UTF-8 bytes
SINGLE = 36             # of the entries, the strongest vote alone; the others in GROUPS
GROUPS = 8
CACHE_WORDS = 100_000
COUNTED = 100_000       # entries counted in a task before they are passed on
PATTERNS = 4
CANDIDATES = 4000
BOUND = 2.2             # standard errors by which an entry's odds must stand out
THRESHOLD = 0.3
ROUNDS = 8
ADDERS = 4              # tasks that add up the sums of the others
NEWTON = 15             # steps of the classifier at most
UNLABELLED = 1.0        # weight of all counted documents against all anchoring labels: the same balance at every size

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of_text(text: str | None) -> list[bytes]:
    """Runs of letters, lower-cased (A-Z)."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split() if text else []


def keys_of(word: bytes) -> list[bytes]:
    """Lexicon keys of a word: itself, and its beginnings marked by a closing star."""
    return [word, *(word[:n] + b"*" for n in STEMS if n <= len(word))]


def entries_of(words: list[bytes]) -> set[bytes]:
    """Lexicon entries of a text: keys of its words; a beginning shared by 2 or 3 different words counts anew."""
    n = Counter(k for w in set(words) for k in keys_of(w))
    return {*n, *(k + b"%d" % level for k, c in n.items() for level in (2, 3) if c >= level)}


def _counts(sample: DataFrame) -> DataFrame:
    """(entry, a, b): toxic and other rows of the sample that hold the entry, pre-counted in each task."""
    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in n], pa.binary()), pa.array([t for _, t in n], pa.int32()),
             pa.array(list(n.values()), pa.int64())], ["entry", "toxic", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
                n.update((e, toxic) for e in entries_of(words_of_text(text)))
                n[(b"", toxic)] += 1                      # all rows
                if len(n) >= COUNTED:
                    yield rows(n)
                    n.clear()
            yield rows(n)

    pairs = sample.select("text", "toxic").mapInArrow(lean(run), "entry binary, toxic int, n bigint")
    return pairs.groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                                      F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))


def _sure(a, b, na, nb, log, sqrt):
    """Lower bound of the log odds ratio of an entry held by a of na toxic and b of nb other rows."""
    odds = log((a + 0.5) / (na - a + 0.5)) - log((b + 0.5) / (nb - b + 0.5))
    return odds - BOUND * sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def find_lexicon(sample: DataFrame) -> tuple[list[bytes], int, int]:
    """Entries that together say most about the label, and the class sizes.

    The CANDIDATES strongest entries come from counts; among them, one after the other is chosen for what
    it says about toxic rows that no sure entry covers yet.  Only candidate numbers of the bounded
    sample's rows reach the driver."""
    counts = materialise(_counts(sample), "entry-counts")
    total = counts.where(F.length("entry") == 0).first()
    na, nb = (int(total["a"]), int(total["b"])) if total else (0, 0)
    if not na or not nb:
        return [], na, nb
    sure = _sure(F.col("a"), F.col("b"), na, nb, F.log, F.sqrt)
    top = counts.where((F.length("entry") > 0) & (F.col("a") >= max(3.0, 0.004 * na))).withColumn("sure", sure) \
        .where("sure > 0.7").orderBy(F.desc(F.col("a") * F.col("sure")), F.length("entry"), "entry") \
        .limit(CANDIDATES).collect()
    names = [bytes(r["entry"]) for r in top]
    rows, toxic = _sample_features(sample, names)
    return [names[i] for i in _choose(rows, toxic, names)], na, nb


def _choose(rows: list[list[int]], toxic: np.ndarray, names: list[bytes]) -> list[int]:
    """Greedy choice of entries.  Once a sure entry is chosen, entries of the same word family (one key
    begins the other) are judged by the rows it leaves."""
    n = len(names)
    keys = [e.split(b"*")[0] for e in names]
    rows = [[f for f in r if f < n] for r in rows]
    entry = np.concatenate([np.array(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    na, nb = float((toxic == 1).sum()), float((toxic == 0).sum())
    live = np.ones(len(entry), bool)
    chosen: list[int] = []
    taken = np.zeros(n, bool)
    while len(chosen) < LEXICON and n:
        a = np.bincount(entry[live & (toxic[row] == 1)], minlength=n).astype(float)
        b = np.bincount(entry[live & (toxic[row] == 0)], minlength=n).astype(float)
        sure = _sure(a, b, na, nb, np.log, np.sqrt)
        gain = np.where(taken | (a < 3) | (sure <= 0.7), -1.0, a * sure)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        chosen.append(best)
        taken[best] = True
        if 20 * b[best] <= a[best]:
            kin = np.array([k.startswith(keys[best]) or keys[best].startswith(k) for k in keys])
            live &= ~(kin[entry] & np.isin(row, row[entry == best]))
    return chosen


class Features:
    """Entries and patterns of a text as 0/1 features: lexicon entries, then PATTERNS (two entries or more; one word
    in a hundred has one of the strongest entries; mostly capitals; many exclamation marks)."""

    def __init__(self, lexicon: list[bytes]):
        self.entries: dict[bytes, list[tuple[int, int]]] = {}     # key -> (least count, feature)
        for i, e in enumerate(lexicon):
            level = int(e[-1:]) if e[-2:-1] == b"*" else 1
            self.entries.setdefault(e[:-1] if level > 1 else e, []).append((level, i))
        self.strong = {k for k, held in self.entries.items() if any(i < SINGLE for _, i in held)}
        self.n = len(lexicon)
        self.size = self.n + PATTERNS
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def _keys(self, word: bytes) -> tuple[bytes, ...]:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(k for k in keys_of(word) if k in self.entries)
        return found

    def __call__(self, text: str | None) -> list[int]:
        words = words_of_text(text)
        get, make = self.known.get, self._keys
        hits, held = 0, Counter()
        for w in set(words):
            keys = get(w)
            if keys is None:
                keys = make(w)
            if keys:
                held.update(keys)
                hits += not self.strong.isdisjoint(keys)
        out = sorted(i for k, c in held.items() for level, i in self.entries[k] if c >= level)
        upper = sum(map(str.isupper, text)) if text else 0
        marks = text.count("!") if text else 0
        n = len(words)
        patterns = (len(out) >= 2, hits > 0 and 100 * hits >= n, n > 0 and 2 * upper >= len(text), n > 0 and 5 * marks >= n)
        return out + [self.n + i for i, p in enumerate(patterns) if p]

    def votes(self, features: list[int]) -> int:
        """Bit mask of the voters that fire."""
        mask = 0
        for f in features:
            if f >= self.n:
                mask |= 1 << (SINGLE + GROUPS + f - self.n)
            elif f < SINGLE:
                mask |= 1 << f
            else:
                mask |= 1 << (SINGLE + (f - SINGLE) % GROUPS)
        return mask


VOTERS = SINGLE + GROUPS + PATTERNS


def vote_patterns(docs: DataFrame, lexicon: list[bytes]) -> DataFrame:
    """(features, mask, n): how many documents have each set of features, and the votes it casts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            n = Counter(tuple(features(t)) for t in texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in n], pa.list_(pa.int32())),
                                              pa.array([features.votes(list(f)) for f in n], pa.int64()),
                                              pa.array(list(n.values()), pa.int64())], ["features", "mask", "n"])

    return docs.select("text").mapInArrow(lean(run), "features array<int>, mask bigint, n bigint") \
        .groupBy("features", "mask").agg(F.sum("n").alias("n"))


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(VOTERS)) & 1


@dataclass
class LabelModel:
    """Firing rates of the voters on toxic (p1) and other (p0) documents, discounts, and the toxic share."""
    p1: np.ndarray
    p0: np.ndarray
    discount: np.ndarray
    prior: float

    def posterior(self, bits: np.ndarray, known: np.ndarray | float = 0.0) -> np.ndarray:
        """Chance of the toxic class; ``known`` adds log odds from other evidence."""
        fire = np.log(self.p1 / self.p0)
        still = np.log((1 - self.p1) / (1 - self.p0))
        z = np.log(self.prior / (1 - self.prior)) + (bits * (fire - still) + still) @ self.discount + known
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(patterns: DataFrame, model: LabelModel, pairs: bool) -> np.ndarray:
    """Posterior-weighted sums over all patterns, one row per task: firing counts by class, class
    sizes and, if asked, joint firings by class."""
    shared = patterns.sparkSession.sparkContext.broadcast((model.p1, model.p0, model.discount, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LabelModel(*shared.value)
        out = np.zeros(2 * (VOTERS + 1) + 2 * VOTERS * VOTERS * pairs)
        for batch in batches:
            x = _bits(batch.column("mask").to_numpy()).astype(float)
            n = batch.column("n").to_numpy().astype(float)
            q = model.posterior(x)
            parts = []
            for w in (n * q, n * (1 - q)):
                parts += [w @ x, [w.sum()]]
            if pairs:
                parts += [((x * w[:, None]).T @ x).ravel() for w in (n * q, n * (1 - q))]
            out += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["s"])

    return added_up(patterns.select("mask", "n").mapInArrow(lean(run), "s array<double>"),
                    2 * (VOTERS + 1) + 2 * VOTERS ** 2 * pairs)


def added_up(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays in column ``s``, a row per task: added in at most ADDERS tasks before the driver adds theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for row in batch.column("s"):
                out += row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["s"])

    rows = parts.repartition(ADDERS).mapInArrow(lean(run), "s array<double>").collect()
    return np.sum([r["s"] for r in rows], axis=0) if rows else np.zeros(size)


def fit_label_model(patterns: DataFrame, bits: np.ndarray, toxic: np.ndarray) -> LabelModel:
    """Expectation maximisation over all vote patterns, anchored by labelled votes (bits, toxic).

    Both sides have weights that don't depend on how many documents there are: with one weight a document the few labels
    would say less and less as the corpus grows."""
    own = [(bits[toxic == k].sum(0).astype(float), float((toxic == k).sum())) for k in (1, 0)]

    def rates(sums: np.ndarray | None, discount: np.ndarray) -> LabelModel:
        p, size = [], []
        for k in (0, 1):
            fired, n = own[k]
            if sums is not None:
                at = k * (VOTERS + 1)
                share = UNLABELLED * len(toxic) / max(sums[VOTERS] + sums[2 * VOTERS + 1], 1.0)
                fired, n = fired + share * sums[at:at + VOTERS], n + share * sums[at + VOTERS]
            p.append(np.clip((fired + 0.1) / (n + 0.2), 1e-4, 1 - 1e-4))
            size.append(n)
        return LabelModel(p[0], p[1], discount, min(max(size[0] / max(sum(size), 1.0), 1e-3), 0.5))

    model = rates(None, np.ones(VOTERS))
    for k in range(ROUNDS):
        pairs = k == ROUNDS // 2
        sums = _sums(patterns, model, pairs)
        discount = _discount(sums) if pairs else model.discount
        model = rates(sums, discount)
    return model


def _discount(sums: np.ndarray) -> np.ndarray:
    """1 / (1 + summed positive correlation with the other voters), the larger of both classes'."""
    most = np.zeros(VOTERS)
    at = 2 * (VOTERS + 1)
    for k in (0, 1):
        n = max(sums[k * (VOTERS + 1) + VOTERS], 1e-9)
        mean = sums[k * (VOTERS + 1):k * (VOTERS + 1) + VOTERS] / n
        cov = sums[at + k * VOTERS ** 2:at + (k + 1) * VOTERS ** 2].reshape(VOTERS, VOTERS) / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        rho[rho < 0.15] = 0                                # chance
        np.fill_diagonal(rho, 0)
        rho[:, mean < 1e-6] = 0
        rho[mean < 1e-6] = 0
        most = np.maximum(most, rho.sum(1))
    return 1 / (1 + most)


def fit_logistic(patterns: DataFrame, model: LabelModel, size: int, ridge: float = 0.05, rounds: int = NEWTON) -> np.ndarray:
    """Ridge logistic regression on the posterior labels of all documents by Newton steps; the last weight is the intercept.

    A step's gradient and curvature are sums over the pattern table: a task holds one batch of patterns and
    one square of ``size + 1``."""
    n = size + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        sums = added_up(_newton_sums(patterns, model, size, w), n + n * n)
        gradient, curvature = sums[:n], sums[n:].reshape(n, n)
        step = np.linalg.solve(curvature + np.diag(penalty + 1e-6), gradient - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-3:
            break
    return w


def _newton_sums(patterns: DataFrame, model: LabelModel, size: int, w: np.ndarray) -> DataFrame:
    shared = patterns.sparkSession.sparkContext.broadcast((model.p1, model.p0, model.discount, model.prior, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *rates, weights = shared.value
        label_model = LabelModel(*rates)
        n = size + 1
        gradient, curvature = np.zeros(n), np.zeros((n, n))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                held = part.column("features")
                x = np.zeros((len(held), n))
                x[:, -1] = 1
                x[np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy()), held.flatten().to_numpy()] = 1
                count = part.column("n").to_numpy().astype(float)
                soft = label_model.posterior(_bits(part.column("mask").to_numpy()).astype(float))
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                gradient += x.T @ (count * (soft - p))
                curvature += (x * (count * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.append(gradient, curvature.ravel())], pa.list_(pa.float64()))], ["s"])

    return patterns.mapInArrow(lean(run), "s array<double>")


@dataclass
class ToxicityModel:
    lexicon: list[bytes]
    weights: np.ndarray     # lexicon words, patterns, intercept
    label_model: LabelModel | None

    def score(self, features: list[int]) -> float:
        z = self.weights[-1] + sum(self.weights[f] for f in features)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows outside the held-out fold, equal texts once."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.sparkSession.createDataFrame(ids.toPandas().to_records(index=False).tolist(), "doc_id bigint, toxic int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id") \
        .groupBy(F.xxhash64("text").alias("_h"), F.md5("text").alias("_m")) \
        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _sample_features(sample: DataFrame, lexicon: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    """Features and labels of the bounded sample, on the driver (a few numbers per row)."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t) for t in texts(batch.column("text"))], pa.list_(pa.int32())),
                 batch.column("toxic")], ["f", "toxic"])

    got = sample.mapInArrow(lean(run), "f array<int>, toxic int").collect()
    return [list(r["f"]) for r in got], np.array([r["toxic"] for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    sample = materialise(training_sample(docs, labels, rows), "toxicity-sample")
    lexicon, na, nb = find_lexicon(sample)
    features = Features(lexicon)
    if not lexicon:
        share = (na + 0.5) / (na + nb + 10.0)
        return ToxicityModel([], np.append(np.zeros(features.size), np.log(share / (1 - share))), None)
    rows_f, toxic = _sample_features(sample, lexicon)
    patterns = materialise(vote_patterns(docs, lexicon), "vote-patterns")
    bits = _bits(np.array([features.votes(f) for f in rows_f], np.int64))
    model = fit_label_model(patterns, bits, toxic)
    return ToxicityModel(lexicon, fit_logistic(patterns, model, features.size), model)


ADDED = "score double, predicted int"


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    added = T._parse_datatype_string(ADDED)
    keep = [c for c in docs.columns if c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value, None)
        features = Features(own.lexicon)
        for batch in batches:
            s = [own.score(features(t)) for t in texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(s, pa.float64()),
                 pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], [*keep, "score", "predicted"])

    return docs.mapInArrow(lean(run), T.StructType([docs.schema[c] for c in keep] + list(added)))
