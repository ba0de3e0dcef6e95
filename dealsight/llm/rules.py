"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated on labelled rows.

The statistics of a text are counts that any rule set uses (words, symbols, repeated lines and words, capitals ...), as
steps of each rule's limit.  All of them are used, but for those that the calibration is better without, as they set
labelled good rows apart; no statistic has to be frequent among the bad rows.
A forest of random splits is grown on all documents, as counts of equal steps; a document's score is its mean path length,
so documents that a few random splits set apart score high, however rare their kind.  The rejection threshold is the score
that best separates all labelled rows while at most ``max_loss`` of the labelled good rows lie above it.

Defined cases: a null or empty text has no words and fails the base rules; without labelled rows of both classes nothing
is rejected beyond the base rules; repeated rows and equal texts get equal verdicts; a null ``doc_id`` is kept as it is.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import cut, map_batches, release, texts

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = ("n_lines", "n_upper", "n_digits", "n_punct", "n_distinct")
SPACES = b" \t\n\r\x0b\x0c"
UPPER, DIGIT, PUNCT = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = DIGIT[48:58] = True
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur twice or more, distinct words)."""
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 4 or len(first) == n:
        return 0, len(first)
    pair = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * n + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum()), len(first)


def text_stats(text: bytes) -> tuple[int, ...]:
    """The statistics ``BASE + SHAPE`` of one whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    points = len(raw) - int(counts[128:192].sum())
    rep, distinct = repeated_words(words)
    return (len(words), points - int(sum(counts[c] for c in SPACES)), int(sum(counts[c] for c in SYMBOLS)),
            len(lines) - len(set(lines)), rep, len(lines), int(counts[UPPER].sum()), int(counts[DIGIT].sum()),
            int(counts[PUNCT].sum()), distinct)


#: Fixed steps, one rule's limit each: word length off 5.5 letters, symbols a word, repeated lines, repeated words,
#: capitals, digits and punctuation.  A clean text stays on step 0 of nearly all of them.
STEPS = (3.0, 0.1, 0.3, 0.2, 0.3, 0.2, 0.5)
NAMES = tuple(f"step_{k}" for k in range(len(STEPS)))
MANY = 16  # so many limits and more: a step is a doubling, so equal steps stay few however odd the texts


def base_failed(stats: np.ndarray) -> np.ndarray:
    """Under 50 words, or over half of them inside repeated windows."""
    words, rep = stats[:, 0], stats[:, 4]
    return (words < 50) | (100 * rep > 50 * words)


def features(stats: np.ndarray) -> np.ndarray:
    """How many whole rule limits each ratio of a text spans (past ``MANY``: in doublings); ratios do not grow with a text's length."""
    words, chars, symbols, dup, rep, lines, upper, digits, punct, _ = stats.astype(np.float64).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    ratios = (np.abs(c / w - 5.5), symbols / w, dup / np.maximum(lines, 4), rep / w, upper / c, digits / c, punct / w)
    spans = np.stack([np.floor(r / s) for r, s in zip(ratios, STEPS)], axis=1)
    return np.where(spans < MANY, spans, MANY + np.floor(np.log2(np.maximum(spans, MANY) / MANY)))


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` rows, the usual normaliser."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: split feature (-1 at a leaf), split value, left child (the right one follows), leaf length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    rows: float

    @staticmethod
    def grow(x: np.ndarray, trees: int, sample: int, seed: int, weight: np.ndarray | None = None) -> Forest:
        """Every tree is grown on all rows, each of which stands for ``weight`` rows, to the depth usual for ``sample`` rows.

        Cuts are drawn on a logarithmic scale from a node's least value, so that a few extreme rows do not draw all of them.
        """
        rng = np.random.default_rng(seed)
        weight = np.ones(len(x)) if weight is None else np.asarray(weight, np.float64)
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        size = 2 ** (depth + 1)
        feature, value = np.full((trees, size), -1, np.int32), np.zeros((trees, size))
        left, length = np.zeros((trees, size), np.int32), np.zeros((trees, size))
        for t in range(trees):
            todo, used = [(0, np.arange(len(x)), 0)], 1
            while todo:
                node, rows, level = todo.pop()
                lo, hi = x[rows].min(0), x[rows].max(0)
                open_ = np.flatnonzero(hi > lo)
                if level == depth or not len(open_):
                    length[t, node] = level + float(mean_path(weight[rows].sum()))
                    continue
                f = int(rng.choice(open_))
                v = min(lo[f] + float(np.expm1(rng.uniform(0, np.log1p(hi[f] - lo[f])))), float(np.nextafter(hi[f], lo[f])))
                go = x[rows, f] <= v
                feature[t, node], value[t, node], left[t, node] = f, v, used
                todo += [(used, rows[go], level + 1), (used + 1, rows[~go], level + 1)]
                used += 2
        return Forest(feature, value, left, length, float(weight.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that random splits isolate early."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, length in zip(self.feature, self.value, self.left, self.length):
            node = np.zeros(len(x), np.int64)
            while (live := feature[node] >= 0).any():
                at = node[live]
                node[live] = left[at] + (x[rows[live], feature[at]] > value[at])
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.rows)), 1e-9))


@dataclass(frozen=True)
class Rules:
    forest: Forest | None
    threshold: float
    used: tuple[int, ...] = ()  # features that the forest looks at

    def verdicts(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, score, kept) for rows of ``BASE + SHAPE``."""
        failed = base_failed(stats)
        score = np.zeros(len(stats)) if self.forest is None else self.forest.score(features(stats)[:, list(self.used)])
        return failed, score, ~failed & (score <= self.threshold)


def calibrate(score: np.ndarray, good: np.ndarray, max_loss: float, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(gain, cut): the best (bad caught - good lost) rate among cuts that lose at most ``max_loss`` of the good rows."""
    if not good.any() or good.all():
        return 0.0, float("inf")
    weight = np.ones(len(score)) if weight is None else weight
    cuts, at = np.unique(score, return_inverse=True)
    bad_at, good_at = (np.bincount(at[of], weight[of], minlength=len(cuts)) for of in (~good, good))
    caught = 1 - np.cumsum(bad_at) / bad_at.sum()
    lost = 1 - np.cumsum(good_at) / good_at.sum()
    gain = np.where(lost <= max_loss, caught - lost, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return 0.0, float("inf")
    return float(gain[best]), float(cuts[best] if best + 1 == len(cuts) else (cuts[best] + cuts[best + 1]) / 2)


def threshold_for(score: np.ndarray, good: np.ndarray, max_loss: float) -> float:
    """The cut of ``calibrate``."""
    return calibrate(score, good, max_loss)[1]


def select(x: np.ndarray, lab: np.ndarray, good: np.ndarray, trees: int, subsample: int, max_loss: float, seed: int,
           weight: np.ndarray | None = None, lab_weight: np.ndarray | None = None) -> Rules:
    """The forest and cut of the statistics with the best calibrated gain, the larger set among equals.  Rows of ``x`` and of
    ``lab`` may stand for several equal ones (``weight``, ``lab_weight``).

    A statistic on which all labelled good rows agree can lose none of them and always stays, however few bad rows it
    shows.  Of the others, the one whose loss leaves the best gain goes next, down to none, and the best set is taken.
    """

    def fitted(used: list[int]) -> tuple[float, Rules]:
        forest = Forest.grow(x[:, used], trees, subsample, seed, weight)
        gain, cut = calibrate(forest.score(lab[:, used]), good, max_loss, lab_weight)
        return gain, Rules(forest, cut, tuple(used))

    used = list(range(x.shape[1]))
    doubtful = [f for f in used if lab[good, f].min() < lab[good, f].max()]
    best = fitted(used)
    while doubtful and len(used) > 1:
        tried = [(fitted([g for g in used if g != f]), f) for f in doubtful]
        now, gone = max(tried, key=lambda t: t[0][0])
        used.remove(gone)
        doubtful.remove(gone)
        if now[0] > best[0]:
            best = now
    return best[1] if best[0] > 0 else Rules(None, float("inf"))


def steps(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``features`` of the documents that pass the base rules."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([text_stats(t) for t in texts(b)], np.int64)
        passed = ~base_failed(stats)
        rows = features(stats[passed]).astype(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(passed)), *(pa.array(c) for c in rows.T)], ["doc_id", *NAMES])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, " + ", ".join(f"{c} long" for c in NAMES))


def fit(docs: DataFrame, labels: DataFrame, trees: int = 200, subsample: int = 512, max_loss: float = 0.002, seed: int = 7) -> Rules:
    """Grow the forest on all documents and set the threshold on all labelled ones; nothing is sampled.

    Documents are counted by equal steps, and labelled ones by equal steps and label; only these counts reach the driver.
    ``subsample`` rules the depth of the trees.  Documents that fail the base rules are left out of all: the forest judges
    what the base rules pass.
    """
    rows = cut(steps(docs))
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("long").alias("_good"))

    def counts(df: DataFrame, *by: str) -> np.ndarray:
        found = sorted(tuple(r) for r in df.groupBy(*by).agg(F.count(F.lit(1))).collect())
        return np.array(found, np.int64).reshape(-1, len(by) + 1)

    pool, got = counts(rows, *NAMES), counts(rows.join(marks, "doc_id"), *NAMES, "_good")
    release(rows)
    good, n = got[:, -2] > 0, len(NAMES)
    if pool[:, -1].sum() < 2 or not good.any() or good.all():
        return Rules(None, float("inf"))
    x, lab = pool[:, :n].astype(np.float64), got[:, :n].astype(np.float64)
    return select(x, lab, good, trees, subsample, max_loss, seed, pool[:, -1], got[:, -1])


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """Statistics, score and verdict of every document."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([text_stats(t) for t in texts(b)], np.int64)
        failed, score, kept = rules.verdicts(stats)
        cols = [b.column("doc_id"), *[pa.array(c) for c in stats[:, :5].T], pa.array(failed), pa.array(score), pa.array(kept)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), batch, schema)


def keep(docs: DataFrame, rules: Rules) -> DataFrame:
    """The documents that pass, with all their columns."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        _, _, kept = rules.verdicts(np.array([text_stats(t) for t in texts(b)], np.int64))
        return b.filter(pa.array(kept))

    return map_batches(docs, batch, docs.schema)
