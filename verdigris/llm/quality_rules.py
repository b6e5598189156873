"""Quality rules: document statistics, and an isolation forest over them.

Every document gets the rule counts of its whole text. A forest of random splits then turns the statistics into a
mean path length: odd documents are isolated after few splits. The splits are drawn in the box of all labelled rows, which
reaches beyond the good ones, so that a row outside of what these cover soon stands alone. Spark counts how many of all good
rows lie in each node, and where the path of a row ends follows from these counts. The threshold on the anomaly score comes
from the scores of all labelled rows. No row is left out of either.

Null or empty texts have no words: all counts are 0 and the rule on the number of words rejects them.
Repeated rows are judged alike. An empty table gives an empty result. With fewer than ``LEAST_LABELS``
labelled rows of either quality no forest is fitted and the rules alone decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import ship_code, written
from verdigris.llm.common import per_text, where_text

#: Rules of the base: fewest words, most percent of words in repeated windows, and the windows' size.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: The least labelled rows of each quality.
LEAST_LABELS = 20
#: Isolation forest: trees, their depth, the generator's seed, decimals of a score, and the share of good rows that may go.
TREES, DEPTH, SEED, DIGITS, MOST_GOOD_LOST = 100, 8, 7, 4, 0.002

SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
_SYMBOL_WORD = re.compile(rb"[#*$%&|<>][^ \t-\r]*")
FEATURES = ["word_length", "symbol_share", "symbol_word_share", "dup_line_share", "repeat_share", "top_word_share"]
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def repeated_words(ids: np.ndarray, counts: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text, all occurrences counted.

    ``ids`` numbers the words of the text, ``counts`` has the occurrences of each number.
    """
    if len(ids) <= WINDOW or len(counts) == len(ids):
        return 0
    # A window holding a word that occurs once in the text cannot recur.
    since = np.concatenate(([0], np.cumsum(counts[ids] == 1)))
    starts = np.flatnonzero(since[WINDOW:] == since[:-WINDOW])
    if len(starts) < 2:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    for i in range(WINDOW):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[starts + i].astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    if not equal.any():
        return 0
    alike = np.zeros(len(starts), dtype=bool)
    alike[order[1:][equal]] = True
    alike[order[:-1][equal]] = True
    maybe = starts[alike]
    # Equal hashes only nominate windows; their words decide.
    _, inverse, times = np.unique(windows[maybe], axis=0, return_inverse=True, return_counts=True)
    found = maybe[times[inverse.reshape(-1)] > 1]
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int, list[float]]:
    """The rule counts of one text and the shares that the forest splits on."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    number = dict(zip(dict.fromkeys(words), range(n)))
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    counts = np.bincount(ids) if n else np.zeros(0, dtype=np.int64)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(map(raw.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(ids, counts)
    per = 1 / max(n, 1)
    marked = len(_SYMBOL_WORD.findall(raw)) if symbols else 0
    features = [
        chars * per,
        symbols / max(chars, 1),
        marked * per,
        dup_lines / max(len(lines), 1),
        repeat * per,
        int(counts.max()) * per if n >= LEAST_WORDS else 0.0,
    ]
    return n, chars, symbols, dup_lines, repeat, features


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of every document."""
    return per_text(docs, lambda texts: list(zip(*map(statistics, texts))), STATISTICS)


@dataclass
class Forest:
    """Isolation trees as arrays: feature (-1 in a leaf), split value, and path length where a row ends."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    depth: int
    norm: float = 1.0
    threshold: float = 1.0

    @staticmethod
    def grow(low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        """Trees without rows yet; a node's split is uniform in the node's box, which starts as low..high."""
        rng = np.random.default_rng(seed)
        size = 2 ** (depth + 1)
        feature, value = np.full((trees, size), -1), np.zeros((trees, size))
        low, high = (np.broadcast_to(x, (trees, 1, len(x))) for x in (low, high))
        for level in range(depth):
            nodes = slice(2**level, 2 ** (level + 1))
            wide = high > low
            choices = wide.sum(-1)
            k = np.argmax(wide.cumsum(-1) > np.floor(rng.random(choices.shape) * choices)[..., None], axis=-1)
            begin, end = (np.take_along_axis(x, k[..., None], -1)[..., 0] for x in (low, high))
            cuts = begin + rng.random(k.shape) * (end - begin)
            feature[:, nodes], value[:, nodes] = np.where(choices > 0, k, -1), cuts
            at = np.arange(low.shape[-1]) == k[..., None]
            left, right = (low, np.where(at, cuts[..., None], high)), (np.where(at, cuts[..., None], low), high)
            low, high = (np.stack(sides, axis=2).reshape(trees, -1, low.shape[-1]) for sides in zip(left, right))
        return Forest(feature, value, np.zeros((trees, size)), depth)

    @staticmethod
    def fit(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        """Trees in the box low..high that hold the rows of x."""
        forest = Forest.grow(low, high, trees, depth, seed)
        return forest.holding(forest.tally(x), len(x))

    def ends(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the node where each row of x ends."""
        at = np.arange(len(x))
        for feature, value in zip(self.feature, self.value):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                k = feature[node]
                node = np.where(k < 0, node, 2 * node + (x[at, k] >= value[node]))
            yield node

    def tally(self, x: np.ndarray) -> np.ndarray:
        """By tree and node how many rows of x end there."""
        return np.stack([np.bincount(node, minlength=self.feature.shape[1]) for node in self.ends(x)])

    def holding(self, counts: np.ndarray, rows: int) -> Forest:
        """The forest with path lengths from ``counts`` (see ``tally``) of ``rows`` rows; nodes with fewer than two become leaves."""
        held = counts.copy()
        for level in reversed(range(self.depth)):
            held[:, 2**level : 2 ** (level + 1)] += held[:, 2 ** (level + 1) : 2 ** (level + 2)].reshape(len(held), -1, 2).sum(-1)
        level = np.floor(np.log2(np.maximum(np.arange(held.shape[1]), 1)))
        leaf = (held < 2) | (level == self.depth)
        return Forest(np.where(leaf, -1, self.feature), self.value, level + mean_path(held), self.depth, float(mean_path(np.array(rows))) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1 of every row; near 1 after short paths."""
        total = np.zeros(len(x))
        for path, node in zip(self.path, self.ends(x)):
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The score in steps of 10 ** -DIGITS, so that all scores can be counted by value."""
        return np.round(self.score(x), DIGITS)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    more = np.maximum(n, 3)
    return np.select([n < 2, n == 2], [0.0, 1.0], 2 * (np.log(more - 1) + 0.5772156649015329) - 2 * (more - 1) / more)


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The score above which rows are anomalous: best sum of true rates that keeps nearly all good rows.

    ``scores`` are the distinct ones, ascending; ``good`` and ``bad`` count their rows.
    """
    options = np.append((scores[1:] + scores[:-1]) / 2, scores[-1] + 1e-9)
    lost, caught = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    return float(options[np.argmax(np.where(lost <= MOST_GOOD_LOST, caught - lost, -np.inf))])


def fit_forest(counted: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest that holds all labelled good rows, its threshold from all labelled rows of both kinds.

    ``counted`` is what ``document_statistics`` gives. The driver gets one row of bounds, the counts of the nodes
    and those of the distinct scores: at most TREES * 2 ** DEPTH and 10 ** DIGITS + 1 rows, whatever the input.
    """
    spark = counted.sparkSession
    ship_code(spark)
    chosen = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))  # of contradicting labels the worse
    )
    able = counted.where((F.col("n_words") >= LEAST_WORDS) & F.col("doc_id").isNotNull())
    single = able.groupBy("doc_id").agg(F.min("features").alias("features"))  # of texts that share an id one
    labelled = written(single.join(chosen, "doc_id").select("features", (F.col("quality") == 1).alias("good")))
    each = [F.col("features")[i] for i in range(len(FEATURES))]
    bounds = labelled.agg(F.count_if("good"), F.count_if(~F.col("good")), *map(F.min, each), *map(F.max, each)).first()
    if min(bounds[:2]) < LEAST_LABELS:
        return None
    low, high = np.array(bounds[2:]).reshape(2, -1)
    empty = spark.sparkContext.broadcast(Forest.grow(low, high))

    def tally(batches):
        counts = 0
        for batch in batches:
            counts = counts + empty.value.tally(_matrix(batch.column(0)))
        places = np.flatnonzero(counts) if np.ndim(counts) else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(np.ravel(counts)[places], pa.int64())], ["place", "n"])

    found = labelled.where("good").select("features").mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n")).toPandas().to_numpy()
    counts = np.zeros(empty.value.feature.shape, dtype=np.int64)
    counts.ravel()[found[:, 0]] = found[:, 1]
    forest = empty.value.holding(counts, bounds[0])
    full = spark.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(full.value.anomaly(_matrix(batch.column(0)))), batch.column(1)], ["score", "good"])

    scored = labelled.mapInArrow(score, "score double, good boolean").groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("score")
    forest.threshold = calibrate(*(scored[c].to_numpy() for c in ("score", "good", "bad")))
    return forest


def _matrix(features: pa.Array) -> np.ndarray:
    """Rows of features as numbers."""
    return features.flatten().to_numpy().reshape(-1, len(FEATURES))


def verdicts(n_words: np.ndarray, n_repeat_words: np.ndarray, x: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly (0 without a forest) and kept of documents with these counts and features."""
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)
    score = forest.anomaly(x) if forest else np.zeros(len(x))
    return failed, score, ~failed & ((score <= forest.threshold) if forest else True)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept for every document, by a forest fitted on the labels.

    The statistics are written to the shared folder, as the forest is fitted on them and they are judged by it.
    """
    counted = written(document_statistics(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(counted, labels))  # at most TREES * 6 * 2 ** DEPTH numbers
    told = counted.drop("features").select("*", F.lit(True).alias("base_failed"), F.lit(0.0).alias("anomaly"), F.lit(True).alias("kept"))
    names = told.columns

    def run(batches):
        for batch in batches:
            n, repeat = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            made = map(pa.array, verdicts(n, repeat, _matrix(batch.column("features")), shared.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-3]), *made], names)

    return counted.mapInArrow(run, told.schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(document_statistics(docs), labels))

    def decide(texts: list[str]) -> list:
        n, _, _, _, repeat, features = zip(*map(statistics, texts))
        return verdicts(np.array(n), np.array(repeat), np.array(features), shared.value)[-1]

    return where_text(docs, decide)
