"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata, scored in context.

From a bounded sample of labelled rows (never those held out) come a lexicon of words that toxic documents
favour, the clean words that look like lexicon words, and the weights of a logistic score. The lexicon is a
trie; the automaton of all strings within one edit of a term is intersected with it and determinised as words
are read, so a misspelled term costs a few table look-ups. Each hit is scored in its window of words: inside
quotation marks, on a quoted line or beside reporting words it counts as quotation, else as abuse.

Null and empty texts have no hits and get the score of a text without hits. Repeated rows get equal scores; an
empty table gives an empty result. Without enough labelled rows of both kinds nothing is learned: every score
is then 0. Rows with a null doc_id are not held out and never learned from.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import ship_code, written
from verdigris.llm.common import per_text, texts_of

#: Bounds of the labelled sample by label (smallest hashes of doc_id), and the fewest rows of each to learn from.
SAMPLE_TOXIC, SAMPLE_CLEAN, LEAST_ROWS = 6000, 12000, 20
#: Lexicon: fewest toxic documents and least log-odds. The bounded sample bounds its terms and their clean look-alikes.
LEAST_SUPPORT, LEAST_ODDS = 4, 2.5
#: Edits allowed, the shortest term that may be misspelled, words of the context window, and the decision.
EDITS, LEAST_FUZZY, WINDOW, DECISION = 1, 5, 12, 0.7
#: So many words or states a worker keeps before it starts afresh.
CACHE = 300_000

WORD = r"[^\W_]+"
_WORD = re.compile(WORD)
_QUOTES = re.compile("[\"“”„«»]")
_MARKED = re.compile(r"\s*>")
REPORTING = frozenset("said says wrote called quote quoted quotes term word phrase reported according dijo palabra mot dit wort sagte".split())


class LexiconAutomaton:
    """The trie of the terms, intersected with the automaton of strings within ``edits`` of them."""

    def __init__(self, terms: list[str], edits: int = EDITS, least_fuzzy: int = LEAST_FUZZY) -> None:
        self.edits, self.children, self.term = edits, [{}], [None]
        for term in sorted(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = term
        self.least_fuzzy = least_fuzzy
        self.reset()

    def reset(self) -> None:
        """Forget the determinised states."""
        start = self._closed({(0, 0)})
        self.number = {start: 0}
        self.members, self.moves, self.found = [start], [{}], [self._best(start)]

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With every state reached by skipping letters of a term; of a node the fewest edits count."""
        best: dict[int, int] = {}
        stack = list(states)
        while stack:
            node, used = stack.pop()
            if best.get(node, self.edits + 1) <= used:
                continue
            best[node] = used
            if used < self.edits:
                stack += [(child, used + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _best(self, states: frozenset) -> tuple[str, int] | None:
        found = [(used, self.term[node]) for node, used in states if self.term[node] and (not used or len(self.term[node]) >= self.least_fuzzy)]
        return min(found)[::-1] if found else None

    def _move(self, state: int, c: str) -> int:
        """The state after one more character; -1 where no term is in reach."""
        after = set()
        for node, used in self.members[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], used))
            if used < self.edits:
                after.add((node, used + 1))
                after.update((child, used + 1) for child in self.children[node].values())
        if not after:
            self.moves[state][c] = -1
            return -1
        closed = self._closed(after)
        if closed not in self.number:
            self.number[closed] = len(self.members)
            self.members.append(closed)
            self.moves.append({})
            self.found.append(self._best(closed))
        self.moves[state][c] = self.number[closed]
        return self.number[closed]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within the edits and how many it takes, or None."""
        if len(self.members) > CACHE:
            self.reset()
        state, moves = 0, self.moves
        for c in word:
            after = moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if state < 0:
                return None
        return self.found[state]


@dataclass
class ToxicityModel:
    """Lexicon with log-odds, clean look-alikes, and the weights of the logistic score."""

    odds: dict[str, float]
    lookalikes: frozenset[str]
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._automaton, self._known = None, {}

    def __getstate__(self) -> dict:
        return {"odds": self.odds, "lookalikes": self.lookalikes, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def lookup(self, word: str) -> tuple[float, int] | None:
        """(log-odds, edits) of a lower-cased word, None if it is no term."""
        if self._automaton is None:
            self._automaton = LexiconAutomaton(list(self.odds))
        if word in self.odds:
            return self.odds[word], 0
        near = None if word in self.lookalikes or len(word) < LEAST_FUZZY - EDITS else self._automaton.match(word)
        return (self.odds[near[0]], near[1]) if near else None

    def hits(self, text: str) -> list[tuple[int, int, float, int]]:
        """(start, end, log-odds, edits) of the terms in a text."""
        words = _WORD.findall(text.lower())
        new = set(words).difference(self._known)
        if len(self._known) > CACHE:
            self._known.clear()
            new = set(words)
        for word in new:
            self._known[word] = self.lookup(word)
        if not any(map(self._known.__getitem__, set(words))):
            return []
        found = [(m.start(), m.end(), self._known.get(m[0].lower()) or self.lookup(m[0].lower())) for m in _WORD.finditer(text)]
        return [(a, b, *x) for a, b, x in found if x]

    def features(self, text: str) -> list[float]:
        """What the score weighs: hits as abuse and as quotation, exact and misspelled, their spread and density."""
        hits = self.hits(text)
        if not hits:
            return [0.0] * N_FEATURES
        words = [m.span() for m in _WORD.finditer(text)]
        starts = [a for a, _ in words]
        quotes = Quotes(text)
        place = np.searchsorted(starts, [a for a, *_ in hits])
        quoted = np.array([quotes.likelihood(a, [text[x:y].lower() for x, y in words[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]]) for (a, *_), i in zip(hits, place.tolist())])
        odds, edits = np.array([h[2] for h in hits]), np.array([h[3] for h in hits])
        weight = odds * (1 - quoted) * np.where(edits == 0, 1.0, 0.5)
        total = np.concatenate(([0.0], np.cumsum(weight)))
        last = np.searchsorted(place, place + WINDOW)
        window = float((total[last] - total[np.arange(len(hits))]).max())
        kinds = len({text[a:b].lower() for (a, b, *_), q in zip(hits, quoted) if q < 0.5})
        return [
            float(np.log1p(((1 - quoted) * (edits == 0)).sum())),
            float(np.log1p(((1 - quoted) * (edits > 0)).sum())),
            float(np.log1p(quoted.sum())),
            float(np.log1p(window)),
            min(kinds, 4) / 4,
            float(np.log1p(100 * weight.sum() / len(words))),
        ]

    def score(self, features: np.ndarray) -> np.ndarray:
        """Likelihood of label 1, from 0 to 1."""
        z = features @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


N_FEATURES = 6


class Quotes:
    """The lines and quotation marks of a text, found once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.breaks = [i for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
        self.marks = [m.start() for m in _QUOTES.finditer(text)]

    def likelihood(self, at: int, window: list[str]) -> float:
        """How likely the word at ``at`` is quoted, from 0 to 1; ``window`` has the words around it."""
        k = bisect_left(self.breaks, at)
        line = self.breaks[k - 1] + 1 if k else 0
        end = self.breaks[k] if k < len(self.breaks) else len(self.text)
        score = 0.0
        if (m := _MARKED.match(self.text, line, end)) and m.end() <= at:
            score += 0.7
        before, here, after = (bisect_left(self.marks, x) for x in (line, at, end))
        if (here - before) % 2 and after > here:
            score += 0.7
        if REPORTING.intersection(window):
            score += 0.3
        return min(score, 1.0)


def held_out():
    """Whether a row is held out: crc32 of its doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """A model from at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows that are not held out."""
    ship_code(docs.sparkSession)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of contradicting labels the graver
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(usable.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < LEAST_ROWS:
        return None
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("word")
    counts = rows.select("toxic", words).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1.0))
    counts = written(counts.withColumn("odds", odds))
    lexicon = {r["word"]: float(r["odds"]) for r in counts.where((F.col("t") >= LEAST_SUPPORT) & (F.col("odds") >= LEAST_ODDS)).collect()}
    model = ToxicityModel(lexicon, frozenset(), np.zeros(N_FEATURES + 1))
    if not lexicon:
        return model
    model.lookalikes = frozenset(r["word"] for r in near_words(counts.where((F.col("c") >= 1) & (F.col("odds") < LEAST_ODDS)), model).collect())
    sample = document_features(rows, model).groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(chosen), "doc_id").collect()
    sample.sort(key=lambda r: r["doc_id"])
    model.weights = logistic(np.array([r["features"] for r in sample]), np.array([r["toxic"] for r in sample], dtype=float))
    return model


def near_words(words: DataFrame, model: ToxicityModel) -> DataFrame:
    """The words that are within the edits of a lexicon term."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.lookup(w) is not None for w in batch.column(0).to_pylist()], pa.bool_()))

    return words.select("word").mapInArrow(run, "word string")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the constant first) of a penalised logistic regression, by Newton steps."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def document_features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and the features of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    return per_text(docs, lambda texts: [[shared.value.features(t) for t in texts]], "features array<double>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def helper(texts: list[str]) -> list:
        model = shared.value
        if model is None:
            return [[0.0] * len(texts), [0] * len(texts)]
        score = model.score(np.array([model.features(t) for t in texts]).reshape(len(texts), N_FEATURES))
        return [score, (score >= DECISION).astype(np.int32)]

    return per_text(docs, helper, "score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")
