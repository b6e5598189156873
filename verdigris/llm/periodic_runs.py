"""Runs of periodic words, by string synchronising sets.

A run is a longest stretch with smallest period q that holds it twice at least. Periods up to ``DIRECT`` are read off by comparing the
words with themselves q places on. For larger ones, and scales t = 2, 4, 8 ..., positions are selected whose choice
depends on the 2t words from there alone: i is selected if, among the stretches of t words that begin at i to i + t, the one of least hash
is the first or the last. Stretches inside highly periodic regions (period up to t / 3) are left out, so that few are selected.
A run of period 3t - 1 to 6t - 2 then holds two selected positions of equal context one period apart, unless it begins
and ends in neighbouring regions of one small period: those regions, found at smaller scales, propose its periods themselves. Each proposal is
extended to both sides by binary search over prefix hashes, and every run is compared word for word; a text in which a
hash misled is searched period by period instead. Work is in proportion to the words times the number of scales.

Texts are taken in slices, end to end, with separators that equal nothing, so that numpy works on many documents at
once. No rows are shuffled. Null and empty texts have no words and no runs; repeated rows get equal results; a null doc_id is not
altered; an empty table gives an empty result; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from verdigris.functions.session import ship_code, short_batches
from verdigris.llm.common import sliced, texts_of

#: A run has so many words at least, and periods up to ``DIRECT`` are found by direct comparison.
SHORTEST, DIRECT = 12, 4
#: Two primes below 2**31 and the bases of the prefix hashes.
_HASHES = ((2147483647, 1103515245), (2147483629, 1812433253))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits stirred, so that equal numbers alone look alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + _mixed(right))


class PrefixHashes:
    """Equality of stretches by hashes of prefixes, in two prime fields."""

    def __init__(self, words: np.ndarray) -> None:
        self.size, self.fields = len(words), []
        mixed = _mixed(words.astype(np.uint64))
        for k, (prime, base) in enumerate(_HASHES):
            power = np.ones(1, dtype=np.int64)
            while len(power) <= self.size:
                step = int(power[-1]) * base % prime
                power = np.concatenate((power, power * step % prime))
            power = power[: self.size + 1]
            value = ((mixed >> np.uint64(32 * k)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % prime
            sums = np.concatenate(([0], np.cumsum(value * power[: self.size] % prime)))
            self.fields.append((prime, power, sums))

    def alike(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a (the smaller place) and from b hash alike."""
        same = np.ones(len(a), dtype=bool)
        for prime, power, sums in self.fields:
            x, y = (sums[a + size] - sums[a]) % prime, (sums[b + size] - sums[b]) % prime
            same &= x * power[b - a] % prime == y
        return same

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are alike."""
        low, high = np.zeros(len(a), dtype=np.int64), self.size - b
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.alike(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are alike."""
        low, high = np.zeros(len(a), dtype=np.int64), a.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.alike(a - middle, b - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def shifted_runs(words: np.ndarray, period: int) -> np.ndarray:
    """Rows (start, length, period) of the longest stretches that repeat after ``period`` words and hold it twice; it need not be the smallest."""
    same = np.concatenate(([False], words[period:] == words[:-period], [False])) if period < len(words) else np.zeros(2, dtype=bool)
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= period]
    return np.stack((edges[:, 0], edges[:, 1] - edges[:, 0] + period, np.full(len(edges), period)), axis=1)


def extended(hashes: PrefixHashes, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs that proposals (a place, a period) lie in, as far as they are runs."""
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    back, on = hashes.behind(at, at + period), hashes.ahead(at, at + period)
    rows = np.stack((at - back, back + on + period, period), axis=1)
    return rows[back + on >= period]


def smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows that are one stretch, that of the smallest period: the others are its multiples."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def periodic_starts(rows: np.ndarray, scale: int, size: int) -> np.ndarray:
    """For each place, whether the ``scale`` words from there have a period of at most a third of that."""
    inside = rows[(3 * rows[:, 2] <= scale) & (rows[:, 1] >= scale)]
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, inside[:, 0], 1)
    np.add.at(change, inside[:, 0] + inside[:, 1] - scale + 1, -1)
    return np.cumsum(change)[:size] > 0


def proposals(hashed: np.ndarray, periodic: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashed`` (of the ``scale`` words from each) and periods that selected positions of equal context propose."""
    size = len(hashed) - scale
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    ranks = np.where(periodic[: len(hashed)], none, hashed)
    least, width = ranks, 1
    while 2 * width <= scale + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = scale + 1 - width
    least = np.minimum(least[:size], least[rest : rest + size])
    chosen = np.flatnonzero((least != none) & ((least == ranks[:size]) | (least == ranks[scale:])))
    context = _paired(hashed[chosen], hashed[chosen + scale])
    order = np.argsort(context, kind="stable")
    chosen, context = chosen[order], context[order]
    places, periods, step = [], [], 1
    while step < len(chosen):
        apart = chosen[step:] - chosen[:-step]
        alike = (context[step:] == context[:-step]) & (apart <= 6 * scale - 2)
        if not alike.any():
            break
        wanted = alike & (apart >= 3 * scale - 1)
        places.append(chosen[:-step][wanted])
        periods.append(apart[wanted])
        step += 1
    return (np.concatenate(places), np.concatenate(periods)) if places else (chosen[:0], chosen[:0])


def neighbours(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of runs that begin in one region of a small period and end in the next of the same period."""
    rows = rows[rows[:, 1] >= 4 * rows[:, 2]]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    places, periods = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    touch = np.flatnonzero((rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 0] <= rows[:-1, 0] + rows[:-1, 1])) if len(rows) else []
    for k in touch:
        (a, n, p), (b, m, _) = rows[k], rows[k + 1]
        end = a + n
        block, after = words[end - p : end], words[end : end + 2 * p]
        if len(after) < 2 * p:
            continue
        turned = np.flatnonzero(after[:p] == block[0])
        for r in turned:
            if (after[r : r + p] == block).all():
                found = np.arange(r + p, min(n, m) + p + 1, p)
                places.append(np.full(len(found), end - p))
                periods.append(found)
                break
    at, period = np.concatenate(places), np.concatenate(periods)
    inside = at + period < len(words)
    return at[inside], period[inside]


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of documents that stand end to end.

    ``words`` are numbers; each document, ``sizes`` words long, comes after a separator that no other place equals.
    """
    rows = np.concatenate([shifted_runs(words, q) for q in range(1, DIRECT + 1)])
    rows, hashes = smallest(rows), PrefixHashes(words)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    place, hashed, scale, left = np.arange(len(words)), _mixed(words.astype(np.uint64)), 1, sizes
    while True:
        scale *= 2
        # Documents too short for two periods of this scale take no further part.
        stay = left + 1 >= 2 * (3 * scale - 1)
        if not stay.any():
            break
        if not stay.all():
            kept = np.repeat(stay, left + 1)
            place, hashed, left, starts = place[kept], hashed[kept], left[stay], starts[stay]
        half = scale // 2
        # The last places have no stretch of the scale: numbers of their own stand there.
        own = _mixed(np.arange(half, dtype=np.uint64) + np.uint64(scale << 40))
        hashed = np.concatenate((_paired(hashed[:-half], hashed[half:]), own))
        at, period = proposals(hashed, periodic_starts(rows, scale, len(words))[place], scale)
        # A context lies within one document, as it would hold a separator else and equal nothing.
        rows = smallest(np.concatenate((rows, extended(hashes, place[at], period))))
    rows = smallest(np.concatenate((rows, extended(hashes, *neighbours(words, rows)))))
    return rows if exact(words, rows) else smallest(np.concatenate([shifted_runs(words, q) for q in range(1, int(sizes.max(initial=0)) // 2 + 1)]))


def exact(words: np.ndarray, rows: np.ndarray) -> bool:
    """Whether every row repeats after its period, word for word, and can't be extended."""
    for start, size, period in rows:
        end = start + size
        if not np.array_equal(words[start : end - period], words[start + period : end]):
            return False
        if (start > 0 and words[start - 1] == words[start - 1 + period]) or (end < len(words) and words[end] == words[end - period]):
            return False
    return True


def altered(words: list, doc_id: int | None) -> list:
    """The words, those of every tenth document by crc32 made periodic from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def describe(ids: list, texts: list[str], shortest: int, alter: bool) -> list[list]:
    """The columns of ``periodic_runs`` after doc_id."""
    documents = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    if alter:
        documents = [altered(w, i) for i, w in zip(ids, documents)]
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    flat, sizes = [], np.array([len(w) for w in documents], dtype=np.int64)
    for k, words in enumerate(documents):
        flat.append(-1 - k)
        flat += map(numbers.__getitem__, words)
    starts = np.concatenate(([0], np.cumsum(sizes + 1))) + 1
    rows = runs_of(np.array(flat, dtype=np.int64), sizes)
    rows = rows[(rows[:, 1] >= shortest)]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    change = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    bounds = np.searchsorted(rows[:, 0], starts)
    columns: list[list] = [[] for _ in range(9)]
    for k, words in enumerate(documents):
        own = rows[bounds[k] : bounds[k + 1]] - [starts[k], 0, 0]
        if len(own):
            stay = kept[starts[k] : starts[k] + len(words)]
            words = list(compress(words, stay.tolist()))
            start, length, period = map(int, own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]])
            longest = [start, length, period, 1000 * length // period]
        else:
            longest = [None] * 4
        text = b" ".join(words)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in own.tolist())
        found = [len(own), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), told, text]
        for column, value in zip(columns, found):
            column.append(value)
    return columns


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs string, collapsed string"


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, alter: bool = False, texts: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: first, then smallest period), digests, runs and collapsed.

    ``runs`` lists every run as start,length,period by line; ``collapsed`` is the text without the repeats, words joined by one space. Without
    ``texts`` those two are left out. With ``alter`` every tenth document is made periodic first, as the query asks.
    """
    ship_code(docs.sparkSession)
    short_batches(docs.sparkSession)
    rows = texts_of(docs)
    fields = StructType.fromDDL(FIELDS).fields[: None if texts else -2]
    schema = StructType(rows.select("doc_id").schema.fields + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                made = describe(part.column(0).to_pylist(), part.column(1).to_pylist(), shortest, alter)
                arrays = [part.column(0), *(pa.array(x, pa.binary()).cast(f.type) if f.name == "collapsed" else pa.array(x, f.type) for x, f in zip(made, list(arrow)[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(run, schema)
