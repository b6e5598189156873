"""Line dedup by a segment-partition edit join.

Every line with a word (a letter or digit) takes part: equal lines are one class. Lines of at least ``LEAST_NEAR``
code points are also linked to those within a few edits (``edits``: one for every ``SHARE`` code points of the
shorter line, one at least and ``MOST`` at most; in lines under ``LEAST_NEAR`` one edit is too large a share). The
components of the links are classes; of every class the first line (smallest doc_id, then place) stays and all
other occurrences go, in the same document too.

A line is split into one segment more than the edits it allows, so a near line has one of them whole. Lengths are
cut in classes with one layout of segments each. A line gives its segments in its own class, and in those of shorter
lines that may be near, at every place to which the edits can have moved them; of places next to each other the
smallest substring stands for both, which keeps the keys few and loses no pair. Rows meet by these keys; those that
meet are candidates if lengths and counts of characters allow it, and a banded bit-parallel edit distance verifies them.

A key whose rows make more than ``CROWD`` candidates each brings its texts together instead, in blocks: each is held
against pivots, and against other lines only where these may link two groups. No link is lost.

Null and empty texts have no lines to drop. Documents alike in doc_id and text are one document: each row of it
gets the same result. A null doc_id sorts before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import cut, long_batches, ship_code, short_batches, written
from verdigris.llm.common import connected_components, document_key, hub_join, let, let_go, sliced, texts_of

#: ``TAU`` may be a fixed number of edits; None lets it grow with the line.
TAU, SHARE, MOST, LEAST_LINE, LEAST_NEAR, CROWD = None, 40, 8, 1, 20, 64
#: Rows of a crowded key that are held against each other in one task, and rows of a key beyond which it is crowded.
BLOCK, HELD = 1024, 1_000_000
#: Kinds of characters that a line's signature counts, four bits each.
KINDS = 8
#: As many lines are sent to every task; more are joined by shuffle.
FEW_LINES = 300_000
#: A letter or digit of any script.
WORD = r"[\p{L}\p{N}]"


def edits(length: int, tau: int | None = TAU) -> int:
    """How many edits may lie between a line of that length and one at least as long."""
    return min(MOST, max(1, length // SHARE)) if tau is None else tau


def most_edits(lengths: np.ndarray, tau: int | None = TAU) -> np.ndarray:
    """``edits`` of an array of lengths."""
    return np.minimum(MOST, np.maximum(1, lengths // SHARE)) if tau is None else np.full(len(lengths), tau)


@lru_cache(maxsize=64)
def length_classes(longest: int, least: int, tau: int | None) -> list[int]:
    """The least length of each class of lengths; all lengths of a class have the same number of edits."""
    out, low = [], max(least, edits(least, tau) + 1)
    while low <= longest:
        out.append(low)
        high = low + max(1, low // 3)
        low = next((n for n in range(low + 1, high) if edits(n, tau) != edits(low, tau)), high)
    return out


def differing(a: str, b: str) -> tuple[str, str]:
    """Two texts, the longer first, without their common beginning and end (found by halves)."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    low, high = 0, len(b)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    return a[: len(a) - low], b[: len(b) - low]


def codes_of(texts: list[str], before: int, length: int) -> np.ndarray:
    """Code points by place and text, from ``before`` places ahead of the texts on; 0 where there is none (a text's are one more)."""
    out = np.zeros((before + length, len(texts)), dtype=np.uint32)
    for i, text in enumerate(texts):
        out[before : before + len(text), i] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + 1
    return out


def edit_distances(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Edits between the texts of each pair, or most + 1 if there are more: bit-parallel in a band, all pairs at once.

    Bits of a word are the diagonals of the band, from the lowest down; vertical differences go from column to column
    of the shorter text, and the diagonal that ends in the last cell is summed. Pairs beyond their most leave early.
    """
    pairs = [differing(a, b) for a, b in zip(left, right)]
    out = np.array([len(a) if not b else len(a) - len(b) for a, b in pairs], dtype=np.int64)
    todo = np.array([i for i, (_, b) in enumerate(pairs) if b and out[i] <= most[i]], dtype=np.int64)
    todo = todo[np.argsort([-len(pairs[i][1]) for i in todo], kind="stable")] if len(todo) else todo
    while len(todo):  # long pairs first; as many at a time as have a few million code points
        longest = len(pairs[todo[0]][1])
        some, todo = np.split(todo, [max(1, 2_000_000 // (longest + 64))])
        out[some] = _distances([pairs[i][0] for i in some], [pairs[i][1] for i in some], most[some])
    return np.minimum(out, most + 1)


def _distances(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """``edit_distances`` of pairs sorted by falling length of b, which is no longer than a."""
    band, one = int(most.max()), np.uint64(1)
    n = np.array([len(x) for x in b])
    over = np.array([len(x) for x in a]) - n
    rows, columns = codes_of(a, band, int(n[0]) + 2 * band + 1), codes_of(b, 0, int(n[0]))
    result = over.copy()
    live = np.arange(len(a))
    score, diagonal = over.copy(), (63 - band + over).astype(np.uint64)
    up = np.full(len(a), ((1 << (band + 1)) - 1) << (63 - band), dtype=np.uint64)
    down = np.zeros(len(a), dtype=np.uint64)
    weights = (np.uint64(1) << (63 - 2 * band + np.arange(2 * band + 1)).astype(np.uint64))[:, None]
    for j in range(int(n[0])):
        ends = int(np.searchsorted(-n, -j))  # those before it have more than j columns
        if ends < len(live) or j % 32 == 31:
            result[live] = score
            stay = (np.arange(len(live)) < ends) & (score <= most)
            rows, columns = rows[:, stay], columns[:, stay]
            live, score, diagonal, up, down, n, most = (x[stay] for x in (live, score, diagonal, up, down, n, most))
            if not len(live):
                return result
        same = np.bitwise_or.reduce((rows[j : j + 2 * band + 1] == columns[j]) * weights, axis=0)
        zero = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(zero | up), zero & up
        score = score + 1 - ((zero >> diagonal) & one).astype(np.int64)
        moved = zero >> one
        up, down = left | ~(moved | right), moved & right
    result[live] = score
    return result


def near(left: list[str], right: list[str], tau: int | None) -> np.ndarray:
    """Whether the two lines of each pair are within the edits they allow."""
    most = most_edits(np.minimum([len(x) for x in left], [len(x) for x in right]).astype(np.int64), tau)
    return edit_distances(left, right, most) <= most


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(__key, doc_id, number, line) of the lines that take part: with a letter or digit, and of ``least`` code points."""
    keyed = texts_of(docs).withColumn("__key", document_key())  # before the lines are told apart: once for each text
    lines = keyed.select("__key", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
    begins = F.substring("line", 1, 64).rlike(WORD)  # most lines show it early
    return lines.where((F.length("line") >= least) & (begins | F.col("line").rlike(WORD)))


def name_of(line: str) -> Column:
    """64 bits for a line while candidates are looked for; verification is on the texts."""
    return F.xxhash64(line)


def id_of(line: str) -> Column:
    """The 16 bytes that stand for a line's text."""
    return F.unhex(F.md5(line))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash's base and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(length, x, dtype=np.uint64)))) for x in (base, pow(base, -1, 2**64)))


def smallest_hashes(codes: np.ndarray, k: int, window: int) -> np.ndarray:
    """For every place the smallest hash of the ``window`` substrings of k codes that begin there or next."""
    n = len(codes)
    up, down = powers(1 << max(16, n.bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * up[:n], out=sums[1:])
    least = sums[k:] - sums[:-k]
    least *= down[: n - k + 1]
    least ^= least >> np.uint64(32)
    least *= np.uint64(0xFF51AFD7ED558CCD)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (window - span)], least[window - span :]) if span < window else least


def segment_keys(codes: np.ndarray, sizes: np.ndarray, low: int, t: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lines): the segments of a class of lines, given one after another as codes, where the edits may have moved them.

    The segments are t + 1 of width low // (t + 1), the first half counted from a line's beginning, the rest from its end.
    Of two lines within t edits some segment i is whole in both, with i edits before it and at most t - i after it, and so
    moved by at most i from the one end and t - i from the other. Neighbouring places share their smallest substrings.
    """
    width = low // (t + 1)
    window = max(1, width // 3) if t > 1 else 1
    least = smallest_hashes(codes, width - window + 1, window)
    segment = np.repeat(np.arange(t + 1), [2 * min(i, t - i) + 1 for i in range(t + 1)])
    shift = np.concatenate([np.arange(-min(i, t - i), min(i, t - i) + 1) for i in range(t + 1)])
    fixed = np.where(segment <= t // 2, segment, segment - t - 1) * width + shift
    place = fixed[None, :] + np.where(segment <= t // 2, 0, 1)[None, :] * sizes[:, None]
    inside = (place >= 0) & (place + width <= sizes[:, None])
    begin = np.cumsum(sizes) - sizes
    found = np.where(inside, least[np.clip(place + begin[:, None], 0, len(least) - 1)], np.uint64(0))
    found = found ^ _mixed((segment + 64 * (salt + 1)).astype(np.uint64))[None, :]
    new = inside.copy()
    new[:, 1:] &= (found[:, 1:] != found[:, :-1]) | ~inside[:, :-1]
    line, at = np.nonzero(new)
    return found[line, at], line


def segment_rows(docs: DataFrame, tau: int | None, least: int) -> DataFrame:
    """(key, about, line): a row for every key of every line, repeats in a slice once; ``about`` has length and signature.

    The signature has the counts of ``KINDS`` kinds of characters, modulo 16: an edit changes at most two, by one.
    A line takes part in its own class of lengths and in those of shorter lines that may be near.
    """
    schema = pa.schema([("key", pa.int64()), ("about", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in sliced(batch, "line"):
                names, first = np.unique(part.column("name").to_numpy(), return_index=True)
                sizes = pc.utf8_length(part.column("line")).to_numpy().astype(np.int64)[first]
                order = np.argsort(sizes, kind="stable")  # lines of a class follow each other
                names, sizes = names[order], sizes[order]
                texts = part.column("line").take(pa.array(first[order]))
                codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                ends = np.cumsum(sizes)
                kinds = np.repeat(np.arange(len(sizes)) * KINDS, sizes) + codes % np.uint32(KINDS)
                counts = np.bincount(kinds, minlength=len(sizes) * KINDS).reshape(-1, KINDS) & 15
                about = (sizes << 32) | (counts << 4 * np.arange(KINDS)).sum(axis=1)
                lows = np.array(length_classes(1 << int(sizes[-1]).bit_length(), least, tau))
                shortest = np.maximum(np.searchsorted(lows, sizes - most_edits(sizes, tau), side="right") - 1, 0)
                for c, low in enumerate(lows.tolist()):
                    a, b = np.searchsorted(sizes, low), np.searchsorted(shortest, c, side="right")
                    if a < b:
                        keys, line = segment_keys(codes[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], low, edits(low, tau), c)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(about[a:b][line]), pa.array(names[a:b][line])], schema=schema)

    return lines_of(docs, least).select(name_of("line").alias("name"), "line").mapInArrow(run, "key long, about long, line long")


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the differences of the counts in two arrays of signatures, going round at 16."""
    total = np.zeros(len(a), dtype=np.int64)
    for k in range(KINDS):
        d = ((a >> 4 * k) - (b >> 4 * k)) & 15
        total += np.minimum(d, 16 - d)
    return total


def candidates_of_keys(batches: Iterator[pa.RecordBatch], tau: int | None, crowd: int, limit: int = HELD) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b, null) of rows sorted by key, about and line; (a, null, key) for all lines of crowded keys."""

    def pairs(key: np.ndarray, about: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate((np.ones(min(1, len(key)), dtype=bool), (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
        key, about, line = key[new], about[new], line[new]
        run = np.cumsum(np.concatenate((np.zeros(min(1, len(key)), dtype=np.int64), key[1:] != key[:-1])))
        members = np.bincount(run)
        hits, full = np.zeros(len(members), dtype=np.int64), np.zeros(len(members), dtype=bool)
        size = about >> 32
        most = most_edits(size, tau)
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        at, step = np.arange(len(key)), 1
        while len(at):  # every row and the step-th after it, as long as that has the key and is not too long
            at = at[at + step < len(key)]
            at = at[(run[at] == run[at + step]) & (size[at + step] - size[at] <= most[at]) & ~full[run[at]]]
            met = at[_far(about[at], about[at + step]) <= 2 * most[at]]
            left.append(met)
            right.append(met + step)
            hits += np.bincount(run[met], minlength=len(hits))
            full |= hits > crowd * members
            step += 1
        i, j = np.concatenate(left), np.concatenate(right)
        keep = ~full[run[i]]
        a, b = line[i[keep]], line[j[keep]]
        two = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)
        many = np.flatnonzero(full[run]) if len(key) else np.zeros(0, dtype=np.int64)
        a = pa.array(np.concatenate((two[:, 0], line[many])))
        b = pa.concat_arrays([pa.array(two[:, 1]), pa.nulls(len(many), pa.int64())])
        crowded = pa.concat_arrays([pa.nulls(len(two), pa.int64()), pa.array(key[many])])
        return pa.RecordBatch.from_arrays([a, b, crowded], ["a", "b", "key"])

    def all_crowded(key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        line = np.unique(line)
        return pa.RecordBatch.from_arrays([pa.array(line), pa.nulls(len(line), pa.int64()), pa.array(np.full(len(line), key[0]))], ["a", "b", "key"])

    held: list[list[np.ndarray]] = []
    flowing = None  # a key that has had too many rows to hold
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(rows[0]):
            continue
        if flowing is not None:
            same = int(np.searchsorted(rows[0], flowing, side="right"))
            if same:
                yield all_crowded(rows[0][:same], rows[2][:same])
            rows = [x[same:] for x in rows]
            if not len(rows[0]):
                continue
            flowing = None
        edge = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
        if held and (edge or held[-1][0][-1] != rows[0][0]):
            yield pairs(*(np.concatenate(x) for x in zip(*held, [x[:edge] for x in rows])))
            held = []
        elif edge:
            yield pairs(*(x[:edge] for x in rows))
        held.append([x[edge:] for x in rows])
        if sum(len(x[0]) for x in held) > limit:
            flowing = held[0][0][0]
            yield all_crowded(held[0][0], np.concatenate([x[2] for x in held]))
            held = []
    if held:
        yield pairs(*(np.concatenate(x) for x in zip(*held)))


def pair_counts(text: str) -> np.ndarray:
    """Counts of pairs of neighbouring characters, in 128 kinds; an edit changes at most four of them, by one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount((codes[:-1] * np.uint32(31) + codes[1:]) % 128, minlength=128).astype(np.int32)


def links_of_crowd(lines: list[tuple[bytes, str, list[int], int]], tau: int | None, step: int = 64) -> list[tuple[bytes, bytes]]:
    """Links that connect all of the lines (id, text, keys, block) within the edits they allow.

    Pairs with a key in common, or of one block where there are two, are left to another task. Lines come in steps, the
    most typical first. Each is held against the pivots so far; where none is near it becomes one. Then it is held
    against earlier lines of groups other than its own. Counts of pairs of characters tell most that are too far.
    """
    counts = np.array([pair_counts(text) for _, text, _, _ in lines]).reshape(-1, 128)
    order = np.argsort(np.abs(counts - np.median(counts, axis=0)).sum(axis=1), kind="stable") if lines else []
    lines, counts = [lines[i] for i in order], counts[order]
    most = most_edits(np.array([len(text) for _, text, _, _ in lines], dtype=np.int64), tau)
    number = {k: n for n, k in enumerate(sorted({k for *_, keys, _ in lines for k in keys}))}
    keys = np.zeros((len(lines), len(number)), dtype=bool)
    for row, (*_, mine, _) in zip(keys, lines):
        row[[number[k] for k in mine]] = True
    block = np.array([b for *_, b in lines])
    two = len(set(block.tolist())) > 1
    above, pivots, links = np.arange(len(lines)), [], []

    def top(x: int) -> int:
        while above[x] != x:
            x = above[x]
        return x

    def maybe(i: int, others: np.ndarray) -> np.ndarray:
        others = others[~(keys[others] & keys[i]).any(axis=1) & (not two or (block[others] != block[i]))]
        return others[np.abs(counts[others] - counts[i]).sum(axis=1) <= 4 * np.minimum(most[others], most[i])]

    def join(pairs: list[tuple[int, int]]) -> None:
        found = near([lines[i][1] for i, _ in pairs], [lines[j][1] for _, j in pairs], tau) if pairs else []
        for i, j in np.array(pairs, dtype=np.int64).reshape(-1, 2)[found]:
            if top(i) != top(j):
                above[top(i)] = top(j)
                links.append((lines[i][0], lines[j][0]))

    for begin in range(0, len(lines), step):
        some = range(begin, min(begin + step, len(lines)))
        join([(i, j) for i in some for j in maybe(i, np.array(pivots, dtype=np.int64))])
        pivots += [i for i in some if top(i) == i]
        groups = np.array([top(i) for i in range(some.stop)])
        join([(i, j) for i in some for j in maybe(i, np.flatnonzero(groups[:i] != groups[i]))])
    return links


def crowd_links(crowded: DataFrame, texts: DataFrame, tau: int | None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of line ids among the rows (line, key) of each key.

    A key of more than ``block`` rows is cut in blocks, and every two blocks are a task of their own. Each row
    carries the smaller crowded keys of its line, so that two lines meet in the first of their keys alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked() -> pa.RecordBatch:
            found = links_of_crowd(rows, tau)
            return pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.binary()), pa.array([min(x) for x in found], pa.binary())], ["a", "b"])

        last, rows = None, []
        for batch in batches:
            for key, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, x, y) != last:
                    yield linked()
                    last, rows = (key, x, y), []
                rows.append(row)
        yield linked()

    sizes = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    cut_up = hub_join(crowded, sizes, "key", crowded.count())
    keyed = cut_up.groupBy("line").agg(F.array_sort(F.collect_set(F.struct("key", "blocks"))).alias("keys")).join(texts, "line")
    rows = keyed.select("id", "text", "keys", F.posexplode("keys").alias("at", "k"))
    block_of = F.pmod(F.xxhash64("id"), F.col("k.blocks")).cast("int")
    rows = rows.select("id", "text", "k.*", F.slice("keys.key", 1, F.col("at")).alias("lower"), block_of.alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "text", "lower", "block")
    spread = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each
    return rows.repartition(spread, "key", "x", "y").sortWithinPartitions("key", "x", "y", "id").mapInArrow(run, "a binary, b binary")


def line_texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(line, id, text) of the wanted lines, each once. Few are sent to every task; else repeats are combined first."""
    every = lines_of(docs, least).select(name_of("line").alias("line"), F.col("line").alias("text"))
    few = wanted.count() <= FEW_LINES
    found = every.join(F.broadcast(wanted), "line", "left_semi").distinct() if few else every.distinct().join(wanted, "line", "left_semi")
    return found.select("line", id_of("text").alias("id"), "text")


def verified(pairs: DataFrame, texts: DataFrame, tau: int | None) -> DataFrame:
    """Links (a, b) of line ids: the pairs whose texts are within the edits they allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "left"):
                yield part.select([0, 1]).filter(pa.array(near(part.column(2).to_pylist(), part.column(3).to_pylist(), tau)))

    left = texts.select(F.col("line").alias("a"), F.col("id").alias("x"), F.col("text").alias("left"))
    right = texts.select(F.col("line").alias("b"), F.col("id").alias("y"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "left", "right").mapInArrow(run, "a binary, b binary")


def line_links(docs: DataFrame, tau: int | None = TAU, least: int = LEAST_NEAR, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of line ids that connect all distinct lines within the edits they allow."""
    rows = segment_rows(docs, tau, least).repartition("key").sortWithinPartitions("key", "about", "line")
    with long_batches(docs.sparkSession):
        found = written(rows.mapInArrow(lambda x: candidates_of_keys(x, tau, crowd), "a long, b long, key long").distinct())
    wanted = found.select(F.explode(F.array("a", "b")).alias("line")).where("line is not null").distinct()
    texts = written(line_texts(docs, wanted, least))
    crowded = found.where("b is null").select(F.col("a").alias("line"), "key")
    return verified(found.where("b is not null").select("a", "b"), texts, tau).unionByName(crowd_links(crowded, texts, tau, block))


def repeated_lines(docs: DataFrame, tau: int | None, least: int, crowd: int, near: int) -> DataFrame:
    """(id, root, n) of the lines that occur more than once or are linked: their class and occurrences."""
    linked = cut(connected_components(line_links(docs, tau, max(least, near), crowd)))
    members = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    counts = lines_of(docs, least).groupBy(id_of("line").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(members, F.col("id") == F.col("node"), "left").where("n > 1 or root is not null")
    return written(found.select("id", F.coalesce("root", "id").alias("root"), "n"))


def dropped_lines(docs: DataFrame, tau: int | None = TAU, least: int = LEAST_LINE, crowd: int = CROWD, near: int = LEAST_NEAR) -> DataFrame:
    """(__key, __dropped): by document key the lines that go, as (number, doc_id and number of the line that stays)."""
    repeated = repeated_lines(docs, tau, least, crowd, near)
    number, total = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = lines_of(docs, least).withColumn("id", id_of("line")).drop("line")
    rows = every.join(F.broadcast(repeated.drop("n")), "id") if number <= FEW_LINES else hub_join(every, repeated, "id", total)
    rows = written(rows.select("root", "__key", "doc_id", "number"))
    place = F.struct("doc_id", "__key", "number")
    firsts = written(rows.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    gone = hub_join(rows, firsts, "root", total).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("number", F.col("first.doc_id").alias("doc_id"), F.col("first.number").alias("first")))).alias("__dropped"))


def deduplicate_lines(docs: DataFrame, tau: int | None = TAU, least: int = LEAST_LINE, crowd: int = CROWD, near: int = LEAST_NEAR) -> DataFrame:
    """The rows and columns of ``docs``, and __dropped: the lines that go, each with what stays for it (null: none)."""
    ship_code(docs.sparkSession)
    short_batches(docs.sparkSession)
    gone = dropped_lines(docs, tau, least, crowd, near).withColumnRenamed("__key", "__gone")
    keyed = docs.withColumn("__key", document_key())
    return keyed.join(gone, F.col("__key") == F.col("__gone"), "left").select(*docs.columns, "__dropped")


def kept_text() -> Column:
    """The text without its dropped lines, as a column over ``deduplicate_lines``; linear in the lines."""

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped.number"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    return F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(let(F.split(F.col("text"), "\n", -1), kept))
