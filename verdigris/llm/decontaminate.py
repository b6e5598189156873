"""Benchmark decontamination with an FM-index over each shard of the training texts.

A shard is a bounded run of texts within a partition. Its words are numbered by the benchmark's vocabulary;
stretches that cannot hold a test phrase (words outside the vocabulary, or too few in a row) become a
separator, and an FM-index is built of the rest: suffix array, Burrows-Wheeler transform, a wavelet matrix
for ranks, and sampled suffix positions. All test phrases are searched backward at once, their occurrences
located by walking to a sampled position, and the spans merged. Phrases compare words exactly.

The benchmark streams through the driver in blocks of at most ``BLOCK_WINDOWS`` phrases, long items in parts. Each block is
broadcast for one pass over the texts and given up before the next, so its size is never assumed. Null and empty texts
have no words and no hits; items without words are no phrases; a null item_id is ignored. Repeated rows get equal
results; empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import delete_shared, ship_code, short_batches, written, written_at
from verdigris.llm.common import let_go, sliced

#: Words of a window, UTF-8 bytes of text in a shard, phrases in a broadcast, and the distance of sampled suffix positions.
WINDOW, SHARD_BYTES, BLOCK_WINDOWS, SAMPLE = 10, 4_000_000, 200_000, 8

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Every byte that is in no word becomes a space; letters A-Z become lower case.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the words of a text."""
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return [m.span() for m in _WORD.finditer(lower)]


class Phrases:
    """Test phrases: the windows of a block of items (id, words) over their vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.symbols = np.zeros((len(found), window), dtype=np.int64)
        for row, phrase in zip(self.symbols, found):
            row[window - len(phrase) :] = phrase
        self.shortest = int(self.sizes.min()) if len(found) else 0


class FMIndex:
    """An FM-index of a sequence of symbols; 0 ends it and 1 separates runs, which no phrase crosses."""

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE) -> None:
        """``sequence`` holds symbols from 1 on and begins and ends with a separator."""
        text = np.append(sequence, 0)
        n = len(text)
        # Separators are told apart by their place, so suffixes differ within a run's length.
        apart = text == 1
        rank = np.where(apart, np.cumsum(apart), text + int(apart.sum()))
        rank[-1] = 0
        step = 1
        while True:
            key = rank * (int(rank.max()) + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            if new[-1] == n - 1 or step >= n:
                break
            step *= 2
        self.bwt = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        # Sampled: a run's first symbol, every ``sample``-th after it, and the separators themselves.
        since = np.arange(n) - np.maximum.accumulate(np.where(text <= 1, np.arange(n), 0))
        marked = (since % sample == 1) | (text <= 1) if sample > 1 else np.ones(n, dtype=bool)
        self.position = np.where(marked[order], order, -1)
        self.ones, self.zeros = [], []
        column = self.bwt
        for level in reversed(range(self.levels)):
            bit = (column >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(n - int(bit.sum()))
            column = np.concatenate((column[bit == 0], column[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``at`` entries of the transform, level by level."""
        low = np.zeros_like(at)
        for i, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            ones = self.ones[i]
            low = np.where(one, self.zeros[i] + ones[low], low - ones[low])
            at = np.where(one, self.zeros[i] + ones[at], at - ones[at])
        return at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of right-aligned rows of symbols (0: none): bounds of the matching suffixes."""
        first, last = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), len(self.bwt), dtype=np.int64)
        last[(phrases >> self.levels).any(axis=1)] = 0  # a symbol beyond those of the sequence
        for column in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((first < last) & (phrases[:, column] > 0))
            if not len(live):
                break
            symbol = phrases[live, column]
            first[live] = self.before[symbol] + self.rank(symbol, first[live])
            last[live] = self.before[symbol] + self.rank(symbol, last[live])
        return first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes, by steps back to a sampled one."""
        out, steps = np.full(len(rows), -1, dtype=np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            here = self.position[rows]
            done = here >= 0
            out[todo[done]] = here[done] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.bwt[rows]
            rows = self.before[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def search_shard(texts: list[str], phrases: Phrases) -> tuple[list[int], dict[int, list[tuple[int, int, int]]]]:
    """Words of each text, and for texts with hits the occurrences (first word, end, phrase)."""
    get = phrases.vocabulary.get
    numbers, sizes = [np.zeros(0, dtype=np.int64)], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        numbers.append(np.fromiter((get(w, 1) for w in words), dtype=np.int64, count=len(words)))
        numbers.append(np.ones(1, dtype=np.int64))
    if not len(phrases.sizes) or not texts:
        return sizes, {}
    every = np.concatenate(numbers)
    # Runs of vocabulary words that are long enough for a phrase, each between separators.
    known = np.concatenate(([False], every > 1, [False]))
    starts, ends = np.flatnonzero(~known[:-1] & known[1:]), np.flatnonzero(known[:-1] & ~known[1:])
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return sizes, {}
    lengths = ends - starts
    offsets = np.cumsum(lengths + 1) - lengths  # of the runs in the index's sequence; a separator precedes each
    places = np.repeat(starts - offsets, lengths) + (np.arange(lengths.sum()) + np.repeat(np.arange(1, len(lengths) + 1), lengths))
    sequence = np.ones(int((lengths + 1).sum()) + 1, dtype=np.int64)
    origin = np.zeros(len(sequence), dtype=np.int64)
    inside = places - np.repeat(starts - offsets, lengths)
    sequence[inside], origin[inside] = every[places], places
    index = FMIndex(sequence)
    first, last = index.search(phrases.symbols)
    count = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = origin[index.locate(rows)]
    heads = np.cumsum([0, *(n + 1 for n in sizes)])
    of = np.searchsorted(heads, begin, side="right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for text, at, phrase in zip(of.tolist(), (begin - heads[of]).tolist(), which.tolist()):
        found.setdefault(text, []).append((at, at + int(phrases.sizes[phrase]), phrase))
    return sizes, found


def merged(spans: list) -> list[list[int]]:
    """Sorted spans (start, end), those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def benchmark_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id, words) in blocks of at most ``most`` windows, one block at least; rows stream to the driver."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    for item, text in items.toLocalIterator():
        words = words_of(text)
        at, windows = 0, max(1, len(words) - window + 1) if words else 0
        while at < windows:
            if size == most:
                yield block
                block, size = [], 0
            n = min(most - size, windows - at)
            block.append((item, words[at : at + n + window - 1]))
            at, size = at + n, size + n
    yield block


def searched(docs: DataFrame, benchmark: DataFrame, window: int, most: int, remove: bool = False) -> tuple[DataFrame, bool]:
    """``docs`` with __text (null: empty), __n_words, __hits (merged word spans) and __items (ids with occurring windows).

    Each block of phrases takes one pass, which adds its hits to those before; with several, a pass is written before the
    next, without __text, and the one before it deleted, so that never more than two are there. With ``remove`` the last pass takes the hits out of __text, and searches changed texts again if it is the only
    one, which comes second.
    """
    spark = docs.sparkSession
    ship_code(spark)
    short_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    now = docs.withColumns({"__text": text, "__n_words": F.lit(0).cast("long"), "__hits": F.array().cast("array<array<bigint>>"), "__items": F.array().cast("array<string>")})
    blocks, only = benchmark_blocks(benchmark, window, most), True
    block, before = next(blocks), None
    while True:
        following = next(blocks, None)
        only = only and following is None
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        now = now.mapInArrow(_searcher(shared, remove and following is None, only), now.schema)
        if following is None:
            return now, only
        kept, folder = written_at(now.drop("__text"))
        if before:
            delete_shared(spark, before)
        now, block, before = kept.withColumn("__text", text), following, folder
        shared.destroy()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The partition's rows in tables of about ``SHARD_BYTES`` of text."""
    parts, size = [], 0
    for batch in batches:
        for part in sliced(batch, "__text", SHARD_BYTES // 4):
            parts.append(part)
            size += sum(pc.binary_length(part.column("__text")).to_pylist())
            if size >= SHARD_BYTES:
                yield pa.Table.from_batches(parts)
                parts, size = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


def _with(table: pa.Table, **columns: list) -> Iterator[pa.RecordBatch]:
    """The table with columns replaced, as batches."""
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        table = table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))
    return iter(table.combine_chunks().to_batches())


def _searcher(shared, remove: bool, only: bool):
    """The task of one pass: the phrases of one block, searched in an index of each shard; ``remove`` as in ``searched``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        phrases = shared.value
        for table in _shards(batches):
            texts = table["__text"].to_pylist()
            sizes, found = search_shard(texts, phrases)
            hits, items = table["__hits"].to_pylist(), table["__items"].to_pylist()
            for i, spans in found.items():
                hits[i] = merged([*hits[i], *([a, b] for a, b, _ in spans)])
                items[i] = sorted({*items[i], *(x for *_, p in spans for x in phrases.items[p])})
            todo = {i: spans for i, spans in enumerate(hits) if spans} if remove else {}
            while todo:
                for i, spans in todo.items():
                    texts[i] = without_words(texts[i], spans)
                again = search_shard([texts[i] for i in todo], phrases)[1] if only else {}
                todo = {i: merged([a, b] for a, b, _ in again[k]) for k, i in enumerate(todo) if k in again}
            yield from _with(table, __text=texts, __n_words=sizes, __hits=hits, __items=items)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    n_hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
    return searched(docs.select("doc_id", "text"), benchmark, window, most)[0].select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__hits") > 0).alias("contaminated"),
    )


def without_words(text: str, hits: list) -> str:
    """A text less the given word spans; a line break stands where a span was."""
    spans = word_spans(text)
    out, at = [], 0
    for first, end in hits:
        out += [text[at : spans[first][0]], "\n"]
        at = spans[end - 1][1]
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows and columns of ``docs``; their texts without any words inside occurrences of test phrases.

    Removing a span can bring two halves of a phrase together, so changed texts are searched again until
    nothing is found. Texts without hits stay as they are; null texts stay null.
    """
    text = F.when(F.col("text").isNotNull(), F.col("__text").cast(docs.schema["text"].dataType))
    while True:
        found, only = searched(docs, benchmark, window, most, remove=True)
        cleaned = found.withColumn("text", text)
        if only:
            return cleaned.select(*docs.columns)
        cleaned = written(cleaned)
        docs = cleaned.select(*docs.columns)
        if not cleaned.where(F.size("__hits") > 0).take(1):
            return docs
