"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints with at most 4 differing bits have a third within 2 bits of both. Emitting the whole ball of
64-bit variants within 2 bits takes 2,081 rows for each fingerprint. So the bits are cut in three parts, and
the ball is taken on two of them at a time: at most 2 of the 4 differing bits lie outside the part that differs
most, so on the other two parts some variant is within 1 bit of both. That takes 131 rows, and loses no link.

Distinct fingerprints are shuffled on their variants. A variant that at most ``CROWD`` share has its pairs
compared bit by bit. A larger crowd is covered by pivots, which settles it unless pieces stay apart that could
still be near; the members of an unsettled crowd go to the whole 64-bit ball, where all that share a variant
are linked by definition and each links to the first. No group's pairs are ever enumerated. Components are
then found on the links, and the smallest doc_id names each.

A null text counts as empty; texts without words have fingerprint zero and link like any other. Rows with a
null doc_id take part, but name a component only if no other row is in it (component_id is then null).
Repeated rows share everything. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import long_batches, ship_code, written
from verdigris.llm.common import connected_components, document_key, hub_join, per_text, texts_of

SHINGLE, RADIUS, SEED, CROWD = 4, 4, 42, 32
#: The bits of every octet, lowest first.
OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PARTS = [(0, 21), (21, 42), (42, 64)]


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words (of all words, if fewer), joined by single spaces."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    starts = [0, *accumulate(map(len, words), lambda at, n: at + n + 1, initial=0)][1:]  # of each word, and one past the end
    found = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]
    return np.array(found, dtype=np.uint64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bits set in more than half of the shingles' hashes, as a signed 64-bit number."""
    hashes = shingle_hashes(text, size)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ OCTET_BITS for k in range(8)])
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint (a signed long) of every document."""
    return per_text(docs, lambda texts: [[fingerprint(t, size) for t in texts]], "fp long")


def masks(bits: list[int], most: int) -> np.ndarray:
    """All 64-bit masks with at most ``most`` of the given bits set."""
    return np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(bits, k)], dtype=np.uint64)


def ball_keys(radius: int, whole: bool) -> list[tuple[np.uint64, np.ndarray]]:
    """(bits kept, masks of the ball) for each way to look: all bits at once, or two parts of three.

    Of ``radius`` differing bits at most a third's round-down times two lie in the two parts that differ least.
    """
    if whole:
        return [(np.uint64(2**64 - 1), masks(list(range(64)), (radius + 1) // 2))]
    ways = []
    for low, high in PARTS:
        kept = [b for b in range(64) if not low <= b < high]
        ways.append((np.uint64(sum(1 << b for b in kept)), masks(kept, (2 * radius // 3 + 1) // 2)))
    return ways


def variants(rows: DataFrame, radius: int, whole: bool) -> DataFrame:
    """(key, fp): every fingerprint with each of its variants."""
    ways = ball_keys(radius, whole)
    step = max(1, 500_000 // sum(len(m) for _, m in ways))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), step):
                fp = every[i : i + step]
                keys = np.concatenate([((fp & keep)[:, None] ^ ball[None, :]).reshape(-1) for keep, ball in ways])
                owner = np.concatenate([np.repeat(fp, len(ball)) for _, ball in ways])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owner.view(np.int64))], ["key", "fp"])

    return rows.select("fp").mapInArrow(run, "key long, fp long")


class SpanningLinks:
    """Passes on a link only if it joins what earlier ones left apart; forgets what it saw beyond ``most`` nodes."""

    def __init__(self, most: int = 500_000) -> None:
        self.above: dict[int, int] = {}
        self.most = most

    def top(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def new(self, pairs: np.ndarray) -> np.ndarray:
        """The rows of ``pairs`` that join two groups, larger member first."""
        if len(self.above) > self.most:
            self.above.clear()
        kept = []
        for a, b in pairs.tolist():
            x, y = self.top(a), self.top(b)
            if x != y:
                self.above[max(x, y)] = min(x, y)
                self.above.setdefault(min(x, y), min(x, y))
                kept.append((max(a, b), min(a, b)))
        return np.array(kept, dtype=np.int64).reshape(-1, 2)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every a with every b."""
    return np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64))


def links_of_run(fp: np.ndarray, radius: int, crowd: int) -> np.ndarray | None:
    """Links that connect all within ``radius`` among the rows of one key; None if that would take all pairs.

    A crowded run is covered by pivots, to which all near are linked. If the pivots end in one piece, or in
    pieces too far apart for any two rows of them to be near, those links are enough.
    """
    if len(fp) <= crowd:
        i, j = np.nonzero(np.tril(distances(fp, fp) <= radius, -1))
        return np.stack((fp[i], fp[j]), axis=1)
    pivots, rest = [], fp
    while len(rest):
        if len(pivots) == crowd:
            return None
        pivots.append(rest[0])
        rest = rest[np.bitwise_count((rest ^ rest[0]).view(np.uint64)) > radius]
    pivot = np.array(pivots, dtype=np.int64)
    near = distances(fp, pivot) <= radius
    first = near.argmax(axis=1)
    links = [np.stack((fp, pivot[first]), axis=1)]
    piece = np.arange(len(pivot))
    for k in range(1, len(pivot)):  # rows near two pivots join these
        for j in np.unique(first[near[:, k] & (first != k)]):
            row = np.flatnonzero(near[:, k] & (first == j))[0]
            links.append(np.array([[fp[row], pivot[k]]], dtype=np.int64))
            piece[piece == max(piece[j], piece[k])] = min(piece[j], piece[k])
    apart = piece[:, None] != piece[None, :]
    return None if (apart & (distances(pivot, pivot) <= 3 * radius)).any() else np.concatenate(links)


def whole_runs(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """For each batch the runs of keys with several rows, of rows (key, fp) sorted by key: fingerprints, and whether that is all.

    A run that reaches ``most`` rows is given in pieces of that size, none of which is all of it.
    """
    held, key, split = [np.zeros(0, dtype=np.int64)], None, False
    for batch in batches:
        keys, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        runs = []
        if keys[0] != key:
            runs.append((np.concatenate(held), not split))
            held, split = [np.zeros(0, dtype=np.int64)], False
        sizes = np.diff(edges)
        if len(sizes) > 1:
            runs.append((np.concatenate([*held, fp[: edges[1]]]), not split))
            held, split = [], False
            inner = np.flatnonzero(sizes[1:-1] > 1) + 1
            runs += [(fp[edges[k] : edges[k + 1]], True) for k in inner]
        held.append(fp[edges[-2] :])
        key = keys[-1]
        if sum(map(len, held)) >= most:
            runs.append((np.concatenate(held), False))
            held, split = [np.zeros(0, dtype=np.int64)], True
        yield [(np.unique(r), whole) for r, whole in runs if len(r) > whole]
    yield [(np.unique(np.concatenate(held)), not split)]


def pairs_of_runs(batches: Iterator[pa.RecordBatch], radius: int, crowd: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (key, fp) that come sorted by key; (a, null) for members of unsettled crowds."""
    spanning = SpanningLinks()
    for runs in whole_runs(batches, most):
        links, unsettled = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for fp, whole in runs:
            found = links_of_run(fp, radius, crowd) if whole else None
            if found is None:
                unsettled.append(fp)
            elif len(found):
                links.append(found[found[:, 0] != found[:, 1]])
        found = spanning.new(np.concatenate(links))
        yield _links(found[:, 0], found[:, 1])
        yield _links(np.unique(np.concatenate(unsettled)), None)


def stars_of_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links from every row of a key to the key's first, of rows (key, fp) that come sorted by key."""
    head, spanning = None, SpanningLinks()
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        first = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        center = fp[start]
        if head and head[0] == key[0]:
            center = np.where(key == key[0], head[1], center)
        head = (key[-1], center[-1])
        near = (np.bitwise_count((fp ^ center).view(np.uint64)) <= radius) & (fp != center)
        found = spanning.new(np.unique(np.stack((fp, center), axis=1)[near], axis=0))
        yield _links(found[:, 0], found[:, 1])


def _links(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], ["a", "b"])


def near_links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``radius`` bits of each other."""
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows that become many

    def by_key(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key")

    rows = variants(distinct.select("fp").repartition(spread, "fp"), radius, whole=False)
    with long_batches(distinct.sparkSession):
        found = written(by_key(rows).mapInArrow(lambda x: pairs_of_runs(x, radius, crowd), "a long, b long").distinct())
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    stars = by_key(variants(crowded.repartition(spread, "fp"), radius, whole=True)).mapInArrow(lambda x: stars_of_runs(x, radius), "a long, b long")
    return found.where("b is not null").unionByName(stars)


def classes_of(docs: DataFrame, size: int, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, __key, fp) of every row, then (fp, root, component_id, n) of every fingerprint, and the number of rows."""
    ship_code(docs.sparkSession)
    texts = texts_of(docs).select(F.struct("doc_id", document_key().alias("__key")).alias("doc_id"), "text")
    made = written(fingerprints(texts, size).select("doc_id.*", "fp"))
    distinct = written(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = connected_components(near_links(distinct, radius))
    rooted = written(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    fingers, rows = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    return made, written(hub_join(rooted, named, "root", fingers).select("fp", "root", "component_id", F.col("rows").alias("n"))), rows


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    made, classes, rows = classes_of(docs, size, radius)
    return hub_join(made, classes, "fp", rows, by_place=True).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with the columns of ``docs``: that with the smallest doc_id (null last), then digest of id and text.

    Rows alike in id and text are one document, of which the row that comes first as JSON stays. Texts that share an id
    but are not near each other both stay.
    """
    made, classes, rows = classes_of(docs, size, radius)
    named = hub_join(made, classes.drop("component_id"), "fp", rows, by_place=True).groupBy("root", "doc_id", "__key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key", "n")).alias("first")
    stay = written(named.groupBy("root").agg(first).select(F.col("first.__key").alias("__stays"), (F.col("first.n") > 1).alias("__again")))
    keyed = docs.withColumn("__key", document_key())
    single = keyed.join(stay.where("not __again"), F.col("__key") == F.col("__stays")).select(*docs.columns)
    row = F.struct(*docs.columns)
    again = keyed.join(stay.where("__again"), F.col("__key") == F.col("__stays")).groupBy("__key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return single.unionByName(again)
