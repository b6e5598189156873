"""Hard negatives by threshold joins in the manner of L2AP.

Vectors are packed into blocks. In a block the entries of each vector are put into an inverted index (a posting list for each dimension)
from the largest on; what is left out has a norm below the level's bound, so that no row can reach the level's threshold by
it. Anchors accumulate partial scores over the postings. A row whose partial score and remaining norms stay below the
threshold is pruned, the others are scored exactly. While a window of an anchor is not full the threshold is lowered, which adds further
entries to the index; an anchor whose windows are full, by rows of this block or of those before, takes no further part.

Two joins of anchor blocks with all blocks: the first finds the best rows of the anchor's own label (its positives),
the second those of other labels in the window under each positive's score. Anchor blocks are sent to every task while
they are at most ``MOST_SENT`` bytes, and joined by shuffle by block beyond. Each task gives at most the best rows of a window, from
which Spark takes the best of all.

Rows with a null label or vector, or a null or non-finite component, take no part. Shorter vectors count as followed by
zeros. Rows alike in id, label and vector are one row; a null vec_id comes after all others and is no anchor. Components beyond
2**20 in size count as that, so that scores are exact. Other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.session import long_batches, ship_code, written

#: Rows of a block of vectors and of anchors, bytes of anchors sent to every task, pairs scored at once, and how far a level lowers the threshold.
BLOCK, ANCHORS, MOST_SENT, SCORED, LOWERED = 4096, 1024, 16_000_000, 50_000, 0.8
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
LARGEST = 2**20
_NULL_ID = np.iinfo(np.int64).max

_PACKED = "block int, n int, width int, ids binary, known binary, labels binary, cells binary"


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label and cells of the rows that take part; every component as floor(256 x)."""
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * 256), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), cells.alias("cells")).distinct()


def packed(rows: DataFrame, most: int) -> DataFrame:
    """The rows in blocks of about ``most``, one for each partition, written to the shared folder."""
    blocks = max(1, -(-rows.count() // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, labels, cells = (table.column(i).combine_chunks() for i in range(3))
            sizes = cells.value_lengths().to_numpy()
            width = max(1, int(sizes.max()))
            grid = np.zeros((len(sizes), width), dtype=np.int32)
            grid[np.arange(width) < sizes[:, None]] = cells.flatten().to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            arrays = [ids.fill_null(_NULL_ID).to_numpy(), known, labels.to_numpy(), grid]
            head = [TaskContext.get().partitionId(), len(sizes), width]
            names = ["block", "n", "width", "ids", "known", "labels", "cells"]
            yield pa.RecordBatch.from_pydict({**{k: pa.array([x], pa.int32()) for k, x in zip(names, head)}, **{k: [x.tobytes()] for k, x in zip(names[3:], arrays)}})

    with long_batches(rows.sparkSession):
        return written(rows.repartition(blocks).mapInArrow(run, _PACKED))


class Block:
    """Vectors of a block: ids, known (whether the id is not null), labels and cells."""

    def __init__(self, row: dict) -> None:
        n = row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.cells = np.frombuffer(row["cells"], dtype=np.int32).reshape(n, row["width"]).astype(np.float64)

    def of(self, label: int) -> Block:
        """The rows of a label."""
        made, at = Block.__new__(Block), np.flatnonzero(self.labels == label)
        made.ids, made.labels, made.known, made.cells = self.ids[at], self.labels[at], self.known[at], self.cells[at]
        return made


class Windows:
    """The best rows so far, at most ``keep``, for windows (anchor, low, high) of scores: highest score, then smallest id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int) -> None:
        self.low, self.high, self.keep = low, high, keep
        self.score = np.full((len(low), keep), -np.inf)
        self.id = np.full((len(low), keep), _NULL_ID)

    def needed(self) -> np.ndarray:
        """For each window, the least score that could still enter it."""
        return np.maximum(self.low, self.score[:, -1])

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows that lie in windows and have not been added before."""
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        place = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
        best = place < self.keep
        touched = window[first]
        more_score, more_id = np.full((len(touched), self.keep), -np.inf), np.full((len(touched), self.keep), _NULL_ID)
        row = np.searchsorted(touched, window[best])
        more_score[row, place[best]], more_id[row, place[best]] = score[best], ids[best]
        score, ids = np.hstack((self.score[touched], more_score)), np.hstack((self.id[touched], more_id))
        order = np.lexsort((ids, -score), axis=1)[:, : self.keep]
        self.score[touched], self.id[touched] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def levels(sizes: np.ndarray) -> np.ndarray:
    """For each entry of each vector (rows of absolute values) the norm of what comes after it, entries being taken from the largest on."""
    order = np.argsort(-sizes, axis=1, kind="stable")
    squares = np.take_along_axis(sizes, order, 1) ** 2
    after = np.sqrt(np.maximum(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], 0))  # from the entry on, itself included
    made = np.empty_like(after)
    np.put_along_axis(made, order, after, 1)
    return made


def threshold_join(rows: Block, anchors: Block, windows: Windows, owner: np.ndarray, other_label: bool) -> None:
    """Add to the anchors' windows the rows of a block that belong there. ``owner`` has the anchor of each window, in order.

    Rows are of other labels than the anchor's, or of the same (without the anchor itself).
    """
    if not len(rows.ids) or not len(anchors.ids):
        return
    width = max(rows.cells.shape[1], anchors.cells.shape[1])
    cells, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows.cells, anchors.cells))
    tail = levels(np.abs(cells))
    norm, longest = np.sqrt((queries**2).sum(axis=1)), tail.max(initial=0)
    left = tail.max(axis=1)  # the norm of what is not indexed yet
    bound = longest
    live = np.flatnonzero(np.bincount(owner, minlength=len(queries)) > 0)
    partial = np.zeros((len(cells), len(live)))
    exact_to, waiting = np.full(len(queries), np.inf), np.ones(tail.shape, dtype=bool)
    first_window = np.searchsorted(owner, np.arange(len(queries) + 1))
    while len(live):
        bound = bound * LOWERED if bound > 1 else 0.0
        ask = queries[live]
        # The index grows by the entries without which more than the bound would be left out.
        adds = waiting & (tail > bound)
        waiting &= ~adds
        for d in np.flatnonzero(adds.any(axis=0)):
            posting = np.flatnonzero(adds[:, d])
            partial[posting] += cells[posting, d][:, None] * ask[:, d][None, :]
        left = np.where(waiting, tail, 0).max(axis=1)
        least = np.array([windows.needed()[first_window[a] : first_window[a + 1]].min() for a in live])
        threshold = np.maximum(bound * norm[live] * (1 + 1e-9), least) if bound else least
        upper = partial + left[:, None] * norm[live][None, :] * (1 + 1e-9)
        every_found, every_who = np.nonzero(upper >= threshold[None, :])
        for begin in range(0, len(every_found), SCORED):
            found, who = every_found[begin : begin + SCORED], every_who[begin : begin + SCORED]
            anchor = live[who]
            if other_label:
                fits = rows.labels[found] != anchors.labels[anchor]
            else:
                itself = (rows.ids[found] == anchors.ids[anchor]) & rows.known[found]
                itself[itself] = (cells[found[itself]] == queries[anchor[itself]]).all(axis=1)
                fits = (rows.labels[found] == anchors.labels[anchor]) & ~itself
            found, who, anchor = found[fits], who[fits], anchor[fits]
            score = np.einsum("ij,ij->i", cells[found], queries[anchor])
            new = (score >= threshold[who]) & (score < exact_to[anchor])
            found, anchor, score = found[new], anchor[new], score[new]
            count = first_window[anchor + 1] - first_window[anchor]
            window = np.repeat(first_window[anchor], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found, score = np.repeat(found, count), np.repeat(score, count)
            inside = (score >= windows.low[window]) & (score <= windows.high[window])
            if inside.any():
                windows.add(window[inside], score[inside], rows.ids[found[inside]])
        exact_to[live] = threshold
        # A window is settled when no row below the threshold could enter it.
        open_window = windows.needed() < np.repeat(exact_to, np.diff(first_window))
        open_anchor = np.bincount(owner, weights=open_window, minlength=len(queries))[live] > 0
        if bound == 0:
            break
        live, partial = live[open_anchor], partial[:, open_anchor]


_FOUND = "block int, slot int, place int, score long, id long, known boolean, anchor_id long, positive_id long, positive_score long"


def _windows_of(row: dict, positives: list[dict] | None, keep: int) -> tuple[Windows, np.ndarray, list]:
    """The windows of an anchor block: one of all scores for each anchor, or one under each positive."""
    if positives is None:
        n = row["n"]
        return Windows(np.full(n, -np.inf), np.full(n, np.inf), keep), np.arange(n), [(a, 0, None, None) for a in range(n)]
    told = sorted((p["slot"], p["place"], p["id"], p["score"]) for p in positives)
    score = np.array([p[3] for p in told], dtype=np.float64)
    return Windows(np.ceil(LOW * score / HIGH), score, keep), np.array([p[0] for p in told], dtype=np.int64), told


def joined(blocks: DataFrame, anchors: DataFrame, other_label: bool, keep: int) -> DataFrame:
    """The best rows of each window, of all blocks: columns of ``_FOUND``; ``anchors`` has positives where the labels differ."""
    spark = blocks.sparkSession
    count, size = anchors.agg(F.max("block"), F.sum(F.length("cells"))).first()
    numbers = F.explode(F.sequence(F.lit(0), F.lit(count or 0)))
    pairs = blocks.drop("block").withColumn("block", numbers)
    more = [F.col("positives")] if other_label else []
    right = anchors.select("block", F.struct("n", "width", "ids", "known", "labels", "cells", *more).alias("anchors"))
    pairs = pairs.join(F.broadcast(right) if (size or 0) <= MOST_SENT else right, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}

        def told(block: int) -> pa.RecordBatch:
            windows, _, names, ids = state.pop(block)
            row, place = np.nonzero(windows.score > -np.inf)
            rank = [names[w] for w in row]
            score, found = windows.score[row, place], windows.id[row, place]
            columns = [np.full(len(row), block), [r[0] for r in rank], [r[1] for r in rank], score.astype(np.int64), found, found != _NULL_ID, ids[[r[0] for r in rank]] if len(row) else [], [r[2] for r in rank], [r[3] for r in rank]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                block, held = row["block"], Block(row["anchors"])
                if block not in state:
                    if len(state) * ANCHORS * held.cells.shape[1] * 4 > 2 * MOST_SENT:  # anchors joined by shuffle: one block after the other
                        for k in list(state):
                            yield told(k)
                    state[block] = (*_windows_of(row["anchors"], row["anchors"].get("positives"), keep), held.ids)
                windows, owner, _, _ = state[block]
                rows = Block(row)
                if other_label:
                    threshold_join(rows, held, windows, owner, True)
                    continue
                for label in np.intersect1d(rows.labels, held.labels):
                    mine = np.flatnonzero(held.labels == label)
                    part = Windows(windows.low[mine], windows.high[mine], keep)
                    part.score, part.id = windows.score[mine], windows.id[mine]
                    threshold_join(rows.of(label), held.of(label), part, np.arange(len(mine)), False)
                    windows.score[mine], windows.id[mine] = part.score, part.id
        for k in list(state):
            yield told(k)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with long_batches(spark, min(16, int(before))):
        found = written(pairs.mapInArrow(run, _FOUND))
    order = Window.partitionBy("block", "slot", "place").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.withColumn("id", F.when(F.col("known"), F.col("id")))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id ``every`` divides. For each of an anchor's first ``positives`` other rows of its label,
    the first ``negatives`` rows of other labels that score from ``LOW`` to ``HIGH`` percent of it. First is the highest inner
    product, then the smallest vec_id.
    """
    ship_code(vectors.sparkSession)
    rows = written(prepared(vectors))
    blocks, anchors = packed(rows, BLOCK), packed(rows.where(F.col("vec_id") % every == 0), ANCHORS)
    best = joined(blocks, anchors, False, positives)
    told = best.groupBy("block").agg(F.collect_list(F.struct("slot", F.col("rank").alias("place"), "id", "score")).alias("positives"))
    found = joined(blocks, anchors.join(told, "block"), True, negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
