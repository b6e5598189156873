"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed and its parts rebuilt as a tokenizers pipeline: the normaliser (the model's
character map, space squeezing, the space marker before the text and for spaces), the unigram scores or the
merges that the scores of a byte-pair model imply, byte fallback, and the decoder. Batches are encoded by
the library's threads, as many as a task has cores (spark.task.cpus) unless told otherwise.

Where texts may be cut without changing tokens (see ``PieceModel.words_are_independent``), each distinct part
of a batch is encoded once and kept in a bounded cache, of which what recurs outlives the rest. The ids are the rebuilt pipeline's. Every newly encoded part is
held against the sentencepiece library: only where they differ are the library's ids used instead, and the document
counts the part in n_repaired. Every part is also decoded again. Without such cuts whole texts are encoded, compared
and decoded. Models other than unigram and byte-pair ones are refused.

Null and empty texts have no ids and decode to the empty text. A text holding the space marker itself
decodes to a space there, as with the original library, and round_trip is then false. Repeated rows get
equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from itertools import accumulate, chain, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import ship_code, short_batches
from verdigris.llm.common import kept, per_text, sliced
from verdigris.llm.piece_model import BPE, NORMAL, SPACE, UNIGRAM, UNUSED, USER_DEFINED, PieceModel, chunks

#: Parts in each of a worker's two caches, beyond which the newer becomes the older, and that the library encodes at once.
CACHE, AT_ONCE = 300_000, 8192
#: Bytes of an id in the cache.
WIDTH = array("I").itemsize


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """The merges of a byte-pair model, best first: all ways to join two pieces into a third, by its score."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, place in rank.items():
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in rank and right in rank:
                found.append((place, rank[left][1], rank[right][1], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: PieceModel, whole_texts: bool = True):
    """A tokenizers pipeline of the model; without ``whole_texts`` its input is already normalised."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unk_id][0]
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models can be rebuilt")
    if model.kind == UNIGRAM:
        backend = models.Unigram([(p, score) for p, score, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        backend = models.BPE(vocab, merges_of(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    if whole_texts:
        tokenizer.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix and whole_texts else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class Codec:
    """Encoder and decoder of one model; made once in each Python worker for the tasks of a stage."""

    def __init__(self, path: str, threads: int = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        self.model, self.threads = PieceModel.load(path), threads
        self.cuts = self.model.words_are_independent()
        self.tokenizer = rebuild(self.model, whole_texts=not self.cuts)
        raw = self.model.without_dummy_prefix() if self.cuts else self.model.raw
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        #: By part its ids as bytes, of recent texts and of those before; the parts that they don't decode to, and those for which the library's were taken.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.inexact: set[str] = set()
        self.repaired: set[str] = set()

    @classmethod
    def of(cls, path: str, threads: int = 1) -> Codec:
        return kept(("codec", path, threads), lambda: cls(path, threads))

    def learn(self, parts: list[str]) -> None:
        """Encode new parts, hold them against the library, decode them again."""
        for i in range(0, len(parts), AT_ONCE):
            some = parts[i : i + AT_ONCE]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            theirs = self.library.encode(some, num_threads=self.threads)
            if ours != theirs:
                self.repaired.update(p for p, mine, ids in zip(some, ours, theirs) if mine != ids)
                ours = [ids if p in self.repaired else mine for p, mine, ids in zip(some, ours, theirs)]
            back = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
            want = [p.replace(SPACE, " ") for p in some] if self.cuts else some
            if back != want:
                self.inexact.update(p for p, text, x in zip(some, back, want) if text != x)
            flat = array("I", chain.from_iterable(ours)).tobytes()
            ends = [*accumulate(map(len, ours), lambda at, n: at + WIDTH * n, initial=0)]
            self.known.update(zip(some, [flat[a:b] for a, b in pairwise(ends)]))

    def recall(self, parts: set[str]) -> list[str]:
        """The parts that neither cache has, sorted; those of the older one are moved to the newer."""
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
            self.inexact = {p for p in self.inexact if p in self.before}
            self.repaired = {p for p in self.repaired if p in self.before}
        new = parts.difference(self.known)
        again = [p for p in new if p in self.before]
        self.known.update(zip(again, map(self.before.pop, again)))
        return sorted(new.difference(again))

    def forget(self, parts: list[str]) -> None:
        """Drop parts from the cache."""
        for part in parts:
            del self.known[part]
        self.inexact.difference_update(parts)
        self.repaired.difference_update(parts)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, int]]:
        """Ids, whether they decode to the text, and parts for which the library's ids were taken."""
        parted = [chunks(t, self.model.dummy_prefix) if self.cuts else [t] if t else [] for t in texts]
        new = self.recall(set().union(*parted))
        self.learn(new)
        out, get = [], self.known.__getitem__
        for text, parts in zip(texts, parted):
            ids = np.frombuffer(b"".join(map(get, parts)), dtype=np.uint32).astype(np.int32)
            exact = not (self.cuts and SPACE in text) and self.inexact.isdisjoint(parts)
            out.append((ids, exact, sum(map(self.repaired.__contains__, parts)) if self.repaired else 0))
        self.forget([p for p in new if len(p) > 64])  # long parts seldom recur
        return out

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Texts of rows of ids."""
        texts = self.tokenizer.decode_batch(rows, skip_special_tokens=False)
        cut = self.cuts and self.model.dummy_prefix
        return [t[1:] if cut and t.startswith(" ") else t for t in texts]


def cores_of_a_task(df: DataFrame) -> int:
    """How many cores Spark gives each task."""
    return int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))


def encode_pieces(docs: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 (of 4-byte little-endian ids), round_trip and n_repaired of every document."""
    threads = threads or cores_of_a_task(docs)

    def helper(texts: list[str]) -> list:
        rows = Codec.of(path, threads).encode(texts)
        digests = [hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() for ids, _, _ in rows]
        return [[ids for ids, _, _ in rows], [len(ids) for ids, _, _ in rows], digests, [ok for _, ok, _ in rows], [n for *_, n in rows]]

    return per_text(docs, helper, "ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean, n_repaired long")


def decode_pieces(encoded: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    import pyarrow as pa

    ship_code(encoded.sparkSession)
    threads = threads or cores_of_a_task(encoded)
    rows = encoded.select("doc_id", "ids")
    schema = rows.select("doc_id", F.lit("").alias("text")).schema
    schema["text"].nullable = True

    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = Codec.of(path, threads).decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, schema)


def with_ids(docs: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with ids and n_tokens appended; no shuffle. Columns of those names are replaced."""
    import pyarrow as pa

    ship_code(docs.sparkSession)
    short_batches(docs.sparkSession)
    threads = threads or cores_of_a_task(docs)
    docs = docs.drop("ids", "n_tokens", "__ids")
    rows = docs.withColumn("__ids", F.array().cast("array<int>"))
    at = len(docs.columns)

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                ids = [ids for ids, _, _ in Codec.of(path, threads).encode([t or "" for t in part.column("text").to_pylist()])]
                yield part.set_column(at, part.schema.field(at), pa.array(ids, part.schema.field(at).type))

    made = rows.mapInArrow(run, rows.schema)
    return made.select(*docs.columns, F.col("__ids").alias("ids"), F.size("__ids").cast("long").alias("n_tokens"))
