"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair models the tokens of a text are the only sequence whose neighbours are all compatible (two
tokens are compatible if encoding their joined text gives the two back), and cutting the last token off
leaves the tokens of the shorter prefix. So the last token of each prefix follows from those of shorter
prefixes: it is the one that ends there and is compatible with the last token of what precedes it. The
count of a prefix is one more than the count of the prefix that its last token leaves. The tokens that end at a place come
from an automaton over the vocabulary, made as far as texts need it. The table answers
how many tokens any prefix has and how much of a text fits a budget, without encoding again.

Texts are cut where no merge can cross (before runs of spaces); tables of the parts are kept in a bounded
cache, of which what recurs outlives the rest. The number of tokens is the last entry of the tables, summed. Each part's total is checked against the
library; where that differs (or the model allows no such cuts), the library encodes every prefix of the part instead,
and the document counts it in n_repaired.

Null and empty texts have 0 tokens. Repeated rows get equal counts; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame

from verdigris.llm.common import per_text
from verdigris.llm.piece_model import NORMAL, UNUSED, USER_DEFINED, PieceModel, chunks

LIMIT = 4096
#: Parts in each of a worker's two caches, beyond which the newer becomes the older, and pairs of tokens beyond which all go.
CACHE, PAIRS = 400_000, 1_000_000
#: Characters beyond which a part is seldom seen again.
LONG = 64


class Ending:
    """What a text ends in: its longest end that begins a token (Aho-Corasick), and the tokens that end there.

    ``tokens`` has length, text, tokens counted and, by token before, whether it fits; longest first, then the lone character.
    """

    __slots__ = ("text", "after", "tokens")

    def __init__(self, text: str, tokens: list[tuple[int, str, int, dict[str, bool]]]) -> None:
        self.text, self.tokens = text, tokens
        self.after: dict[str, Ending] = {}


class PrefixCounter:
    """Prefix tables for one model; made once in each Python worker."""

    _made: dict[str, PrefixCounter] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = PieceModel.load(path)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model.raw)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=self.model.without_dummy_prefix())
        self.cuts = self.model.words_are_independent()
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.begun = {token[:i] for token in self.ids for i in range(len(token) + 1)}
        self._forget_pairs()
        self.single: dict[str, int] = {}
        self.tables: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}
        #: Tables and totals of earlier texts' parts.
        self.before: tuple[dict[str, bytes], dict[str, int]] = {}, {}
        self.repaired: set[str] = set()
        self.long: list[str] = []

    @classmethod
    def of(cls, path: str) -> PrefixCounter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _size(self, token: str) -> int:
        """Tokens of a token or lone character: 1, or its bytes where the vocabulary lacks it."""
        if token in self.ids:
            return 1
        if token not in self.single:
            self.single[token] = len(self.bare.encode(token))
        return self.single[token]

    def _fit(self, left: str, right: str) -> bool:
        """Whether two tokens may stand side by side (left "": right may stand at the front)."""
        got, a, b = self.bare.encode(left + right), self.ids.get(left), self.ids.get(right)
        if b is not None and (a is not None or not left):
            return got == ([a, b] if left else [b])
        size = (self._size(left) if left else 0) + self._size(right)
        return len(got) == size and (a is None or got[0] == a) and (b is None or got[-1] == b)

    def _longer(self, ending: Ending, char: str) -> Ending:
        """The ending after one more character."""
        text = ending.text + char
        while text and text not in self.begun:
            text = text[1:]
        found = [text[i:] for i in range(len(text) - 1) if text[i:] in self.ids]
        tokens = [(len(t), t, self._size(t), self.fits.setdefault(t, {})) for t in (*found, char)]
        if not text:  # of characters that no token has there can be too many to keep
            made = Ending(text, tokens)
            made.after = self.nothing.after
            return made
        ending.after[char] = self.endings.get(text) or self.endings.setdefault(text, Ending(text, tokens))
        return ending.after[char]

    def _forget_pairs(self) -> None:
        """Start without endings and without what is known of pairs of tokens."""
        self.nothing = Ending("", [])
        self.endings: dict[str, Ending] = {}
        #: By token and the token before it, whether they may stand side by side, and how many such pairs are kept.
        self.fits: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def tabulate(self, parts: list[str]) -> None:
        """Tables of new parts. In sorted order a part extends the states of what it shares with the one before."""
        if self.pairs > PAIRS:
            self._forget_pairs()
        counts, lasts, endings, before = [0], [""], [self.nothing], ""
        made = []
        for part in parts:
            shared, most = 0, min(len(before), len(part), len(counts) - 1)
            while shared < most and before[shared] == part[shared]:
                shared += 1
            del counts[shared + 1 :], lasts[shared + 1 :], endings[shared + 1 :]
            ending = endings[-1]
            for char in part[shared:]:
                ending = ending.after.get(char) or self._longer(ending, char)
                for n, token, size, known in ending.tokens:
                    last = lasts[-n]
                    fit = known.get(last)
                    if fit is None:
                        fit = known[last] = self._fit(last, token)
                        self.pairs += 1
                    if fit:
                        counts.append(counts[-n] + size)
                        lasts.append(token)
                        endings.append(ending)
                        break
                else:
                    break
            made.append(array("I", counts[1:]).tobytes() if len(counts) == len(part) + 1 else b"")
            before = part
        for part, table, tokens in zip(parts, made, self.bare.encode(parts, num_threads=1)):
            total = int.from_bytes(table[-4:], sys.byteorder)
            if total != len(tokens):
                table, total = array("I", [len(x) for x in self.bare.encode([part[: i + 1] for i in range(len(part))])]).tobytes(), len(tokens)
                self.repaired.add(part)
            self.tables[part], self.totals[part] = table, total

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The parts of each text, their tables made."""
        parted = [chunks(t, self.model.dummy_prefix) for t in texts]
        if len(self.totals) > CACHE:
            self.before, self.tables, self.totals = (self.tables, self.totals), {}, {}
            self.repaired = {p for p in self.repaired if p in self.before[1]}
        new = set().union(*parted).difference(self.totals)
        for kept, old in zip((self.tables, self.totals), self.before):
            again = [p for p in new if p in old]
            kept.update(zip(again, map(old.pop, again)))
        new = sorted(new.difference(self.totals))
        self.tabulate(new)
        self.long = [p for p in new if len(p) > LONG]
        return parted

    def trim(self) -> None:
        """Drop what seldom recurs: the tables of long parts."""
        for part in self.long:
            del self.tables[part], self.totals[part]
            self.repaired.discard(part)

    def expand(self, text: str, parts: list[str]) -> np.ndarray:
        """Tokens of text[:i], i = 0, 1, ... len(text): the count before a part and the part's own table."""
        within = np.frombuffer(b"".join([self.tables[p] for p in parts]), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        before = np.concatenate(([0], np.cumsum(within[np.cumsum(sizes) - 1])[:-1])) if len(parts) else sizes
        every = np.repeat(before, sizes) + within
        # The first entry is of the mark put before the text; the empty text has no tokens.
        return np.concatenate(([0], every[1:] if self.model.dummy_prefix and text else every))

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the tokens of all its prefixes, as the library gives them."""
        if not self.cuts:
            return [np.array([len(x) for x in self.library.encode([t[:i] for i in range(len(t) + 1)])], dtype=np.int64) for t in texts]
        out = [self.expand(t, parts) for t, parts in zip(texts, self.prepare(texts))]
        self.trim()
        return out

    def measure(self, texts: list[str], limit: int) -> list[tuple[int, int, int]]:
        """(tokens, longest prefix of at most ``limit`` tokens, repaired parts) of each text; only texts beyond it are expanded."""
        if not self.cuts:
            return [(int(c[-1]), truncate(c, limit), 1) for c in self.counts(texts)]
        out, parted = [], self.prepare(texts)
        total = self.totals.__getitem__
        for text, parts in zip(texts, parted):
            n = sum(map(total, parts))
            repaired = sum(map(self.repaired.__contains__, parts)) if self.repaired else 0
            out.append((n, len(text) if n <= limit else truncate(self.expand(text, parts), limit), repaired))
        self.trim()
        return out


def truncate(counts: np.ndarray, limit: int) -> int:
    """Length of the longest prefix that has at most ``limit`` tokens (counts can fall by a merge)."""
    return int(np.flatnonzero(counts <= limit)[-1])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (code points within ``limit``) and n_repaired of every document.

    ``with_prefixes`` adds prefix_counts, the table itself: tokens of the first 0, 1, 2 ... code points.
    """

    def helper(texts: list[str]) -> list:
        counter = PrefixCounter.of(path)
        measured = counter.measure(texts, limit)
        made = [[len(t.encode("utf-8", "surrogatepass")) for t in texts], *map(list, zip(*((n, n > limit, fit, repaired) for n, fit, repaired in measured)))]
        return [*made, counter.counts(texts)] if with_prefixes else made

    return per_text(docs, helper, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long, n_repaired long" + ", prefix_counts array<long>" * with_prefixes)
