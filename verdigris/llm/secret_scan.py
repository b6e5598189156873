"""Secret scans: patterns of known forms, and sliding-window entropy over candidate strings.

Base spans come from three fixed patterns. The entropy pass adds spans: what base spans leave of every maximal string of
token characters is a candidate. A window slides over it, and incremental counts of its characters and of their kinds
give its entropy and its character class; it is hot if it reaches the entropy of its class. Windows that touch an
allow-listed stretch (placeholders, UUIDs, digests of nothing, runs of the alphabet) are let go, and so are windows
without a digit or without a letter, which are words, paths, dates and numbers. Hot windows in a row are one span, which
reaches on to the next mark, allowed stretch or end of the candidate.

Null and empty texts have no spans. Repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from verdigris.llm.common import per_text

KINDS = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_LONG_HEX = re.compile("[0-9a-f]{24}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile("[0-9]")

MARKS = "+/_=-"
#: The kinds of characters that a window's counts tell apart.
PARTS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", MARKS]
#: Name, characters and least entropy in bits of the window, from the narrowest class to the widest.
CLASSES = [
    ("hex", "0123456789abcdef", 3.0),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6),
    ("lower", "abcdefghijklmnopqrstuvwxyz0123456789", 3.6),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.7),
    ("token", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + MARKS, 3.9),
]
WINDOW = 20
#: Stretches that are no secrets however mixed they look.
ALLOWED = [
    r"(?i:example|placeholder|changeme|xxxx|0123456789|abcdefgh)",
    r"d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709",  # digests of nothing
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])",  # UUIDs are names
]


@dataclass
class Scanner:
    """Finds spans in a text; classes, window and allow list are parameters."""

    window: int = WINDOW
    classes: list = field(default_factory=lambda: CLASSES)
    allowed: list = field(default_factory=lambda: ALLOWED)

    def __post_init__(self) -> None:
        self._allow = re.compile("|".join(f"(?:{x})" for x in self.allowed))
        #: k log2 k, so that a window of n has entropy log2 n - sum(k log2 k) / n.
        self._part = [0.0, *(k * math.log2(k) for k in range(1, self.window + 1))]
        self._kind = {c: i for i, chars in enumerate(PARTS) for c in chars}
        #: Least entropy by the set of kinds in a window, as bits.
        self._least = [self._least_of({c for i, chars in enumerate(PARTS) if kinds >> i & 1 for c in chars}, kinds) for kinds in range(1 << len(PARTS))]

    def _least_of(self, chars: set[str], kinds: int) -> float:
        mixed = kinds & 1 and kinds & 0b1110  # a digit and a letter
        return next((bits for _, own, bits in self.classes if chars <= set(own)), math.inf) if mixed else math.inf

    def windows(self, text: str) -> Iterator[tuple[float, float]]:
        """(entropy, least entropy of the class) of every window of ``text``; a step updates two counts."""
        part, n, kind_of, bits = self._part, self.window, self._kind, math.log2(self.window)
        counts: dict[str, int] = {}
        kinds, present, total = [0] * len(PARTS), 0, 0.0
        for i, c in enumerate(text):
            if i >= n:
                old = text[i - n]
                k = counts[old]
                counts[old] = k - 1
                total += part[k - 1] - part[k]
                kind = kind_of[old]
                kinds[kind] -= 1
                if not kinds[kind]:
                    present ^= 1 << kind
            k = counts.get(c, 0)
            counts[c] = k + 1
            total += part[k + 1] - part[k]
            kind = kind_of[c]
            kinds[kind] += 1
            present |= 1 << kind
            if i >= n - 1:
                yield bits - total / n, self._least[present]

    def random_parts(self, text: str) -> list[tuple[int, int]]:
        """Spans of a candidate string that its hot windows cover, each carried on to the next mark or allowed stretch."""
        if len(text) < self.window or not _DIGIT.search(text):
            return []
        stops = [m.span() for m in self._allow.finditer(text)]
        spans: list[list[int]] = []
        at = 0
        for i, (entropy, least) in enumerate(self.windows(text)):
            while at < len(stops) and stops[at][1] <= i:
                at += 1
            if entropy < least - 1e-9 or (at < len(stops) and stops[at][0] < i + self.window):
                continue
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + self.window
            else:
                spans.append([i, i + self.window])
        if not spans:
            return []
        marks = [i for i, c in enumerate(text) if c in MARKS]
        starts, ends = sorted({0, *(i + 1 for i in marks), *(b for _, b in stops)}), sorted({len(text), *marks, *(a for a, _ in stops)})
        out: list[tuple[int, int]] = []
        for a, b in spans:
            a, b = starts[bisect_right(starts, a) - 1], ends[bisect_left(ends, b)]
            if out and a < out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
        return out

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans (start, kind's number, end), sorted."""
        spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        at = 0
        while m := _LONG_HEX.search(text, at):  # the first 24 of a run; no run of fewer qualifies
            at = _HEX.match(text, m.start()).end()
            spans.append((m.start(), 2, at))
        return sorted(spans)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Spans (start, end) of random strings in what the base spans leave of the candidates."""
        found, at = [], 0
        for m in _CANDIDATE.finditer(text):
            here = m.start()
            while at < len(base) and base[at][2] <= here:
                at += 1
            k = at
            while here < m.end():
                stop = min(base[k][0], m.end()) if k < len(base) else m.end()
                if stop > here:
                    found += [(here + a, here + b) for a, b in self.random_parts(text[here:stop])]
                if stop == m.end():
                    break
                here = max(here, base[k][2])
                k += 1
        return found


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, the counts of each kind, base_sha256, n_entropy and spans of every document (see ``redact``)."""
    scanner = scanner or Scanner()

    def helper(texts: list[str]) -> list:
        rows = []
        for text in texts:
            base = scanner.base(text)
            added = scanner.added(text, base)
            parts = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
            every = sorted([(a, k, b) for a, k, b in base] + [(a, len(KINDS), b) for a, b in added])
            names = [*KINDS, "entropy"]
            counts = [sum(k == x for _, k, _ in base) for x in range(3)]
            rows.append((*counts, hashlib.sha256(",".join(parts).encode()).hexdigest(), len(added), ",".join(f"{names[k]}:{a}:{b}" for a, k, b in every)))
        return list(zip(*rows))

    return per_text(docs, helper, "n_assign long, n_access long, n_hex long, base_sha256 string, n_entropy long, spans string")


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span of a ``spans`` column replaced by ``mark``; overlapping spans merge."""
    out, at = [], 0
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
