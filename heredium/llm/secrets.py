"""Secret scans: fixed forms, and sliding-window Shannon entropy over strings that look like keys.

Base kinds (assign, access, hex) are reported whenever their pattern and length agree. The method adds
``entropy``: a candidate string is a maximal run of key characters; for each character class (hex,
alphanumeric, base64) every maximal part of that class is walked by a window of fixed width whose
character counts, and the sum of n log2 n over them, change by one character in and one out. A window
counts where its entropy reaches the class's bar and it mixes digits and letters as the class demands;
touching or overlapping windows become one span. An allow list suppresses strings known to be harmless:
identifiers, labelled digests, embedded media, sequences, placeholders. Added spans touch no base span.

A null text counts as empty and has no spans; rows, repeated ones included, are handled one by one;
columns other than ``doc_id`` and ``text`` are ignored. Time is linear in the text, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .frames import documents, text_of

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")

_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")      # whatever else is looked for lies inside one of these
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}+")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the width of its window, the bar in bits, and how many digits, capitals and small letters a window must hold."""

    name: str
    part: re.Pattern[str]
    width: int
    bits: float
    digits: int = 0
    capitals: int = 0
    small: int = 0


CLASSES = (
    CharClass("hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 20, 3.0, digits=4),
    CharClass("alphanumeric", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.6, digits=3),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9, digits=2, capitals=3, small=3),
)

#: Harmless forms. Each is matched over the candidate string with up to 24 characters before it.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",        # identifiers
    r"(?i)\b(?:md5|sha-?(?:1|224|256|384|512)|etag|checksum|digest|integrity)\b",   # labelled digests
    r"(?i)base64,",                                                              # embedded media
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|redacted|x{6}|0{8}",   # placeholders
    r"(?i)abcdefgh|01234567|12345678|qwertyui",                                  # sequences
    r"(?i)https?:/|www\.",                                                       # addresses
)
BEFORE = 24


def windows(text: str, kind: CharClass) -> Iterator[tuple[int, float]]:
    """(start, bits) of every window of a string of one class that reaches the bar and mixes characters as demanded."""
    width = kind.width
    if len(text) < width:
        return
    gain = [0.0, *(n * log2(n) for n in range(1, width + 2))]       # one comes in before one goes out
    counts: dict[str, int] = {}
    total, digits, capitals, small, full = 0.0, 0, 0, 0, log2(width)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += gain[n + 1] - gain[n]
        digits += "0" <= c <= "9"
        capitals += "A" <= c <= "Z"
        small += "a" <= c <= "z"
        if i >= width:
            o = text[i - width]
            n = counts[o]
            counts[o] = n - 1
            total += gain[n - 1] - gain[n]
            digits -= "0" <= o <= "9"
            capitals -= "A" <= o <= "Z"
            small -= "a" <= o <= "z"
        if i >= width - 1:
            bits = full - total / width
            if bits >= kind.bits - 1e-9 and width > digits >= kind.digits and capitals >= kind.capitals and small >= kind.small:
                yield i - width + 1, bits


def dense_parts(text: str, kind: CharClass) -> list[tuple[int, int, float]]:
    """(start, end, most bits) of the unions of such windows."""
    out: list[tuple[int, int, float]] = []
    for m in kind.part.finditer(text):
        for at, bits in windows(m[0], kind):
            s, e = m.start() + at, m.start() + at + kind.width
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], e, max(out[-1][2], bits))
            else:
                out.append((s, e, bits))
    return out


def base_spans(text: str, runs: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base kinds, in code points, by start, then kind."""
    low = text.lower()                                   # a cheap look before the pattern
    named = any(w in low for w in ("passw", "secret", "token", "api"))
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if named else []
    for lo, hi in runs:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text, lo, hi) if m.end() - m.start() >= 16]
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, lo, hi)]
    return sorted(out, key=lambda x: (x[0], x[2]))


class Scanner:
    """Spans and their entropies with an allow list of regular expressions."""

    def __init__(self, allowed: Sequence[str] = ALLOWED, classes: Sequence[CharClass] = CLASSES):
        self.allowed, self.classes = [re.compile(a) for a in allowed], classes

    def suppressed(self, text: str, lo: int, hi: int) -> bool:
        near = text[max(0, lo - BEFORE):hi]
        return any(a.search(near) for a in self.allowed)

    def spans(self, text: str) -> list[tuple[int, int, int, float | None]]:
        """(start, end, number of the kind, bits or None) by start, then kind."""
        runs = [m.span() for m in _RUN.finditer(text)]
        base = base_spans(text, runs)
        out: list[tuple[int, int, int, float | None]] = [(*b, None) for b in base]
        done = 0                                         # base spans that end before the run are behind
        for lo, hi in runs:
            if hi - lo < 20:
                continue
            found = sorted(x for k in self.classes for x in dense_parts(text[lo:hi], k))
            if not found or self.suppressed(text, lo, hi):
                continue
            while done < len(base) and base[done][1] <= lo:
                done += 1
            joined: list[tuple[int, int, float]] = []
            for s, e, bits in found:
                if joined and lo + s <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], lo + e), max(joined[-1][2], bits))
                else:
                    joined.append((lo + s, lo + e, bits))
            at = done
            for s, e, bits in joined:                    # both lists by start: one walk
                while at < len(base) and base[at][1] < s:
                    at += 1
                if at == len(base) or base[at][0] > e:
                    out.append((s, e, 3, bits))
        return sorted(out, key=lambda x: (x[0], x[2]))


def told(found: Sequence[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, *_ in found)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, bits array<double>"


def find(docs: DataFrame, allowed: Sequence[str] = ALLOWED, classes: Sequence[CharClass] = CLASSES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, and the bits of the added ones."""

    def run(batches):
        scanner = Scanner(allowed, classes)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                found = scanner.spans(t)
                base = [x for x in found if x[2] < len(BASE)]
                rows.append((*(sum(x[2] == k for x in base) for k in range(len(BASE))), hashlib.sha256(told(base).encode()).hexdigest(),
                             told(found), len(found) - len(base), [x[3] for x in found if x[2] >= len(BASE)]))
            types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", "bits"])

    return text_of(docs).mapInArrow(run, _FOUND)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
