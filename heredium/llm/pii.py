"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) are reported whenever pattern and check agree. The method adds
two kinds: ``iban`` (pattern, country length unknown, confirmed by mod-97) and ``local_phone``
(ten digits in 3-3-4 groups), which has no checksum and needs a context word to reach the bar.

A null text counts as empty and has no spans; rows, repeated ones included, are handled one by one;
columns other than ``doc_id`` and ``text`` are ignored. Every pattern runs in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .frames import documents, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")
#: Score before context, and the words that raise it, by kind.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "local_phone": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("call", "phone", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank"), "local_phone": ("call", "phone", "tel", "mobile", "fax"),
}
AGAINST = ("version", "order", "isbn", "example")
BAR, RAISE, LOWER, NEAR = 0.5, 0.3, 0.3, 40

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping: the local part reaches back from an @ as far as it can, not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base kinds, in code points, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, e, 0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() > 13 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def score(text: str, start: int, end: int, kind: str) -> float:
    """The kind's prior, raised or lowered by whole words within ``NEAR`` code points of the span."""
    near = set(re.findall(r"[a-z]+", (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()))
    s = PRIOR[kind] + RAISE * bool(near & set(CONTEXT[kind])) - LOWER * bool(near & set(AGAINST))
    return min(1.0, max(0.0, s))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each match the longest run of its groups that passes mod-97: words in capitals may follow one, or come before it."""
    m = _IBAN.search(text)
    while m:
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
        end = next((e for e in ends if mod97(text[m.start():e])), None)
        if end is not None:
            yield m.start(), end
        m = _IBAN.search(text, m.start() + 1 if end is None else end)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the added kinds that pass their check and the bar and touch no base span."""
    if not _DIGIT.search(text):
        return []
    found = [(s, e, 4) for s, e in _ibans(text)]
    for m in _LOCAL_PHONE.finditer(text):
        if score(text, m.start(), m.end(), "local_phone") >= BAR:
            found.append((m.start(), m.end(), 5))
    return [x for x in found if not any(x[0] < e and s < x[1] for s, e, _ in base)] if found else []


def spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    added = added_spans(text, base)
    return sorted(base + added, key=lambda x: (x[0], x[2])) if added else base


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for s, e, k in spans(text):
        if s >= done:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]]) if out else text


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans and their scores."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                found = spans(t)
                base = [x for x in found if x[2] < len(BASE)]
                n = [sum(x[2] == k for x in base) for k in range(len(BASE))]
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(found), [score(t, s, e, KINDS[k]) for s, e, k in found]))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return text_of(docs).mapInArrow(run, _FOUND)


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data in ``text`` replaced and ``n_chars`` counted anew; null texts stay null."""
    columns = docs.columns

    def run(batches):
        for b in batches:
            old = b.column("text").to_pylist()
            new = [t if t is None else redact(t) for t in old]
            chars = [c if x is y else len(y) for x, y, c in zip(old, new, b.column("n_chars").to_pylist(), strict=True)]
            cols = {n: b.column(n) for n in columns} | {"text": pa.array(new, pa.string()), "n_chars": pa.array(chars, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
