"""Token ids of texts by the tokenizers library, with each distinct piece encoded once per worker.

Both public vocabularies used here split a text into pre-tokens before merging, and a pre-token never
reaches across a single space or line break that has visible characters on both sides. A text is cut
there (the space stays with what follows it), and the ids of its pieces, joined, are the ids of the
whole text. A text in which two white-space characters meet, or which begins or ends with one, is
encoded whole. A piece of plain characters is split into its pre-tokens here (runs of letters, digits
and other signs) and each goes to the vocabulary's merges once; any other piece is encoded as a text.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

_WHITE = re.compile(r"\s\s")
#: Pieces whose pre-tokens Python can tell: visible ASCII without apostrophes, and Latin letters that both vocabularies treat as letters.
_PLAIN = re.compile(r"[\x20-\x26\x28-\x7EÀ-ÖØ-öø-ÿ]+")
_RUNS = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+)|\n")
_SINGLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|\n")
MOST_KEPT = 300_000


def irregular(text: str) -> bool:
    return text[:1].isspace() or text[-1:].isspace() or _WHITE.search(text) is not None


def split(text: str) -> list[str]:
    """The pieces of a regular text: a space stays with what follows it, an empty piece stands for a line break."""
    return text.replace("\n", "\n\n").replace(" ", "\n ").split("\n")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte, as a table over Latin-1 text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


_LETTERS = _byte_letters()


@lru_cache(maxsize=8)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True   # their strings in a text are ordinary text
    return t


class Recent:
    """What was met lately, by key, in two generations: when the younger is full it becomes the older, and what is asked again moves back."""

    def __init__(self, kept: int):
        self.kept, self.young, self.old = kept, {}, {}

    def missing(self, keys) -> list:
        """Those of the keys that neither generation has; those of the older one move to the younger."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                got = old.get(k)
                if got is None:
                    out.append(k)
                else:
                    young[k] = got
        return out

    def turn(self) -> None:
        """Between batches: the younger generation becomes the older when it holds half of what may be kept."""
        if len(self.young) > self.kept // 2:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers in bytes objects."""

    def __init__(self, path: str, kept: int = MOST_KEPT):
        self.tokenizer = tokenizer(path)
        self.ids, self.words = Recent(kept), Recent(kept)
        self.line = self.whole("\n")
        # The vocabulary that drops white space also folds case and takes digits one by one.
        self.folds = not self.line

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: plain ones are split into pre-tokens together, and each new pre-token goes to the vocabulary's own merges."""
        plain = [p for p in pieces if p and _PLAIN.fullmatch(p)]
        if not plain:
            return [self.whole(p) for p in pieces]
        text = "\n".join(plain)
        runs = _SINGLE.findall(text.lower()) if self.folds else _RUNS.findall(text)
        self.words.turn()
        words, tokenize = self.words.young, self.tokenizer.model.tokenize
        for w in self.words.missing(set(runs)):
            words[w] = array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
        out, held, done = {}, [], iter(plain)
        for w in runs:
            if w == "\n":
                out[next(done)] = b"".join(held)
                held = []
            else:
                held.append(words[w])
        out[next(done)] = b"".join(held)
        return [out[p] if p in out else self.whole(p) for p in pieces]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: every piece is looked up; texts with pieces not met before follow when those are learnt."""
        self.ids.turn()
        known, out, later, new = self.ids.young, [b""] * len(texts), [], set()
        known[""] = self.line
        for i, t in enumerate(texts):
            if not t:
                continue
            if irregular(t):
                out[i] = self.whole(t)
                continue
            pieces = split(t)
            try:
                out[i] = b"".join(map(known.get, pieces))
            except TypeError:
                new.update(pieces)
                later.append((i, pieces))
        if later:
            fresh = self.ids.missing(new)
            known.update(zip(fresh, self.learn(fresh), strict=True))
            for i, pieces in later:
                out[i] = b"".join(map(known.get, pieces))
        return out


class Counts:
    """Numbers of ids by several vocabularies at once: a text is split once, and a piece has one number that holds all its counts."""

    BITS = 40                            # bits for the sum of one vocabulary over a text

    def __init__(self, paths: tuple[str, ...], kept: int = MOST_KEPT):
        self.encoders, self.known = [encoder(p) for p in paths], Recent(kept)
        self.line = self._packed([e.line for e in self.encoders])

    def _packed(self, ids: list[bytes]) -> int:
        return sum((len(x) // 4) << (self.BITS * i) for i, x in enumerate(ids))

    def batch(self, texts: list[str]) -> list[list[int]]:
        self.known.turn()
        known, out, later, new = self.known.young, [0] * len(texts), [], set()
        known[""] = self.line
        for i, t in enumerate(texts):
            if not t:
                continue
            if irregular(t):
                out[i] = self._packed([e.whole(t) for e in self.encoders])
                continue
            pieces = split(t)
            try:
                out[i] = sum(map(known.__getitem__, pieces))
            except KeyError:
                new.update(pieces)
                later.append((i, pieces))
        if later:
            fresh = self.known.missing(new)
            known.update(zip(fresh, map(self._packed, zip(*[e.learn(fresh) for e in self.encoders], strict=True)), strict=True))
            for i, pieces in later:
                out[i] = sum(map(known.__getitem__, pieces))
        mask = (1 << self.BITS) - 1
        return [[(n >> (self.BITS * i)) & mask for i in range(len(self.encoders))] for n in out]


@lru_cache(maxsize=8)
def counter(paths: tuple[str, ...]) -> Counts:
    """One for each worker process."""
    return Counts(paths)


@lru_cache(maxsize=8)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _slices(texts: list[str], most_chars: int):
    """(first, end) of runs of texts with a bounded amount of text."""
    lo, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most_chars or i == len(texts) - 1:
            yield lo, i + 1
            lo, chars = i + 1, 0


def encoded(path: str, texts: list[str], most_chars: int = 1 << 20):
    """(position, ids) of each text, a bounded amount of text at a time."""
    e = encoder(path)
    for lo, hi in _slices(texts, most_chars):
        yield from zip(range(lo, hi), e.encode_batch(texts[lo:hi]), strict=True)


def counted(paths: tuple[str, ...], texts: list[str], most_chars: int = 1 << 20) -> list[list[int]]:
    """Numbers of ids of each text, one for each vocabulary."""
    c = counter(paths)
    return [n for lo, hi in _slices(texts, most_chars) for n in c.batch(texts[lo:hi])]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
