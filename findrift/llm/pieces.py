"""Encode texts piece by piece, each distinct piece once.

A text is cut at its blanks: between two characters that are no white space a
blank always starts a match of the usual pre-token patterns, so the ids of the
stretches, joined, are the ids of the text. Where a blank stands beside other
white space the whole text is matched instead. Stretches (and pre-tokens, where
these are worth keeping) seen before come from tables of bounded size; new ones
of a batch are encoded together.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

STRETCHES = 400_000
PRETOKENS = 400_000
PART = 2_000_000  # characters
LONG = 64  # characters beyond which nothing is kept


class _Table:
    """Ids of strings; when the table is full its older half goes."""

    def __init__(self, many: Callable[[list[str]], list[bytes]], size: int):
        self.many, self.half, self.new, self.old = many, max(1, size // 2), {}, {}

    def learn(self, keys: set[str]) -> None:
        """Make sure that `new` has every key."""
        new, old = self.new, self.old
        missing = keys.difference(new)
        if old:
            for k in missing.intersection(old):
                new[k] = old[k]
                missing.discard(k)
        if missing:
            fresh = list(missing)
            new.update(zip(fresh, self.many(fresh), strict=True))

    def turn(self) -> None:
        if len(self.new) > self.half:
            self.old, self.new = {k: v for k, v in self.new.items() if len(k) <= LONG}, {}


class PieceEncoder:
    """Encodes batches of texts; `many` gives the ids, as bytes, of a list of strings.

    With `pretokens` above 0 it is called with pre-tokens, each once while in the
    table; else with stretches of text.
    """

    def __init__(self, pattern: str, many: Callable[[list[str]], list[bytes]], stretches: int = STRETCHES,
                 pretokens: int = PRETOKENS):
        self.find = regex.compile(pattern).findall
        self.words = _Table(many, pretokens) if pretokens else None
        self.many = self._joined if pretokens else many
        # a stretch is kept without the blank before it
        self.stretches = _Table(lambda keys: self.many([" " + k for k in keys]), stretches)

    def _joined(self, texts: list[str]) -> list[bytes]:
        lists = [self.find(t) for t in texts]
        self.words.learn(set().union(*lists))
        ids = self.words.new
        out = [b"".join([ids[x] for x in parts]) for parts in lists]
        self.words.turn()
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty. At most about PART characters are cut up at a time."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= PART:
                out += self._encoded(part)
                part, size = [], 0
        return out + self._encoded(part) if part else out

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        starts, rests = [], []
        for t in texts:
            first, *rest = (t or "").split(" ")
            starts.append(first)
            rests.append(rest)
        distinct = set().union(*rests)
        joined = {p for p in distinct if not p or p[0].isspace()}
        if joined:  # a blank beside white space: these texts are one stretch each
            for k, rest in enumerate(rests):
                if not joined.isdisjoint(rest):
                    starts[k], rests[k] = texts[k], []
            distinct = set().union(*rests)
        self.stretches.learn(distinct)
        heads = [s for s in starts if s]
        first = iter(self.many(heads) if heads else ())
        ids = self.stretches.new.__getitem__
        out = [(next(first) if s else b"") + b"".join(map(ids, rest)) for s, rest in zip(starts, rests, strict=True)]
        self.stretches.turn()
        return out
