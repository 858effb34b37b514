"""Cuts text as the byte-level pattern does, with array operations instead of a regex engine.

The pattern: contractions, then runs of letters, of numbers or of other characters, each with
at most one space before it, then white space of which the last goes with what follows.
"""

from __future__ import annotations

import functools

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def _every() -> tuple[str, np.ndarray]:
    at = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    return "".join(map(chr, at.tolist())), at


def _table(spans_of) -> np.ndarray:
    every, at = _every()
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        out[at[spans_of(every, pattern)]] = kind
    return out


@functools.cache
def tokenizers_classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library's own regex engine has it."""
    from tokenizers import Regex, pre_tokenizers

    def spans_of(every, pattern):
        keep = np.zeros(len(every), bool)
        first = {r"\p{L}+": "a", r"\p{N}+": "1", r"\s+": " "}[pattern]
        # "removed" drops the matches and keeps the text between them
        keep[:] = True
        cut = pre_tokenizers.Split(Regex(pattern), "removed")
        # block by block, as the library's time for a string grows faster than its length
        for lo in range(0, len(every), 4096):
            for _, (i, j) in cut.pre_tokenize_str(every[lo : lo + 4096]):
                keep[lo + i : lo + j] = False
        assert keep[every.index(first)]
        return keep

    return _table(spans_of)


@functools.cache
def tiktoken_classes() -> np.ndarray:
    """The class of every code point, as the tiktoken library's own regex engine has it."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}

    def spans_of(every, pattern):
        found = tiktoken.Encoding("classes", pat_str=pattern.rstrip("+"), mergeable_ranks=ranks, special_tokens={})
        points = np.frombuffer(bytes(found.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)
        keep = np.zeros(0x110000, bool)
        keep[points] = True
        return keep[np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])]

    return _table(spans_of)


def starts(text: str, table: np.ndarray) -> np.ndarray:
    """Offsets (in code points) at which pre-tokens begin."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a)
    if n == 0:
        return np.zeros(0, np.int64)
    c = table[a]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:])
    white = c == SPACE
    begin = edge.copy()
    # a run after a blank takes that blank along
    begin[1:] &= ~((a[:-1] == 32) & ~white[1:])
    # the last white space before other text stands apart from the run before it
    begin[:-1] |= white[:-1] & ~white[1:]
    for i in np.flatnonzero(a == 39).tolist():
        if begin[i] and i + 1 < n and edge[i] and c[i + 1] == LETTER:
            two, three = text[i + 1], text[i + 1 : i + 3]
            size = 3 if three in ("re", "ve", "ll") else 2 if two in "stmd" else 0
            if size:
                begin[i + 1] = False
                if i + size < n and c[i + size] == LETTER:
                    begin[i + size] = True
    return np.flatnonzero(begin)


def pieces(text: str, table: np.ndarray) -> list[str]:
    at = starts(text, table).tolist()
    at.append(len(text))
    return [text[i:j] for i, j in zip(at, at[1:])]


class Memo:
    """What pre-tokens encode to, in two generations, so that what it weighs stays bounded; long ones are not kept.

    ``solve`` takes a list of pre-tokens and gives their values.  ``room``: bytes of a generation, as it is reckoned;
    ``longest``: code points of a pre-token that is kept from one call to the next.
    """

    def __init__(self, solve, room: int = 64 << 20, fixed: dict | None = None, longest: int = 4096):
        self.solve, self.room, self.longest = solve, room, longest
        self.fixed = fixed or {}
        self.young: dict = dict(self.fixed)
        self.old: dict = {}
        self.weight = 0
        self.brief: list[str] = []

    def learn(self, found: list[str]) -> None:
        """Afterwards, until the next call, ``young`` has every pre-token of ``found``."""
        for p in self.brief:
            del self.young[p]
        new = set(found).difference(self.young)
        self.brief = [p for p in new if len(p) > self.longest]
        if not new:
            return
        if self.weight > self.room:
            self.old, self.young, self.weight = self.young, dict(self.fixed), 0
            new = set(found).difference(self.young)
        old, young, miss = self.old, self.young, []
        for p in new:
            v = old.get(p)
            if v is None:
                miss.append(p)
            else:
                young[p] = v
        if miss:
            young.update(zip(miss, self.solve(miss)))
        # a key and its value, with what Python has for each
        self.weight += sum(160 + 2 * len(p) for p in new) - sum(160 + 2 * len(p) for p in self.brief)
