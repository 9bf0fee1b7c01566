"""Trigram queries of regular expressions, and an index over blocks of text that answers them.

``query_of(pattern)`` walks the parsed expression and returns a formula in conjunctive form: a list of clauses, each a
set of alternatives, each a set of trigrams that must all occur. A text that the expression can match satisfies every
clause, so postings decide which texts are worth a run of the expression. Both sides are UTF-8 bytes with ASCII letters in
lower case; letters beyond ASCII keep their case, as they do in expressions compiled with ``re.A``.
"""

import re
from re import _constants as sre
from re import _parser as parser

import numpy as np

#: Most strings that a run of alternatives is expanded to before it is cut into clauses.
MAX_STRINGS = 64
#: Largest character class that is expanded.
MAX_CLASS = 8


def _trigrams(s: str) -> frozenset[str]:
    """The trigrams of the UTF-8 bytes of a string, each byte written as one character."""
    s = s.encode("utf-8").decode("latin-1")
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _fold(c: int) -> str:
    return chr(c).lower() if c < 128 else chr(c)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > MAX_CLASS:
            return None
    return out


class _Walk:
    """Clauses found so far, and the run of strings that ends at the present place."""

    def __init__(self) -> None:
        self.clauses: list[frozenset[frozenset[str]]] = []
        self.run = {""}

    def cut(self) -> None:
        found = {_trigrams(s) for s in self.run}
        if found and all(found):
            self.clauses.append(frozenset(found))
        self.run = {""}

    def extend(self, strings: set[str]) -> None:
        if len(self.run) * len(strings) > MAX_STRINGS:
            self.cut()
        if len(strings) > MAX_STRINGS:
            found = {_trigrams(s) for s in strings}
            if all(found):
                self.clauses.append(frozenset(found))
            return
        self.run = {a + b for a in self.run for b in strings}


def _strings(seq) -> set[str] | None:
    """All strings of a sub-expression, if there are few."""
    out = {""}
    for op, arg in seq:
        if op is sre.LITERAL:
            more = {_fold(arg)}
        elif op is sre.IN:
            more = _class(arg)
        elif op is sre.SUBPATTERN:
            more = _strings(arg[3])
        elif op is sre.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            more = None if any(p is None for p in parts) else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            more = _strings(arg[2])
            more = None if more is None else more | {""}
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            more = {""}
        else:
            return None
        if more is None or len(out) * len(more) > 4 * MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _walk(seq, w: _Walk) -> None:
    for op, arg in seq:
        few = _strings([(op, arg)])
        if few is not None:
            w.extend(few)
        elif op is sre.SUBPATTERN:
            _walk(arg[3], w)
        elif op is sre.BRANCH:
            w.cut()
            options: set[frozenset[str]] = set()
            for part in arg[1]:
                inner = _Walk()
                _walk(part, inner)
                inner.cut()
                if not inner.clauses:
                    options = set()
                    break
                # of the clauses of an alternative the one with the fewest options speaks for it
                options |= min(inner.clauses, key=len)
            if options:
                w.clauses.append(frozenset(options))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            w.cut()
            _walk(arg[2], w)
            w.cut()
        else:
            w.cut()


def query_of(pattern: re.Pattern) -> list[frozenset[frozenset[str]]]:
    """The clauses of a compiled expression; an empty list means that any text may match."""
    w = _Walk()
    _walk(parser.parse(pattern.pattern, pattern.flags), w)
    w.cut()
    return list(dict.fromkeys(w.clauses))


def prefixes_of(pattern: re.Pattern) -> list[str]:
    """The shortest strings one of which every match begins with (after look-behinds); empty if there are many or none."""
    seq, out = list(parser.parse(pattern.pattern, pattern.flags)), {""}
    for item in seq:
        more = _strings([item])
        # places are looked for in the text in lower case
        more = None if more is None else {x.lower() for x in more}
        if more is None or len(out) * len(more) > MAX_STRINGS:
            break
        out = {a + b for a in out for b in more}
        if min(map(len, out)) >= 3:
            break
    if min(map(len, out)) < 2:
        return []
    return sorted(a for a in out if not any(a != b and a.startswith(b) for b in out))


def places(prefixes: list[str], low: str) -> list[int]:
    """Where one of the prefixes stands in a text in lower case."""
    seen = set()
    for prefix in prefixes:
        at = low.find(prefix)
        while at >= 0:
            seen.add(at)
            at = low.find(prefix, at + 1)
    return sorted(seen)


def matches(pattern: re.Pattern, prefixes: list[str], text: str, low: str, known: dict | None = None):
    """The matches of ``pattern`` at the places where one of its prefixes stands; ``low`` is the text in lower case.

    ``known`` keeps the places of a text for expressions with the same prefixes.
    """
    if not prefixes or len(low) != len(text):
        yield from pattern.finditer(text)
        return
    key = tuple(prefixes)
    known = {} if known is None else known
    if key not in known:
        known[key] = places(prefixes, low)
    for at in known[key]:
        if m := pattern.match(text, at):
            yield m


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("latin-1")
    return a << 16 | b << 8 | c


class Index:
    """Postings (trigram -> texts) of one block of texts, kept for the trigrams that the given queries ask for."""

    _FOLD = np.arange(256, dtype=np.uint8)
    _FOLD[65:91] += 32

    def __init__(self, queries: dict[str, list[frozenset[frozenset[str]]]]) -> None:
        self.queries = queries
        self.codes = sorted({_code(t) for q in queries.values() for clause in q for option in clause for t in option})
        self.slot = np.zeros(1 << 24, np.uint16)
        self.slot[self.codes] = np.arange(1, len(self.codes) + 1, dtype=np.uint16)
        self.at = {c: i + 1 for i, c in enumerate(self.codes)}

    def candidates(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of each query the ordinals of the texts that satisfy it."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        n = len(raw)
        joined = self._FOLD[np.frombuffer(b"\0\0".join(raw), np.uint8)] if n else np.zeros(0, np.uint8)
        has = np.zeros((len(self.codes) + 1, n), bool)
        if len(joined) > 2:
            code = joined[:-2].astype(np.uint32) << 16
            code |= joined[1:-1].astype(np.uint32) << 8
            code |= joined[2:]
            slot = self.slot[code]
            hits = np.flatnonzero(slot)
            ends = np.cumsum(np.fromiter((len(r) + 2 for r in raw), np.int64, n))
            has[slot[hits], np.searchsorted(ends, hits, side="right")] = True
        out = {}
        for name, query in self.queries.items():
            ok = np.ones(n, bool)
            for clause in query:
                any_ = np.zeros(n, bool)
                for option in clause:
                    all_ = np.ones(n, bool)
                    for t in option:
                        all_ &= has[self.at[_code(t)]]
                    any_ |= all_
                ok &= any_
            out[name] = np.flatnonzero(ok)
        return out
