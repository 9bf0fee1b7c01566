"""Re-Pair grammars over token sequences, inferred for all texts of a block at once.

Re-Pair replaces the most frequent pair of neighbouring symbols by a rule and repeats until no pair occurs twice. Here a
round replaces, in every text, the pairs that occur at least half as often as its most frequent pair; where two of
them overlap the more frequent one wins, then the left one. All texts go through a round together as NumPy arrays, so a
round costs a sort of what is left. Rule names are hashes of their two sides: equal rules have equal names in any text.
"""

from dataclasses import dataclass

import numpy as np

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * _M2
    x = x ^ (x >> U(27))
    x = x * _M3
    return x ^ (x >> U(31))


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _M1 + mix(right + _M1))


@dataclass
class Grammars:
    """Per text: its length in terminals, symbols left in the start rule, number of rules, terminals below rules."""

    terminals: np.ndarray
    start: np.ndarray
    rules: np.ndarray
    reused: np.ndarray
    #: of each rule: text, name, terminals it stands for, times used, terminals it saves
    rule_text: np.ndarray
    rule_name: np.ndarray
    rule_size: np.ndarray
    rule_uses: np.ndarray
    #: name of the whole text: equal for texts with the same sequence
    whole: np.ndarray

    def size(self) -> np.ndarray:
        """Symbols on the right sides of all rules, the start rule included."""
        return self.start + 2 * self.rules


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each place, size of each group) of equal keys; sorts keys and places packed in one number."""
    n = len(key)
    bits = U(max(1, int(n - 1).bit_length()))
    packed = ((key >> bits) << bits) | np.arange(n, dtype=U)
    packed.sort()
    head = packed >> bits
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(head[1:], head[:-1], out=new[1:])
    inv = np.empty(n, np.int64)
    inv[(packed & ((U(1) << bits) - U(1))).astype(np.int64)] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return inv, np.diff(np.r_[first, n])


def infer(symbols: np.ndarray, text: np.ndarray, n_texts: int, block: int = 1 << 16) -> Grammars:
    """Grammars of the texts whose terminals are ``symbols`` (any 64-bit names), ``text`` their owners in ascending order."""
    if not n_texts:
        return _infer(symbols, text, 0)
    ends = np.searchsorted(text, np.arange(n_texts), side="right")
    parts, a = [], 0
    while a < n_texts:
        from_ = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, from_ + block, side="right")))
        parts.append((a, _infer(symbols[from_ : ends[b - 1]], text[from_ : ends[b - 1]] - a, b - a)))
        a = b
    cat = lambda k: np.concatenate([getattr(g, k) for _, g in parts])
    return Grammars(
        cat("terminals"), cat("start"), cat("rules"), cat("reused"), np.concatenate([g.rule_text + a for a, g in parts]),
        cat("rule_name"), cat("rule_size"), cat("rule_uses"), cat("whole"),
    )


def _infer(symbols: np.ndarray, text: np.ndarray, n_texts: int) -> Grammars:
    s = symbols.astype(U)
    t = text.astype(np.int64)
    size = np.ones(len(s), np.int64)
    terminals = np.bincount(t, minlength=n_texts).astype(np.int64)
    whole = np.zeros(n_texts, U)
    if len(s):
        first = np.zeros(n_texts + 1, np.int64)
        np.cumsum(terminals, out=first[1:])
        place = (np.arange(len(s)) - first[t]).astype(U)
        np.add.at(whole, t, mix(s + mix(place + _M1)))
    found: list[tuple[np.ndarray, ...]] = []
    active = np.ones(n_texts, bool)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    # every round shortens some text, so there is a last one
    while len(s) >= 2:
        same = t[1:] == t[:-1]
        name = pair_name(s[:-1], s[1:])
        key = mix(name + t[:-1].astype(U) * _M1)
        # the end of one text and the beginning of the next are no pair of either
        key[~same] = U(0)
        inv, count = _groups(key)
        n = count[inv]
        n[~same] = 0
        most = np.zeros(n_texts, np.int64)
        np.maximum.at(most, t[:-1], n)
        active = most >= 2
        if not active.any():
            break
        take = (n >= 2) & (2 * n >= most[t[:-1]])
        at = np.flatnonzero(take)
        at = _without_overlaps(at, n[at], inv[at])
        if not len(at):
            break
        # of the places taken, a pair that is left with one use is no rule
        kept = np.bincount(inv[at], minlength=len(count))
        at = at[kept[inv[at]] >= 2]
        if not len(at):
            break
        where = np.full(len(count), -1, np.int64)
        where[inv[at[::-1]]] = at[::-1]
        lead = where[where >= 0]
        found.append((t[lead], name[lead], size[lead] + size[lead + 1], kept[inv[lead]]))
        s[at] = name[at]
        size[at] += size[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, t, size = s[keep], t[keep], size[keep]
        # texts in which nothing repeats any more are put aside
        quiet = ~active[t]
        if quiet.mean() > 0.3:
            done.append((t[quiet], size[quiet]))
            s, t, size = s[~quiet], t[~quiet], size[~quiet]
    done.append((t, size))
    t = np.concatenate([d[0] for d in done])
    size = np.concatenate([d[1] for d in done])
    start = np.bincount(t, minlength=n_texts).astype(np.int64)
    reused = np.bincount(t, weights=np.where(size > 1, size, 0), minlength=n_texts).astype(np.int64)
    if found:
        rt, rn, rs, ru = (np.concatenate(x) for x in zip(*found))
    else:
        rt, rn, rs, ru = (np.zeros(0, k) for k in (np.int64, U, np.int64, np.int64))
    return Grammars(terminals, start, np.bincount(rt, minlength=n_texts).astype(np.int64), reused, rt, rn, rs, ru, whole)


def _every_second(at: np.ndarray, new_run: np.ndarray) -> np.ndarray:
    """Mask of the first, third, ... place of each run."""
    first = np.flatnonzero(new_run)
    run = np.cumsum(new_run) - 1
    return (np.arange(len(at)) - first[run]) % 2 == 0


def _without_overlaps(at: np.ndarray, weight: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A subset of the ascending places without neighbours: the heavier of two neighbours stays, else the left one."""
    if len(at) < 2:
        return at
    new = np.ones(len(at), bool)
    # runs of one pair ('a a a a') use every second place
    new[1:] = (at[1:] - at[:-1] != 1) | (key[1:] != key[:-1])
    if not new.all():
        keep = _every_second(at, new)
        at, weight = at[keep], weight[keep]
    for _ in range(2):
        close = at[1:] - at[:-1] == 1
        if not close.any():
            return at
        wins = np.ones(len(at), bool)
        wins[1:] &= ~close | (weight[1:] > weight[:-1])
        wins[:-1] &= ~close | (weight[:-1] >= weight[1:])
        loses = np.zeros(len(at), bool)
        loses[1:] |= close & wins[:-1]
        loses[:-1] |= close & wins[1:]
        at, weight = at[~loses], weight[~loses]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] - at[:-1] != 1
    return at if new.all() else at[_every_second(at, new)]


# classes of bytes: 0 space, 1 word, 2 line end, others stand for themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[9, 11, 12, 13, 32, 0]] = 0
_CLASS[10] = 2
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c == 95 or _c == 36 or _c >= 128:
        _CLASS[_c] = 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
WORD, NUMBER, LINE = U(1), U(3), U(2)


def lexemes(raw: list[bytes]):
    """(symbols, owners) of the texts: words and numbers are one symbol each, punctuation and line ends themselves."""
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    joined = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    kind = _CLASS[joined]
    starts = np.ones(len(kind), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] != 1)
    starts &= kind != 0
    at = np.flatnonzero(starts)
    symbol = kind[at].astype(U)
    symbol[(symbol == WORD) & _DIGIT[joined[at]]] = NUMBER
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, n))
    owner = np.searchsorted(ends, at, side="right")
    return symbol, owner
