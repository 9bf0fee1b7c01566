"""Text garbled by a wrong decoding: find it and restore what can be restored.

For every pair (true encoding, wrong encoding) the garbled form of each character of a repertoire is computed once, and
all forms go into one Aho-Corasick automaton. Its matches in a paragraph are weighed per pair; a paragraph is garbled if
the evidence of a pair is enough (``_weigh``). Only matched spans are replaced (a span takes in its neighbours only if the
wrong encoding can have made all of it and all of it can be undone), and spans that a sentence merely quotes
are left alone, so text that is right stays untouched. Text that was decoded several times is restored in as many rounds.

A replacement character inside a word is a garbled place that can't be restored.

Defined results: null and empty texts aren't garbled; paragraphs are lines; a text of any length is read whole.
"""

import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.spread import spread

# Encodings that text is written in, and those that it is wrongly read in.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "cp1257", "iso8859-2", "iso8859-15")
WIDE_READ_AS = ("latin-1", "cp1252", "mac_roman", "cp1251")  # of gb18030
NARROW = (("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"))
#: Letters of the languages whose text a one-byte encoding holds.
NARROW_LETTERS = {"cp1250": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "iso8859-2": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"}
#: Signs of ordinary text: they are no evidence of a one-byte mix-up.
ORDINARY = frozenset("’‘“”–—…«»•·°§©®™€£„‚‹›¿¡ªº±×÷µ²")
WESTERN = "äöüßÄÖÜéèêëàâçîïôûùœñáíóúãõ"


def _repertoire() -> list[str]:
    """Characters whose garbled forms are looked for: letters of European languages, punctuation, symbols, common Han."""
    ranges = ((0xA0, 0x250), (0x386, 0x3CF), (0x400, 0x460), (0x1E80, 0x1EFA), (0x2010, 0x2046), (0x20A0, 0x20C0), (0x2100, 0x2130), (0x2190, 0x21D6), (0x2200, 0x2270), (0x25A0, 0x2620), (0x2713, 0x2718), (0x3000, 0x3020), (0xFF01, 0xFF60))
    out = [chr(c) for a, b in ranges for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    return out + _han()


def _han() -> list[str]:
    """The common Han characters: the first level of GB 2312, by its rows."""
    out = []
    for row in range(0xB0, 0xD8):
        for cell in range(0xA1, 0xFF):
            try:
                out.append(bytes((row, cell)).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return out


def _table(encoding: str) -> list[str]:
    """The character of each byte; bytes that the encoding leaves open are read as control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes((b,)).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


TABLES = {e: _table(e) for e in dict.fromkeys(UTF8_READ_AS + WIDE_READ_AS + tuple(w for _, w in NARROW))}
BYTES = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in TABLES.items()}


_CUT = "â€"


@dataclass(frozen=True)
class Pair:
    """How a text was garbled: written in ``true``, read in ``wrong``. kind: 'utf8', 'wide', 'narrow' or 'han'."""

    true: str
    wrong: str
    kind: str


def _forms():
    """(garbled form, pair) of all pairs; a form of several pairs comes once for each."""
    chars = _repertoire()
    for wrong in UTF8_READ_AS:
        pair, table = Pair("utf-8", wrong, "utf8"), TABLES[wrong]
        for c in chars:
            yield "".join(table[b] for b in c.encode("utf-8")), pair
    for wrong in WIDE_READ_AS:
        pair, table = Pair("gb18030", wrong, "wide"), TABLES[wrong]
        for c in _han() + list("，。；：？！“”、（）"):
            yield "".join(table[b] for b in c.encode("gb18030")), pair
    for true, wrong in NARROW:
        pair, table = Pair(true, wrong, "narrow"), TABLES[wrong]
        for c in NARROW_LETTERS.get(true, WESTERN):
            try:
                (b,) = c.encode(true)
            except (UnicodeEncodeError, ValueError):
                continue
            form = table[b]
            if form != c and not form.isascii() and (form not in ORDINARY or form in "¿±" and true in NARROW_LETTERS):
                yield form, pair
    # a closing quotation mark whose last byte the wrong encoding leaves open, and which was dropped
    yield _CUT, Pair("utf-8", "cp1252", "utf8")
    # UTF-8 read as GBK: three bytes a character, two a garbled one; marks with their common followers
    pair = Pair("utf-8", "gb18030", "han")
    marks = "，。；：？！、“”（）的是我在如函评请每该不有了"
    for a in marks:
        raw = a.encode("utf-8")
        yield raw[:2].decode("gb18030", "ignore"), pair
    for a in "äöüßéèêàâçîïôûùœñáíóúãõąćęłńśźż’“”–—…→≥≤×±€":
        for b in "abcdefghijklmnopqrstuvwxyz":
            for s in (a + b, b + a):
                form = s.encode("utf-8").decode("gb18030", "ignore")
                if len(form) == 2 and sum(not x.isascii() for x in form) == 1 and not _common(form):
                    yield form, pair


_HAN_COMMON = frozenset(_han())


def _common(form: str) -> bool:
    return any(c in _HAN_COMMON for c in form)


_automaton = None


def automaton():
    """The automaton of all forms, built once a process; a form's value is the list of its pairs."""
    global _automaton
    if _automaton is None:
        forms: dict[str, list[Pair]] = {}
        for form, pair in _forms():
            if form and not form.isascii():
                known = forms.setdefault(form, [])
                if pair not in known:
                    known.append(pair)
        a = ahocorasick.Automaton()
        for form, pairs in forms.items():
            a.add_word(form, (len(form), tuple(pairs)))
        a.make_automaton()
        _automaton = a
    return _automaton


_OPEN = "“‘\"'`«‹„([<„「『"
_CLOSE = "”’\"'`»›“)]>「」』"
_LOST = re.compile(r"(?<=[^\W\d_])�+|�+(?=[^\W\d_])")
#: What is left of a garbled character some of whose bytes are gone.
_LEFT = re.compile(r"[\x80-\x9f]|[Â-ï][\xa0-\xbf‚ƒ„†‡ˆ‰‹Œ‘’“”•–—˜™›œ]")


#: Words of a sentence that speaks about characters.
_ABOUT = re.compile(
    r"(?i)\b(?:search(?:ed|ing)? for|grep|look for|stray|char(?:acter)?s?\b|charsets?|encod\w+|decod\w+|mojibake|garbled|unicode|utf-?8|latin-?1|viewer|raw dump|byte\w*|symbols?|glyphs?|"
    r"turns? up|shows? up|shown as|displayed as|appears? as|printed as|renders? as|instead of|hints? at|zeichen\w*|kodierung|caract\w+|codificaci\w+|encodage|znak\w*|kodowani\w*)"
)


def _spoken_of(line: str, a: int, b: int) -> bool:
    """Whether a span that stands alone, as a word of its own, is the subject of a sentence about characters."""
    while a and not line[a - 1].isspace():
        a -= 1
    while b < len(line) and not line[b].isspace():
        b += 1
    if re.search(r"[A-Za-z0-9]", line[a:b]):
        return False
    start = max(line.rfind(x, 0, a) for x in (". ", "? ", "! ", "; ")) + 1
    ends = [e for e in (line.find(x, b) for x in (". ", "? ", "! ", "; ")) if e >= 0]
    return bool(_ABOUT.search(line[start : min(ends, default=len(line))]))


def _quoted(line: str, a: int, b: int) -> bool:
    """Whether the span alone stands between quotation marks: then it is spoken of, not garbled."""
    while a and not line[a - 1].isascii() and line[a - 1] not in _OPEN:
        a -= 1
    while b < len(line) and not line[b].isascii() and line[b] not in _CLOSE:
        b += 1
    return 0 < a and b < len(line) and line[a - 1] in _OPEN and line[b] in _CLOSE


def _spans(line: str) -> dict[Pair, list[tuple[int, int]]]:
    """The matches of each pair in a line, the longest where they overlap, without quoted ones."""
    found: dict[Pair, list[tuple[int, int]]] = {}
    for end, (n, pairs) in automaton().iter(line):
        span = (end + 1 - n, end + 1)
        for p in pairs:
            found.setdefault(p, []).append(span)
    out = {}
    for p, spans in found.items():
        spans.sort(key=lambda s: (s[0], -s[1]))
        kept: list[tuple[int, int]] = []
        for s in spans:
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        # a sentence speaks of one or two characters, not of many
        few = len(kept) <= 3
        out[p] = [s for s in kept if not _quoted(line, *s) and not (few and _spoken_of(line, *s))]
    return {p: s for p, s in out.items() if s}


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_POLISH = re.compile(
    r"(?<=[aeiouyóêæ])œ|œ(?=[æwpk])|ñ(?=[bcdfghjklmnprstwz])|(?<=[a-zóœæ])ñ(?!\w)|(?<=[aeiyuóœ])æ(?!\w)|(?<=i)ê(?=[cdkgbp]|(?!\w))|(?<=z)ê(?!\w)|(?<=[a-zóœæê])[ŸŒ](?=[a-zœæê]|(?!\w))"
    r"|(?<=[a-zó])[¼¶](?=[a-z])"
)
#: Of pairs that turn letters into letters: where no language that writes the garbled letters has them.
MISPLACED = {("cp1250", "cp1252"): _POLISH, ("iso8859-2", "latin-1"): _POLISH, ("mac_roman", "cp1252"): re.compile(r"(?<=[a-zš§])[ŠŸŽ](?=[a-zš§]|(?!\w))")}
_MAY_BE_MISPLACED = re.compile("[œñæêŸŒ¼¶ŠŽ]")
#: Misplaced letters in a document from which its lines with such letters are garbled.
MISPLACED_LEAST = 2


def _misplaced(text: str) -> frozenset[tuple[str, str]]:
    """The pairs for which the letters of a whole text, without quoted ones, are evidence enough."""
    if not _MAY_BE_MISPLACED.search(text):
        return frozenset()
    return frozenset(k for k, p in MISPLACED.items() if sum(not _quoted(text, *m.span()) for m in p.finditer(text)) >= MISPLACED_LEAST)


def _weigh(pair: Pair, line: str, spans: list[tuple[int, int]], pooled: frozenset = frozenset()) -> list[tuple[int, int]]:
    """The spans that count as garbled; none if the evidence of the pair in this line is too weak."""
    if pair.kind == "utf8":
        return spans
    if pair.kind == "wide":
        # two-byte characters: one alone may be two letters of a word in capitals
        good = []
        for a, b in _runs(spans):
            if b - a >= 4 and not _plain_word(line, a, b):
                good.append((a, b))
        return good
    if pair.kind == "han":
        good = []
        for a, b in spans:
            lo, hi = a, b
            while lo and _is_wide(line[lo - 1]):
                lo -= 1
            while hi < len(line) and _is_wide(line[hi]):
                hi += 1
            if hi - lo >= 3 and (not good or good[-1] != (lo, hi)) and _from_gbk(line[lo:hi]):
                good.append((lo, hi))
        return good
    # one byte for one byte: strong is a sign that is no letter, or a letter of another script, inside a word
    strong = weak = 0
    for a, b in spans:
        before = line[a - 1] if a else " "
        after = line[b] if b < len(line) else " "
        near = before.isalpha() and before.isascii(), after.isalpha() and after.isascii()
        mark = line[a:b]
        odd = not mark.isalpha() or not unicodedata.name(mark[0], "").startswith("LATIN")
        if odd and near[0] and (near[1] or mark in "¹³¿Ÿ¼¶±"):
            strong += 1 + (near[0] and near[1])
        elif any(near):
            weak += 1
    key = pair.true, pair.wrong
    at = {m.start() for m in MISPLACED[key].finditer(line)} if key in pooled else ()
    if strong >= 2 and (strong >= 3 or weak >= 1) or any(a in at for a, _ in spans):
        # runs of them are parts of words too
        return [x for a, b in _runs(spans) if (a and line[a - 1].isalpha()) or (b < len(line) and line[b].isalpha()) for x in spans if a <= x[0] < b]
    return []


def _plain_word(line: str, a: int, b: int) -> bool:
    """Latin letters only, within one word of mixed ASCII: an ordinary word in capitals."""
    return all(c.isalpha() for c in line[a:b]) and ((a and line[a - 1].isalpha() and line[a - 1].isascii()) or (b < len(line) and line[b].isalpha() and line[b].isascii())) and b - a < 6


def _is_wide(c: str) -> bool:
    return ord(c) >= 0x2E80 or c == "�" or c in "€ˉ°·〃—～‖…“”〔〕〈〉《》「」『』"


def _from_gbk(run: str) -> bool:
    """Whether the run, written as GBK, reads as UTF-8 text."""
    raw = b"".join(c.encode("gb18030") if c != "�" else b"\xff" for c in run)
    text = raw.decode("utf-8", "replace")
    bad = text.count("�")
    good = sum(_is_wide(c) and c != "�" or c.isalpha() for c in text)
    return good >= 2 and bad <= good


def _undo(pair: Pair, piece: str) -> str | None:
    """The text that was garbled into ``piece``; None if it can't be told."""
    if pair.kind == "han":
        raw = b"".join(c.encode("gb18030") if c != "�" else b"\xff" for c in piece)
        text = raw.decode("utf-8", "replace")
        return None if "�" in text else text
    table = BYTES[pair.wrong]
    try:
        return bytes(table[c] for c in piece).decode(pair.true)
    except (KeyError, UnicodeDecodeError):
        return "”" if pair.wrong == "cp1252" and piece == _CUT else None


def _widen(pair: Pair, line: str, a: int, b: int) -> tuple[int, int]:
    """The span with the neighbouring characters that the wrong encoding may have made, if all of it can be undone."""
    table = BYTES[pair.wrong]
    lo, hi = a, b
    while lo and not line[lo - 1].isascii() and line[lo - 1] in table:
        lo -= 1
    while hi < len(line) and not line[hi].isascii() and line[hi] in table:
        hi += 1
    return (lo, hi) if (lo, hi) != (a, b) and _undo(pair, line[lo:hi]) is not None else (a, b)


#: Letters and signs that text has often.
_OFTEN = frozenset(WESTERN + "ąćęłńóśźż’“”–—…€→≥≤×±§«»¿¡")


def _best(line: str, weighed: dict[Pair, list[tuple[int, int]]]) -> Pair:
    """The pair that explains most of the line; of equal ones the one whose text is the more ordinary."""
    covered = {p: sum(b - a for a, b in s) for p, s in weighed.items()}
    most = max(covered.values())
    tied = [p for p, n in covered.items() if n == most]
    if len(tied) == 1:
        return tied[0]

    def ordinary(p: Pair) -> int:
        n = 0
        for a, b in weighed[p]:
            text = _undo(p, line[a:b]) or ""
            n += sum(c in _OFTEN for c in text)
            # a capital after a small letter is none that was written
            n -= bool(text and text[0].isupper() and a and line[a - 1].islower())
        return n

    return max(tied, key=lambda p: (ordinary(p), p.kind == "utf8", -UTF8_READ_AS.index(p.wrong) if p.kind == "utf8" else 0))


def _line(line: str, pooled: frozenset = frozenset()) -> tuple[str, bool, bool]:
    """(the line restored, whether it was garbled, whether some of it couldn't be restored)."""
    garbled = lost = False
    seen: set[str] = set()
    # text may have been decoded wrongly more than once; a form that was there before ends the search
    while not line.isascii() and line not in seen:
        seen.add(line)
        weighed = {p: w for p, s in _spans(line).items() if (w := _weigh(p, line, s, pooled))}
        if not weighed:
            break
        garbled = True
        pair = _best(line, weighed)
        out, at, changed = [], 0, False
        for a, b in _runs(weighed[pair]):
            if a < at:
                continue
            if pair.kind == "utf8":
                a, b = _widen(pair, line, max(a, at), b)
                a = max(a, at)
            text = _undo(pair, line[a:b])
            if text is None:
                lost = True
                text = line[a:b]
            else:
                changed = True
            out += [line[at:a], text]
            at = b
        line = "".join(out) + line[at:]
        if not changed:
            break
    lost = lost or garbled and bool(_LEFT.search(line))
    if "�" in line and any(not _quoted(line, *m.span()) for m in _LOST.finditer(line)):
        garbled = lost = True
    return line, garbled, lost


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """(the text restored as far as possible, whether it was garbled, whether all of it was restored)."""
    if not text or text.isascii():
        return text, False, True
    garbled = lost = False
    lines = text.split("\n")
    pooled = _misplaced(text)
    for i, line in enumerate(lines):
        if not line.isascii():
            lines[i], g, x = _line(line, pooled)
            garbled |= g
            lost |= x
    return ("\n".join(lines) if garbled else text), garbled, not lost


def repaired(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, restored, text) of the garbled documents, ``text`` as far as it could be restored."""
    schema = "doc_id bigint, restored boolean" + (", text string" if with_text else "")

    def run(batches):
        for batch in batches:
            ids, ok, texts = [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, garbled, whole = repair(value.as_py())
                if garbled:
                    ids.append(doc_id)
                    ok.append(whole)
                    texts.append(text)
            if ids:
                columns = [pa.array(ids, pa.int64()), pa.array(ok, pa.bool_())] + ([pa.array(texts, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "restored", "text"][: len(columns)])

    df = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # plain ASCII can't be garbled: it never leaves the JVM
    return spread(df.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))).mapInArrow(run, schema)


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a garbled paragraph, restorable or not."""
    return repaired(documents, with_text=False).select("doc_id").distinct()
