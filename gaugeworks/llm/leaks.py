"""Evaluation texts that leaked into documents.

Items and documents become sequences of words. Wu-Manber search over words finds the places where a few consecutive
words of an item stand in a document: a shift table over blocks of two words skips what can't end a pattern, a hash of
the pattern's last words selects the patterns of a place, direct comparison confirms. From each seed the match is
extended word by word, and a document is reported with an item if at least ``MIN_WORDS`` consecutive words of it are
there with at most one word in ``PER_CHANGE`` changed or left out. A match begins and ends with words that agree.

The length of the patterns follows from that (``least_run``): in n >= 12 words with at most n // 8 changes some run of
unchanged words has five; where marks of options stand between the words, which count but may be written in any way, a
run may be shorter, and so are the patterns then.

The items are the stated query set (broadcast after a check of their size, in blocks beyond it); every document is read
whole. Defined results: null or empty texts match nothing; an item with fewer than ``MIN_WORDS`` words never leaks;
items with the same text are all reported; repeated documents are reported under each of their ids.
"""

import html
import re
import unicodedata
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.spread import spread

#: Words of a pattern at most; items whose matches may hold only shorter runs shorten it for all.
SEED = 5
BLOCK = 2
MIN_WORDS = 12
PER_CHANGE = 8
#: Changes that a match need hold at most. One with five or more falls into two at its middle change, with two or more
#: changes each; together they have at least eight words a change, so one of them has, which makes 16 or more, and is a
#: match itself. Option marks beside the middle belong to neither part: eight of them in a row leave the sum enough.
MOST_CHANGES, MARKS_IN_A_ROW = 4, 8
#: Characters of item texts that one pass over the documents searches for; more items are searched in several passes.
PASS_CHARS = 20_000_000

# words: letters and digits with what holds identifiers and contractions together
_WORD = re.compile(r"[^\W_]+(?:[_'][^\W_]+)*")
# tags of any length: in one line, or over several lines if all of it is attributes with values; comments up to their end
_MARKUP = re.compile(
    r"<(?:/?[A-Za-z][^<>\n]*+>|[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=]++))++\s*+/?>|!--(?:[^-]|-(?!->))*+-->)"
)
_SOFT = {"’": "'", "‘": "'", "ʼ": "'", "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "", "\u2060": ""}
#: Marks of options: they stand between the words of an item but may be written in any way.
_MARKERS = frozenset("a b c d e f g h 1 2 3 4 5 6 7 8 i ii iii iv v vi reason grund begründung raison justification".split())


def words(text: str | None) -> list[str]:
    """The words of a text: case, punctuation, layout and markup aside."""
    if not text:
        return []
    if not text.isascii():
        for mark, plain in _SOFT.items():
            if mark in text:
                text = text.replace(mark, plain)
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text:
        text = re.sub(r"(?<=[a-zäöüéèà])-\n[ \t>*#/|]*(?=[a-zäöüéèà])", "", text)
    if "\\" in text:
        text = re.sub(r"\\([_*`\[\]()#+\-.!])", r"\1", text)
    return _WORD.findall(text.lower())


def least_run(place: list[int]) -> int:
    """The longest run of unchanged words that every match of an item must hold; ``place``: of its words among all words."""
    least, n = SEED, len(place)
    for a in range(n):
        changes, b = 1, a
        while changes <= n:
            span = max(MIN_WORDS, PER_CHANGE * changes)
            while b < n and place[b] - place[a] + 1 < span:
                b += 1
            if b == n:
                break
            changes = (place[b] - place[a] + 1) // PER_CHANGE
            least = min(least, -(-(b - a + 1 - changes) // (changes + 1)))
            changes += 1
    return max(least, BLOCK)


def _most_changes(place: list[int]) -> int:
    """The changes that a match of an item need hold at most."""
    if not place:
        return 0
    whole = (place[-1] - place[0] + 1) // PER_CHANGE
    in_a_row = max((b - a - 1 for a, b in zip(place, place[1:])), default=0)
    return min(whole, MOST_CHANGES) if in_a_row <= MARKS_IN_A_ROW else whole


class Searcher:
    """Wu-Manber tables for all windows of ``self.seed`` words of the items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.items: list[list[int]] = []
        #: of each item the places of its words among all words, option marks included
        self.place: list[list[int]] = []
        for _, text in items:
            all_words = words(text)
            kept = [(p, w) for p, w in enumerate(all_words) if w not in _MARKERS]
            self.items.append([self.number.setdefault(w, len(self.number) + 1) for _, w in kept])
            self.place.append([p for p, _ in kept])
        long_enough = [k for k, p in enumerate(self.place) if p and p[-1] - p[0] + 1 >= MIN_WORDS]
        self.seed = seed = min((least_run(self.place[k]) for k in long_enough), default=SEED)
        self.most = [_most_changes(p) for p in self.place]
        self.default = seed - BLOCK + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = {}
        for k in long_enough:
            seq = self.items[k]
            for at in range(len(seq) - seed + 1):
                for j in range(BLOCK, seed + 1):
                    block = seq[at + j - BLOCK] << 32 | seq[at + j - 1]
                    self.shift[block] = min(self.shift.get(block, self.default), seed - j)
                self.bucket.setdefault(self._suffix(seq, at + seed - 1), []).append((k, at))

    def _suffix(self, seq: list[int], end: int) -> int:
        """Hash of the last words of a pattern, three at most."""
        h = seq[end - 1] * 1_000_003 + seq[end]
        return h if self.seed == BLOCK else h + seq[end - 2] * 998_244_353_000_003

    def encode(self, text: str | None) -> list[int]:
        """Numbers of the words of a document; 0 for words that are in no item."""
        get = self.number.get
        return [get(w, 0) for w in words(text) if w not in _MARKERS]

    def seeds(self, seq: list[int]):
        """(item, place in item, place in document) of every window of ``self.seed`` words that an item shares."""
        shift, bucket, items, default, seed = self.shift, self.bucket, self.items, self.default, self.seed
        n, at = len(seq), seed - 1
        while at < n:
            step = shift.get(seq[at - 1] << 32 | seq[at], default)
            if step:
                at += step
                continue
            for k, start in bucket.get(self._suffix(seq, at), ()):
                if items[k][start : start + seed] == seq[at - seed + 1 : at + 1]:
                    yield k, start, at - seed + 1
            at += 1

    def leaked(self, text: str | None) -> list[int]:
        """Ids of the items that the text holds."""
        seq = self.encode(text)
        if len(seq) < self.seed:
            return []
        hit: set[int] = set()
        # of each diagonal the place in the document up to which an exact run was extended
        tried: dict[tuple[int, int], int] = {}
        for k, start, at in self.seeds(seq):
            # seeds of one exact run belong to one match; each run of a diagonal is extended both ways
            if k in hit or at < tried.get((k, at - start), 0):
                continue
            item, b, j = self.items[k], start + self.seed, at + self.seed
            while b < len(item) and j < len(seq) and item[b] == seq[j]:
                b, j = b + 1, j + 1
            tried[k, at - start] = j
            if self._matches(k, start, seq, at):
                hit.add(k)
        return [self.ids[k] for k in sorted(hit)]

    def _matches(self, k: int, start: int, seq: list[int], at: int) -> bool:
        item, place = self.items[k], self.place[k]
        a, b, end_i, end_d = start, start + self.seed, len(item), len(seq)
        j = at + self.seed
        while b < end_i and j < end_d and item[b] == seq[j]:
            b, j = b + 1, j + 1
        i = at
        while a > 0 and i > 0 and item[a - 1] == seq[i - 1]:
            a, i = a - 1, i - 1
        if place[b - 1] - place[a] + 1 >= MIN_WORDS:
            return True
        most = self.most[k]
        right, edge_r = _extend(item, b, 1, seq, j, most)
        left, edge_l = _extend(item, a - 1, -1, seq, i - 1, most)
        if self._long_enough(place, a, b, left, right, most):
            return True
        # where a word comes twice in a row another way to align may end further on, and leave the exact run before its
        # end: asked, from each pattern in the run, only if the edges leave room
        if not self._long_enough(place, a, b, edge_l, edge_r, most):
            return False
        for x in range(a, b - self.seed + 1):
            y, end = i + x - a, x + self.seed
            if self._long_enough(place, x, end, _align(item, x - 1, -1, seq, y - 1, most), _align(item, end, 1, seq, y + self.seed, most), most):
                return True
        return False

    @staticmethod
    def _long_enough(place: list[int], a: int, b: int, left: list[int], right: list[int], most: int) -> bool:
        """Whether left and right ends, given by their cost, make a window that stays within one change in eight."""
        for cost_l, reach_l in enumerate(left):
            lo = a if reach_l < 0 else reach_l
            for cost_r, reach_r in enumerate(right[: most - cost_l + 1]):
                hi = b - 1 if reach_r < 0 else reach_r
                n = place[hi] - place[lo] + 1
                if n >= MIN_WORDS and (cost_l + cost_r) * PER_CHANGE <= n:
                    return True
        return False


def _extend(item: list[int], at: int, step: int, seq: list[int], j: int, most: int) -> tuple[list[int], list[int]]:
    """Per number of changes, up to ``most``, the furthest place of the item beyond ``at`` that agrees (-1: none), and the
    furthest one that is reached at all. A change replaces a word, leaves it out or puts one in."""
    n, m = len(item), len(seq)
    # of each diagonal the furthest place of the item that the present number of changes reaches
    front = {j - at: (at, j)}
    best: list[int] = []
    edge: list[int] = []
    reach, last = -1, n - 1 if step > 0 else 0
    while front and len(best) <= most and reach != last:
        far = -1
        for d, (p, q) in front.items():
            p0 = p
            while 0 <= p < n and 0 <= q < m and item[p] == seq[q]:
                p, q = p + step, q + step
            front[d] = (p, q)
            if p != p0 and (reach < 0 or (p - step - reach) * step > 0):
                reach = p - step
            if p != at and (far < 0 or (p - step - far) * step > 0):
                far = p - step
        best.append(reach)
        edge.append(far)
        new: dict[int, tuple[int, int]] = {}
        for p, q in front.values():
            if not 0 <= p < n:
                continue
            for p2, q2 in ((p + step, q + step), (p + step, q), (p, q + step)):
                if 0 <= q2 < m or q2 == q:
                    d = q2 - p2
                    old = new.get(d)
                    if old is None or (p2 - old[0]) * step > 0:
                        new[d] = (p2, q2)
        front = new
    return best, edge


def _align(item: list[int], at: int, step: int, seq: list[int], j: int, most: int) -> list[int]:
    """As the first part of ``_extend``, over all ways to align: row by row, within ``most`` diagonals of the seed's."""
    best = [-1] * (most + 1)
    # of each shift of the document against the item the fewest changes
    row = {s: s for s in range(most + 1)}
    p = at
    while 0 <= p < len(item) and row:
        new: dict[int, int] = {}
        for s in range(-most, most + 1):
            q = j + (p - at) + s * step
            same = 0 <= q < len(seq) and item[p] == seq[q]
            if same and s in row:
                best[row[s]] = p
            found = [row[s] + (not same)] if s in row and (same or 0 <= q < len(seq)) else []
            if s + 1 in row:
                found.append(row[s + 1] + 1)
            if s - 1 in new:
                found.append(new[s - 1] + 1)
            if found and min(found) <= most:
                new[s] = min(found)
        row = new
        p += step
    for c in range(1, most + 1):
        if best[c] < 0 or best[c - 1] >= 0 and (best[c - 1] - best[c]) * step > 0:
            best[c] = best[c - 1]
    return best


_searchers: dict[int, Searcher] = {}


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold wording of an item."""
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null and item_id is not null").distinct().orderBy("item_id")
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null"))
    out = None
    for part in _passes(rows):
        found = _pass(spark, docs, part)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select("doc_id", F.lit(None).cast("bigint").alias("item_id")).where(F.lit(False))
    return out.distinct()


def _passes(rows: DataFrame):
    """The items in parts of bounded size."""
    part, size = [], 0
    for item_id, text in rows.toLocalIterator():
        part.append((item_id, text))
        size += len(text)
        if size >= PASS_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pass(spark, docs: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
    sent = spark.sparkContext.broadcast(part)
    key = zlib.crc32(repr(part).encode())

    def run(batches):
        if key not in _searchers:
            _searchers.clear()
            _searchers[key] = Searcher(sent.value)
        searcher = _searchers[key]
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
        for batch in batches:
            a, b = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item in searcher.leaked(text.as_py()):
                    a.append(doc_id)
                    b.append(item)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint")
