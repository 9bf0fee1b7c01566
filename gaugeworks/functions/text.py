"""Text as columns: tokens, cleaning, labels and predicates, all in built-in functions.

Patterns keep to what Java and RE2 read alike: explicit ASCII classes, no look-around.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Piece length below which parts of a snake_case token are no tokens of their own.
MIN_PIECE = 3


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def identifiers(c: Column) -> Column:
    """Lower-case identifiers and numbers of a text in order, repeated ones kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z_][a-z0-9_]+|[0-9]+)"), F.lit(1))


def with_parts(found: Column) -> Column:
    """Identifiers and, behind them, the longer parts of those with underscores."""
    # only tokens with an underscore have parts, and no part of them is the token itself
    joined = F.array_join(F.filter(found, lambda t: F.contains(t, F.lit("_"))), "_")
    return F.concat(found, F.filter(F.split(joined, "_"), lambda p: F.length(p) >= MIN_PIECE))


def tokens(c: Column) -> Column:
    """Lower-case identifiers and numbers, repeated ones kept, and the longer parts of snake_case identifiers."""
    return with_parts(identifiers(c))


#: The same in the second engine's SQL; ``{0}`` is the text.
TOKENS_SQL = (
    "list_concat(regexp_extract_all(lower({0}), '[a-z_][a-z0-9_]+|[0-9]+'), "
    "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z_][a-z0-9_]+|[0-9]+'), lambda t: list_filter(string_split(t, '_'), lambda p: length(p) >= 3 and p <> t))))"
)


def clean_text(c: Column) -> Column:
    """NUL to blank, CRLF to LF, runs of blanks to one, three or more line ends to two, stripped."""
    c = F.replace(F.replace(F.replace(c, F.lit("\0"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def label(c: Column, most: int = 110) -> Column:
    """The first sentence in one line, cut with dots beyond ``most`` characters."""
    first = F.regexp_extract(F.regexp_replace(strip(c), r"\s+", " "), r"^(.*?[.!?])( |$)", 1)
    line = F.when(first != "", first).otherwise(F.regexp_replace(strip(c), r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 3), F.lit("...")))


def mark_weight(c: Column, base: Column) -> Column:
    """``base`` plus a third of the highest number of marks or points that the text names, 3.85 at most."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:\.[0-9]+)?) ?(?:marks?|points?|pts|%)"), F.lit(1))
    top = F.array_max(F.transform(found, lambda x: x.cast("double")))
    return F.round(base + F.when(top.isNotNull(), F.least(top / 3, F.lit(3.85))).otherwise(0.0), 2)


def assessable(c: Column) -> Column:
    """Whether a block says something that can be asked about: no heading, no total, and with a letter."""
    s = strip(c)
    heading = s.rlike(r"^#{1,6} ") | (s.rlike(r":$") & (F.length(s) < 60))
    return ~heading & ~F.lower(s).rlike(r"^(total|sum|overall)\b") & s.rlike(r"[A-Za-zÀ-ÿ\x{4E00}-\x{9FFF}]")


def entropy_bits(c: Column) -> Column:
    """Shannon entropy of a string's characters, in bits a character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, x: acc - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct elements; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))
