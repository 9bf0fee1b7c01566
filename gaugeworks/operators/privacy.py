"""Privacy-safe outputs: scanning, allow-lists, bands, small-cell suppression, exclusions, manifests.

Detectors are patterns without look-around, so that every engine reads them alike. Defined results: null texts hold
nothing; unknown or unreadable durations are 'unknown'; a count of zero is a small cell.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.spread import spread

# Patterns of the detectors by category.
DETECTORS = {
    "student_id": r"(^|[^0-9])[0-9]{9}([^0-9]|$)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"(?i)(^|[^A-Za-z0-9_])(https?://|ftp://|git@|ssh://|www\.)[^ \t\r\n]",
    "windows_path": r"[A-Za-z]:\\[\\A-Za-z0-9_ .+-]+",
    "filesystem_path": r"(^|[ \t\r\n\"'(=:])/([A-Za-z0-9_.+-]+/)+",
    "filename": r"(?i)[A-Za-z0-9_./+-]\.(py|ipynb|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp|go|rb|rs|php|sql|md|txt|csv|tsv|json|ya?ml|toml|cfg|ini|env|pem|key|sh|bat)([^A-Za-z0-9_]|$)",
    "aws_key": r"(^|[^A-Za-z0-9_])(AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}([^A-Za-z0-9_]|$)",
    "github_token": r"(^|[^A-Za-z0-9_])((ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}([^A-Za-z0-9_]|$)|github_pat_[A-Za-z0-9_]{22,})",
    "private_key": r"-----BEGIN ([A-Z0-9 ]+ )?PRIVATE KEY-----",
    "secret_assignment": r"(?i)(^|[^A-Za-z0-9_])(password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|bearer|client[_-]?secret|private[_-]?key)[ \t]*[:=]",
    "exact_timestamp": r"(^|[^0-9A-Za-z_])[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}",
}
#: What a text must hold for some detectors to find anything: looked for first, since it is found or missed faster.
HINTS = {
    "aws_key": ("AKIA", "ASIA", "AIDA", "AROA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "private_key": ("PRIVATE KEY",), "windows_path": (":\\",), "email": ("@",),
}
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:"
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
ENTROPY_BITS = 3.5
# Keys that a research record may have, and keys that it must never have.
ALLOWED_KEYS = (
    "study_record_id semester assignment question_topic question_template selected_response correct duration_band completion_period "
    "structure_counts complexity_band review_outcome consent_version deid_rule_version"
).split()
FORBIDDEN_KEYS = (
    "repo_id repoid folder_id folderid sid student_id project_id assessment_id attempt_id question_id completion_code completion taker_name name "
    "ip ip_address session_id session submitted_at created_at updated_at timestamp upload_name archive_name original_name "
    "repository_url repo_url url file_path filesystem_path path"
).split()
MIN_CELL = 5
#: Terms up to which their table is broadcast.
MOST_TERMS = 1_000_000
REPO_ID = r"^[A-Za-z0-9_-]{1,32}$"
VERSIONS = {"schema_version": "1", "deid_rule_version": "1", "suppression_rule_version": "1"}


def high_entropy(c: Column) -> Column:
    """Whether the text has a token of 24 or more characters with letters, digits and high entropy."""
    from gaugeworks.functions.text import entropy_bits

    found = F.filter(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    return F.exists(found, lambda t: F.round(entropy_bits(t), 6) >= ENTROPY_BITS)


def _found(c: Column, name: str, pattern: str) -> Column:
    hints = [F.contains(c, F.lit(x)) for x in HINTS.get(name, ())] or ([c.rlike(DATE)] if name == "exact_timestamp" else [])
    return reduce(Column.__or__, hints) & c.rlike(pattern) if hints else c.rlike(pattern)


def categories(c: Column) -> Column:
    """The sorted categories of what a text gives away."""
    c = F.coalesce(c, F.lit(""))
    hits = [F.when(_found(c, n, p), F.lit(n)) for n, p in DETECTORS.items()] + [F.when(high_entropy(c), F.lit("high_entropy"))]
    return F.array_sort(F.array_compact(F.array(*hits)))


def scan(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, categories) of the rows of which some column gives something away."""
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*[categories(F.col(x)) for x in columns]))))
    # exploded and not filtered: a filter on the result would be pushed below it and search every text twice
    some = F.filter(F.array(found), lambda c: F.size(c) > 0)
    return spread(df.select(key, *columns)).select(key, F.explode(some).alias("categories"))


def with_forbidden_terms(df: DataFrame, key: str, column: str, terms: list[str]) -> DataFrame:
    """(key, term): known identifiers of three or more characters that stand in a text as words."""
    wanted = sorted({t.strip().lower() for t in terms if len(t.strip()) >= 3})
    single = [t for t in wanted if re.fullmatch("[a-z0-9_]+", t)]
    low = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(" "))
    # the list is the caller's own and part of the plan: words meet as equal keys, other terms are searched for as they stand
    table = df.sparkSession.createDataFrame([(t,) for t in single], "term string")
    words = df.select(key, F.explode(F.array_distinct(F.split(low, "[^A-Za-z0-9_]+"))).alias("term")).join(F.broadcast(table) if len(single) <= MOST_TERMS else table, "term")
    rest = [t for t in wanted if t not in set(single)]
    if not rest:
        return words.select(key, "term")
    phrases = df.select(key, F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in rest]))).alias("term"))
    return words.select(key, "term").unionByName(phrases)


def duration_band(seconds: Column) -> Column:
    s = seconds.try_cast("double")
    return (
        F.when(s.isNull() | F.isnan(s) | (s < 0), "unknown").when(s < 30, "under_30s").when(s < 90, "30_90s").when(s < 180, "90_180s").when(s < 300, "180_300s").otherwise("over_300s")
    )


def completion_period(at: Column, opened: Column, deadline: Column) -> Column:
    """Thirds of the time between opening and deadline, both included."""
    part = F.try_divide((at - opened).cast("double"), (deadline - opened).cast("double"))
    return F.when(part.isNull() | F.isnan(part) | (part < 0) | (part > 1), "unknown").when(part <= 1 / 3, "early").when(part <= 2 / 3, "middle").otherwise("late")


def key_problem(keys: Column) -> Column:
    """Why a record's keys make it unfit: a forbidden key, then an unknown one; null if none does."""
    low = F.transform(keys, F.lower)
    bad = F.array_sort(F.array_intersect(low, F.array(*map(F.lit, FORBIDDEN_KEYS))))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, ALLOWED_KEYS))))
    return F.when(F.size(bad) > 0, F.concat(F.lit("forbidden:"), F.array_join(bad, ","))).when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ",")))


def suppressed_cells(counts: DataFrame, group: str, category: str, n: str, least: int = MIN_CELL) -> DataFrame:
    """(group, category, n, suppressed, reportable): small cells hidden, and a second one where one alone could be told.

    ``counts`` holds one row per group and category, absent cells as rows with 0 (``dense`` makes them).
    """
    g = Window.partitionBy(group)
    small = F.col(n) < least
    marked = counts.withColumn("_small", small)
    smalls = F.sum(F.col("_small").cast("int")).over(g)
    released = F.sum((~F.col("_small")).cast("int")).over(g)
    rank = F.row_number().over(Window.partitionBy(group, "_small").orderBy(n, category))
    hidden = F.col("_small") | ((smalls == 1) & (released > 0) & ~F.col("_small") & (rank == 1))
    total = F.sum(n).over(g)
    return marked.select(group, category, F.when(~hidden & (total >= least), F.col(n)).alias(n), hidden.alias("suppressed"), (total >= least).alias("reportable"))


def dense(counts: DataFrame, groups: DataFrame, categories_: DataFrame, group: str, category: str, n: str) -> DataFrame:
    """Counts with zero cells. ``categories_`` is a table of kinds: it is broadcast after its size was counted."""
    few = categories_.distinct()
    if few.limit(10_001).count() > 10_000:
        raise ValueError("too many categories for a table of cells")
    # every group meets every kind: the result has these rows by definition
    grid = groups.distinct().join(F.broadcast(few))
    return grid.join(counts, [group, category], "left").na.fill({n: 0})


def valid_repo_id(c: Column) -> Column:
    """The trimmed id, or null if it is malformed or could be a student number."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(s.rlike(REPO_ID) & ~s.rlike("^[0-9]{7,}$"), s)


def sanitised_repo_id(c: Column) -> Column:
    """The id without illegal characters, cut to 32; blank if only seven or more digits are left."""
    s = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 32)
    return F.when(s.rlike("^[0-9]{7,}$"), "").otherwise(s)


def exclusion_audit(entries: DataFrame, attempts: DataFrame, entry: str = "entry", repo_id: str = "repo_id") -> DataFrame:
    """One row of counts: excluded attempts, unmatched and invalid entries; no ids."""
    items = entries.select(F.explode(F.split(F.coalesce(F.col(entry), F.lit("")), "[\r\n,]+")).alias("e"))
    parsed = items.select(valid_repo_id(F.col("e")).alias("rid"), (F.trim("e") != "").alias("given"))
    valid = parsed.where("rid is not null").select("rid").distinct()
    per_id = attempts.where(F.coalesce(F.col(repo_id), F.lit("")) != "").groupBy(F.col(repo_id).alias("rid")).agg(F.count(F.lit(1)).alias("n"))
    hit = valid.join(per_id, "rid", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("excluded_attempts"), F.count_if(F.col("n").isNull()).alias("unmatched_ids"))
    bad = parsed.agg(F.count_if(F.col("rid").isNull() & F.col("given")).alias("invalid_entries"))
    return hit.join(F.broadcast(bad))


def exclude(attempts: DataFrame, entries: DataFrame, entry: str = "entry", repo_id: str = "repo_id") -> DataFrame:
    items = entries.select(F.explode(F.split(F.coalesce(F.col(entry), F.lit("")), "[\r\n,]+")).alias("e"))
    return attempts.join(items.select(valid_repo_id(F.col("e")).alias(repo_id)).where(F.col(repo_id).isNotNull()).distinct(), repo_id, "left_anti")


def manifest(parts: dict[str, DataFrame], checked: dict[str, str]) -> DataFrame:
    """(file, n_rows, checksum, versions...): counts and a checksum over ``checked`` columns that no order changes."""
    out = None
    for name, df in parts.items():
        digest = F.conv(F.substring(F.sha2(F.coalesce(F.col(checked[name]).cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("bigint")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(digest % 1_000_000_007), F.lit(0)).alias("checksum"))
        one = one.select(F.lit(name).alias("file"), "n_rows", "checksum", *[F.lit(v).alias(k) for k, v in VERSIONS.items()])
        out = one if out is None else out.unionByName(one)
    return out


def random_record_id() -> Column:
    return F.concat(F.lit("sr_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def strings_in(json_text: Column) -> Column:
    """All labels and texts of a JSON value at any depth; numbers and truth values are no text."""
    return F.regexp_extract_all(json_text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))


def record_problem(json_text: Column, exempt: str = "study_record_id") -> Column:
    """Why a record (JSON of an object) may not be released: a forbidden key, an unknown one, a label or text at any depth
    that gives something away; null if it may. The record's own id is no such text."""
    keys = F.json_object_keys(json_text)
    low = F.transform(keys, F.lower)
    bad = F.arrays_overlap(low, F.array(*map(F.lit, FORBIDDEN_KEYS)))
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, ALLOWED_KEYS)))) > 0
    rest = F.regexp_replace(json_text, rf'"{exempt}"[ \t]*:[ \t]*"[^"]*"', f'"{exempt}":""')
    gives_away = F.exists(strings_in(rest), lambda t: F.size(categories(t)) > 0)
    return F.when(bad, "forbidden_key").when(unknown, "unknown_key").when(gives_away, "gives_away")


def assert_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, of which reading any row fails whose columns give something away; the message names categories, never a value."""
    found = F.array_distinct(F.flatten(F.array(*[categories(F.col(c).cast("string")) for c in columns])))
    refuse = F.when(F.size(found) > 0, F.raise_error(F.concat(F.lit("sensitive: "), F.array_join(found, ",")))).otherwise(F.lit(True))
    return df.withColumn("_clean", refuse.cast("boolean")).where("_clean").drop("_clean")
