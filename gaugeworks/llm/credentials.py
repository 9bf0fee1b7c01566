"""Credentials embedded in source code: find and redact.

Each block of chunks gets a trigram index; from every detection expression the required trigrams are derived, postings
are intersected and the expression is run only on the chunks that are left. A found value must look like a credential
(``is_live``): stand-ins, lookups, names of secrets and checksums are no credentials.

Defined results: a chunk without text gives no rows; a chunk whose id is null is skipped; the same line is listed once
per chunk however many values start on it; exact repeats of a project add nothing; a text of any length is read whole.
"""

import math
import re
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.repeats import once_per_key
from gaugeworks.llm.chunks import chunks_of, map_blocks, text_of
from gaugeworks.llm.trigrams import Index, matches, prefixes_of, query_of

# Words that stand in for a value, and kinds of files whose values need no quotes.
STAND_INS = (
    "changeme change_me replace_me replaceme insert-token insert_token your-key your_key your-token your_token yourkey "
    "your_api_key your-api-key example dummy todo none null xxxx placeholder redacted sample secret password passw0rd "
    "undefined true false fixme tbd insert-key my-secret mysecret test token"
).split()
CONFIG_SUFFIXES = ".env .sample .toml .yml .yaml .properties .ini .cfg .conf .sh .md .rst .txt .ipynb .json".split()

NAME = (
    r"(?:secret|passwd|password|passphrase|pass|pwd|token|api[_\-]?key|access[_\-]?key|signing[_\-]?key|private[_\-]?key"
    r"|auth[_\-]?key|encryption[_\-]?key|account[_\-]?key|client[_\-]?key|auth|bearer|credential|creds"
    # the same words in other languages
    r"|passwort|kennwort|zugang|clave|contrasena|mot[_\-]?de[_\-]?passe|senha|haslo)"
)
#: Ends of names that tell about a credential without being one.
NOT_A_VALUE = re.compile(
    r"(?i)(?:_|-|\.)?(?:name|file|path|pattern|regex|length|len|size|limit|count|mode|rate|defaults?|type|url|uri|ttl|expiry|"
    r"field|label|id|header|hash|digest|checksum|min|max|prompt|hint|total|map|index|env|var|policy)$"
)
_F = re.I | re.A | re.M


def _d(pattern: str) -> re.Pattern:
    return re.compile(pattern, _F)


#: Expressions for values that carry their own mark; case counts, so it is checked again by ``_EXACT``.
MARKED = {
    "private_key": _d(r"(?P<v>-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----)"),
    "github": _d(r"(?<![A-Za-z0-9_])(?P<v>gh[pousr]_[A-Za-z0-9]{30,})"),
    "github_fine": _d(r"(?<![A-Za-z0-9_])(?P<v>github_pat_[A-Za-z0-9_]{30,})"),
    "stripe": _d(r"(?<![A-Za-z0-9_])(?P<v>[srp]k_live_[A-Za-z0-9]{16,})"),
    "slack": _d(r"(?<![A-Za-z0-9_])(?P<v>xox[abeprs]-[0-9A-Za-z\-]{16,})"),
    "aws_id": _d(r"(?<![A-Za-z0-9])(?P<v>A(?:KIA|SIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    "google": _d(r"(?<![A-Za-z0-9_])(?P<v>AIza[A-Za-z0-9_\-]{30,})"),
    "gitlab": _d(r"(?<![A-Za-z0-9_])(?P<v>glpat-[A-Za-z0-9_\-]{18,})"),
    "sendgrid": _d(r"(?<![A-Za-z0-9_])(?P<v>SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,})"),
    "npm": _d(r"(?<![A-Za-z0-9_])(?P<v>npm_[A-Za-z0-9]{30,})"),
    "jwt": _d(r"(?<![A-Za-z0-9_])(?P<v>eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{16,})"),
    "webhook": _d(r"/(?:hooks|services|webhooks)/(?P<v>[TB][A-Z0-9]{7,}/[A-Za-z0-9/]{16,})"),
}
_EXACT = {k: re.compile(p.pattern, re.A | re.M) for k, p in MARKED.items()}

#: A quoted value: up to its closing quote, blanks and escapes included; where the line has none, up to a blank.
_QUOTED = (
    r"[brfu@]{0,2}(?P<q>[\"'`])(?:(?:bearer|basic|digest|token|apikey)[ ]+)?"
    r"(?P<v>(?=\S)(?:(?!(?P=q))[^\\\n]|\\[\s\S]){6,}+(?=(?P=q))|(?:(?!(?P=q))[^\s\\]){6,})"
)
#: An unquoted value up to the end of the line or a comment, in runs of one kind, so that a long line is read fast.
_BARE = (
    r"(?P<v>(?=(?:[^\s\"'`(){}\[\],;<>$|]|\$(?![{(A-Za-z_])){6})(?:[^\s\"'`(){}\[\],;<>$|#/]++|[#/]|\$(?![{(A-Za-z_]))+)[ \t]*(?:#[^\n]*|//[^\n]*)?$"
)
#: Expressions that find a value by what stands before it.
PLACED = {
    "url_user": _d(r"[a-z][a-z0-9+.\-]{1,15}://[^\s/:@\"'`]*+:(?P<v>[^\s/@\"'`]{4,})@"),
    "url_query": _d(r"[?&](?:key|api_?key|token|access_token|auth|secret|sig|signature|password)=(?P<v>[A-Za-z0-9_\-.%+/]{12,})"),
    "header": _d(r"(?:bearer|basic|token|apikey)[ ]+(?P<v>[A-Za-z0-9+/=_\-.~]{12,})(?=[\"'`\s]|$)"),
    "header_item": _d(
        r"[\"'](?:x-auth|x-api-key|x-auth-token|x-access-token|x-token|x-secret|api-key|apikey|authorization|private-token)[\"']\]?[ ]*[=:,][ ]*"
        + _QUOTED
    ),
    "curl_user": _d(r"curl\b[^\n|;]*?[ ](?:-u|--user)[ =]+[\"']?[A-Za-z0-9_.\-]+:(?P<v>[^\s\"'@]{6,})"),
    "client_flag": _d(r"(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;]*?[ ]-p(?P<v>[^\s\"'\-]\S{5,})"),
    "basic_call": _d(r"(?:basicauth|basic_auth|credentials?|login|getconnection|usernamepassword[a-z]*)[ ]?\([^()\n]*?,[ ]*" + _QUOTED),
    "connection": _d(r"(?:pwd|password)=(?P<v>(?=(?:[^;\s\"'$<{&]|\$(?![{(A-Za-z_])){6})(?:[^;\s\"'$<{&]++|\$(?![{(A-Za-z_]))++)[;\"']"),
    "sql": _d(r"(?:password|identified by)[ ]+" + _QUOTED),
    "prose": _d(r"(?:password|passwort|passphrase|mot de passe|contrase[ñÑ]a|senha|token|secret|api key)(?:[ ]+is|[ ]*:)?[ ]+[`\"']?(?P<v>[^\s`\"',;()]{8,})"),
    "compare": _d(r"[!=]=[ ]*(?P<q>[\"'])(?P<v>(?=\S)(?:(?!(?P=q))[^\\\n]|\\[\s\S]){8,}+)(?P=q)[^\n]{0,40}(?:#|//|--)[^\n]{0,60}(?:login|passw|admin|auth|secret)"),
    "named": _d(NAME + r"[a-z0-9_\-]{0,24}[\"'\]]{0,2}[ \t]*(?::[ ]*[a-z]{3,12}[ ]*)?(?:=>|<-|:=|={1,2}|:|,)[ \t]*\(?\s*" + _QUOTED),
    "named_bare": _d(NAME + r"[a-z0-9_\-]{0,24}[ \t]*(?:=|:)[ \t]*" + _BARE),
    "pw": _d(r"(?<![a-z0-9])pw(?:[\"'][ ]?[,:=]|[ ]?=|[ ]?:|[ ]?<-)=?[ \t]*" + _QUOTED),
    "pw_bare": _d(r"(?<![a-z0-9])pw(?:[ ]?=|[ ]?:)[ \t]*" + _BARE),
    "mail_key": _d(r"(?:smtp|datasource|ldap|imap)\.[a-z0-9_.\-]{1,40}[ ]*[=:][ ]*(?P<v>[^\s\"'`(){}\[\],;<>$|]{20,})[ \t]*$"),
    "pair": _d(r"auth[ ]?=[ ]?\([ ]?[\"'][^\"'\n]{1,60}[\"'],[ ]*" + _QUOTED),
    "key_name": _d(r"key[\"'\]]{0,2}[ \t]*(?::?=|:|<-)[ \t]*(?P<q>[\"'`])(?P<v>[A-Za-z0-9+/=_\-]{20,})(?P=q)"),
    # a literal of 32 random bytes needs no name
    "opaque": _d(r"(?:=|:|<-|\(|,)[ ]*(?P<q>[\"'])(?P<v>[A-Za-z0-9+/]{43}=)[\"'][;,)} \n]"),
    # two literals that the language joins to one value
    "joined": _d(
        r"(?P<q>[\"'])(?P<v>[A-Za-z0-9+/=_.\-]{4,}[\"'](?: \+ |\n )[ \t]*[\"'][A-Za-z0-9+/=_.\-]{4,})(?P=q)(?![ \t]*(?:\+|\n[ \t]*[\"']))"
    ),
    "aws_secret": _d(
        r"A(?:KIA|SIA)[A-Z0-9]{16}[^\n]{0,40}\n[^\n]{0,60}?[=:][ ]*[\"']?(?P<v>[A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])"
    ),
}
DETECTORS = MARKED | PLACED
QUERIES = {name: query_of(p) for name, p in DETECTORS.items()}
PREFIXES = {name: prefixes_of(p) for name, p in DETECTORS.items()}
_UNINDEXED = [name for name, q in QUERIES.items() if not q]
if _UNINDEXED:
    raise AssertionError(f"expressions without a required trigram: {_UNINDEXED}")

_LOOKUP = re.compile(r"(?i)\$\{|\$\(|\{\{|%\(|<[^>]*>|^\$|^%[a-z_]+%$|getenv|environ|process\.env|settings\.|config\.|secrets?[./]|/run/|vault:")
_MASK = re.compile(r"^(.)\1{3,}$|^[x*.\-_#]{4,}$", re.I)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_KEY_NAME = re.compile(r"(?i)(?:api[_\-]?key|access[_\-]?key|auth[_\-]?key|client[_\-]?key|secret|secret[_\-]?key|token|passw(?:or)?d|pwd)$")
# what may stand between the header of a key and its body: line ends, quotes, comment marks, and lines such as 'Version: 2'
_KEY_GAP = r"(?:\\n|\\r|[\s\"'+\\,|>#*/;.-])*+"
_KEY_BODY = re.compile(rf"{_KEY_GAP}(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):(?:[^\n\\]|\\(?![nr]))*+{_KEY_GAP})*+[A-Za-z0-9+/=:]{{16,}}")
_PATH = re.compile(r"^(?:/|\./|~/|[A-Za-z]:\\)[\w./\\-]*$")
_WORDY = re.compile(r"^[A-Za-z]+(?:[_\-. ][A-Za-z]+)*$")
_COMMENT = re.compile(r"^\s*(?:#|//|--|\*|;|%|<!--)")


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s))) if n else 0.0


def _has_random_part(value: str) -> bool:
    """Whether a part of a value is no word or count: letters and digits that alternate, and run in no order."""
    for part in re.split(r"[_\-. ]+", value):
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(part, part[1:]))
        if len(part) >= 8 and turns >= 3:
            kinds = ["".join(c for c in part if c.isdigit() == d) for d in (True, False)]
            if not all(x in run or len(set(x)) == 1 for x, run in zip(kinds, ("01234567890", "abcdefghijklmnopqrstuvwxyz"))):
                return True
    return False


def is_live(value: str) -> bool:
    """Whether a literal may be a credential rather than a stand-in, a lookup, a path or a plain word."""
    low = value.lower().strip("\"'` ")
    if len(low) < 6 or _LOOKUP.search(value) or _MASK.match(low) or _UUID.match(low) or _PATH.match(value):
        return False
    if any(low == s or low.startswith((s + "_", s + "-")) or low.endswith(("_" + s, "-" + s)) for s in STAND_INS) and not _has_random_part(low):
        return False
    if re.search(r"(?i)your|example|dummy|change.?me|replace|insert|placeholder|x{5,}", low) and not re.search(r"\d{3}", low):
        return False
    digits = any(c.isdigit() for c in value)
    letters = any(c.isalpha() for c in value)
    if not letters:
        return False
    if digits:
        return True
    mixed = value.lower() != value and value.upper() != value
    if mixed and re.search(r"[%#$!&*^~@]", value[1:]) and not re.search(r"%[sd]\b|\s", value):
        return True
    return len(value) >= 20 and mixed and not _WORDY.match(value) and entropy(value) >= 3.5


def is_live_quoted(value: str) -> bool:
    """``is_live`` for a whole literal, in which blanks and escapes may stand."""
    if not re.search(r"[\s\\]", value):
        return is_live(value)
    # what stands before the first escape of an expression (\\d, \\s, \\.) is judged alone
    if m := re.search(r"\\[^\"'`\\/nrt\nux]", value):
        value = value[: m.start()]
    value = re.sub(r"\\[nrt\n]", " ", value)
    value = re.sub(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|(.))", lambda m: m.group(1) or "~", value)
    words = value.split()
    if len(words) < 2:
        return bool(words) and is_live(words[0])
    if is_live(words[0]):
        return True
    if _LOOKUP.search(value):
        return False
    # a pass phrase, or a key written in groups
    mixed = [w for w in words if any(c.isdigit() for c in w) and any(c.isalpha() for c in w)]
    return any(is_live(w) and not re.search(r"[{}()<>\[\]]|://", w) for w in words[1:]) or 2 * len(mixed) >= len(words) and is_live("".join(words))


def _full_name(text: str, start: int) -> str:
    i = start
    while i and (text[i - 1].isalnum() or text[i - 1] in "_-.") and start - i < 60:
        i -= 1
    return text[i:start]


def _line(text: str, at: int) -> str:
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    return text[a : b if b >= 0 else len(text)]


def _accept(detector: str, m: re.Match, text: str, file: str) -> bool:
    value = m.group("v")
    if detector in MARKED:
        if detector == "private_key":
            # a key has a body; a mention of the header alone hasn't
            return bool(_KEY_BODY.match(text, m.end())) or "ENCRYPTED" in value
        return bool(_EXACT[detector].match(text, m.start())) and not re.search(r"(?i)x{6,}|example", value)
    if detector in ("named", "named_bare", "pw_bare"):
        end = m.start("v") - m.start()
        name = re.match(r"[A-Za-z0-9_\-]*", m.group()).group() if end else ""
        if NOT_A_VALUE.search(name):
            return False
        before = _full_name(text, m.start())
        # 'pass', 'pw', 'auth' and the like must begin a part of the name
        if before and before[-1].isalnum() and not m.group()[0].isupper():
            return False
        if re.match(r"(?i)(?:pass|auth|token)[a-z]", name) and not re.match(r"(?i)(?:passw|passphrase|passwort|auth_?token|auth_?key|tokens?$)", name):
            if not re.match(r"[a-z]+[A-Z]|[A-Z]+_", name) and not re.match(r"(?i)(?:pass|auth|token)(?:s|key|value|word|code|phrase)?$", name):
                return False
        if detector != "named":
            suffix = PurePosixPath(file).suffix.lower()
            base = PurePosixPath(file).name.lower()
            plain = suffix in CONFIG_SUFFIXES or base.startswith(".env") or not file
            line = _line(text, m.start())
            if not plain and not _COMMENT.match(line):
                return False
            if re.match(r"^[A-Za-z_][\w.]*[(\[]", value):
                return False
            if "://" in value:
                return False  # a URL is judged by its own expressions
    if detector == "prose" and not (any(c.isdigit() for c in value) and len(value) >= 10 or re.search(r"[%#$!&*^~@]", value)):
        return False
    if detector == "key_name":
        before = _full_name(text, m.start())
        return is_live(value) and entropy(value) >= 3 and bool(before) and (m.group()[0] == "K" and before[-1].islower() or before[-1] in "_-." )
    if detector == "mail_key":
        return is_live(value) and entropy(value) >= 4 and "://" not in value
    if detector == "opaque":
        before = text[max(0, m.start() - 40) : m.start()]
        return not re.search(r"(?i)(?:sha|hash|digest|checksum|integrity|sum|public)\w*[\"'\]]*\s*$", before) and is_live(value)
    if detector == "joined":
        before = text[: m.start()].rstrip()[-60:]
        if before.endswith(("+", '"', "'", "\\", ",")):
            return False
        value = re.sub(r"[\"'](?: \+ |\n\s+)[\"']", "", value)
        if any(p.fullmatch(value) for p in _EXACT.values()) or re.fullmatch(r"[A-Za-z0-9+/]{43}=", value):
            return True
        return bool(re.search(r"(?i)" + NAME + r"[\w\-]*[\"'\]]*\s*(?:=|:|<-|:=)\s*\(?\s*$", before)) and is_live(value)
    if detector == "prose" and re.match(r"^[\w.]+\.(?:py|js|md|txt)$|^[a-z]+(?:_[a-z0-9]+)+$", value):
        return False
    if detector == "url_user" and value.lower() in ("password", "pass", "pwd", "secret", "user", "token"):
        return False
    if detector == "header" and not any(c.isdigit() for c in value):
        return False
    if detector == "named" and re.search(r"(?i)sha\d*[-:]|^(?:sha|md5)", value):
        return False
    if detector in ("named", "named_bare", "header_item") and _UUID.match(value.strip("\"'` ")):
        # ids of runs and records are written so too: the name must say that it is a key
        return bool(_KEY_NAME.search(re.match(r"[\"']?[A-Za-z0-9_\-]*", m.group()).group()))
    return is_live_quoted(value) if "q" in m.re.groupindex else is_live(value)


def find(text: str, file: str, detectors: Iterable[str]) -> list[tuple[int, int, str]]:
    """(start, end, detector) of the credential values in a text, in order and without overlaps."""
    spans: list[tuple[int, int, str]] = []
    low, known = text.lower(), {}
    for name in detectors:
        for m in matches(DETECTORS[name], PREFIXES[name], text, low, known):
            if _accept(name, m, text, file):
                a, b = m.span("v")
                if name == "private_key":
                    b = _key_end(text, b)
                spans.append((a, b, name))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if out and s[0] < out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2])
            continue
        out.append(s)
    return out


def _key_end(text: str, at: int) -> int:
    end, other = text.find("-----END", at), text.find("-----BEGIN", at)
    if 0 <= end and not 0 <= other < end:
        close = text.find("-----", end + 8)
        return close + 5 if close >= 0 else len(text)
    # no end line: the lines of base64 that follow
    m = re.compile(r"(?:(?:\\n|\\r|[ \t]*\n[ \t]*)+[A-Za-z0-9+/=]{16,})*").match(text, at)
    return m.end()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each value replaced by a mark of its detector; line breaks inside a value stay."""
    out, at = [], 0
    for a, b, name in spans:
        out.append(text[at:a])
        # kept: line breaks and what joins the parts of a value that spans lines, so that the code still parses
        parts = re.split(r"([\"'](?: \+ |\n)[ \t]*[\"']|\\?\n[ \t]*(?:[#/*]+[ \t]*)?)", text[a:b])
        out.append("".join(p if i % 2 else (f"REDACTED_{name.upper()}" if i == 0 else "REDACTED" if p else "") for i, p in enumerate(parts)))
        at = b
    return "".join(out) + text[at:]


_index: Index | None = None


def _get_index() -> Index:
    global _index
    if _index is None:
        _index = Index(QUERIES)
    return _index


def _scan(rows: list[tuple]):
    """(project id, chunk id, text, file, spans) of the chunks with credentials."""
    where, texts = [], []
    for pid, chunks_json in rows:
        for c in chunks_of(chunks_json):
            text = text_of(c.get("text"))
            if text and isinstance(c.get("id"), str):
                where.append((pid, c["id"], text_of(c.get("file"))))
                # expressions that ask for what follows a value also find it at the end
                texts.append(text + "\n")
    wanted: dict[int, list[str]] = {}
    for name, at in _get_index().candidates(texts).items():
        for i in at.tolist():
            wanted.setdefault(i, []).append(name)
    for i in sorted(wanted):
        pid, cid, file = where[i]
        spans = find(texts[i], file, wanted[i])
        if spans:
            yield pid, cid, file, texts[i][:-1], spans


def _found_rows(rows: list[tuple]) -> list[list]:
    out: dict[tuple, None] = {}
    for pid, cid, _, text, spans in _scan(rows):
        for a, _, name in spans:
            out.setdefault((pid, cid, text.count("\n", 0, a) + 1, name))
    return [list(x) for x in zip(*out)] if out else []


def _redacted_rows(rows: list[tuple]) -> list[list]:
    out = dict.fromkeys((pid, cid, file, len(spans), redact(text, spans)) for pid, cid, file, text, spans in _scan(rows))
    return [list(x) for x in zip(*out)] if out else []


def _input(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").cast("bigint").alias("id"), F.col("chunks_json").cast("string").alias("chunks_json")).where("chunks_json is not null")


def find_credentials(projects: DataFrame) -> DataFrame:
    """(project_id, chunk_id, line_no, detector) of each line on which a literal credential starts."""
    return map_blocks(_input(projects), _found_rows, "project_id bigint, chunk_id string, line_no bigint, detector string")


def redact_credentials(projects: DataFrame) -> DataFrame:
    """(project_id, chunk_id, file, n_values, text) of the chunks that held credentials, with the values redacted."""
    return once_per_key(_input(projects), "id", lambda df: map_blocks(df, _redacted_rows, "project_id bigint, chunk_id string, file string, n_values int, text string"))
