"""Tolerant decoding of JSON text that producers may have encoded more than once."""

import json
import re

_NUMBER = re.compile(r"\s*[A-Za-z_#]{0,3}[\s:#_-]*(\d{1,19})(?:\.0*)?\s*", re.A)


class Unreadable(ValueError):
    """The text is not JSON (cut off, blank or not JSON at all)."""


def decode(text):
    """The value of a JSON text; a string result that is JSON again is decoded again.

    None for None; Unreadable for a text that isn't JSON at any level.
    """
    value = text
    # each decoding of a text takes its quotes away, so there is a last one
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError) as e:
            raise Unreadable from e
    return value


def plain_number(value) -> int | None:
    """The number of an id however it was written: 12, 12.0, '12', ' 12', '12.0', 'q12', 'c12', 'C12'; else None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return value if 0 <= value < 1 << 63 else None
    if isinstance(value, float):
        return int(value) if value == value and 0 <= value < 1 << 53 and value.is_integer() else None
    if isinstance(value, str):
        m = _NUMBER.fullmatch(value)
        if m:
            n = int(m.group(1))
            return n if n < 1 << 63 else None
    return None
