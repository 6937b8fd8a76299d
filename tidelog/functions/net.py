"""IP address check as one regular expression."""

from __future__ import annotations

from pyspark.sql import Column

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"


def _v6_forms() -> list[str]:
    """All IPv6 spellings: full, with ``::`` after n groups, and with a v4 tail."""
    forms = [rf"{_H}(?::{_H}){{7}}", rf"(?:{_H}:){{6}}{_V4}"]
    for left in range(8):
        head = "::" if left == 0 else rf"{_H}(?::{_H}){{{left - 1}}}::"
        room = 7 - left  # "::" stands for at least one group
        tail = rf"(?:{_H}(?::{_H}){{0,{room - 1}}})?" if room else ""
        forms.append(head + tail)
        if left <= 5:
            forms.append(rf"{head}(?:{_H}:){{0,{5 - left}}}{_V4}")
    return forms


IP_PATTERN = r"\A(?:" + "|".join([_V4, *_v6_forms()]) + r")\z"


def valid_ip(col: Column) -> Column:
    return col.rlike(IP_PATTERN)
