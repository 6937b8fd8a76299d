"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, the characters a trim removes (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A search token: a run of letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+"

DEFAULT_TENANT = "default"
ERROR_LEVELS = ["ERROR", "FATAL"]

# Metric key formats (fixed values).
METRIC_KEYS = {
    "logs_total": "stats:logs:total",
    "logs_service": "stats:logs:{dim}",
    "logs_level": "stats:logs:level:{dim}",
    "leaderboard_services": "leaderboard:services",
    "leaderboard_errors": "leaderboard:errors",
    "errors_service": "stats:errors:{dim}",
    "errors_last_5m": "stats:errors:last_5m:{dim}",
    "recent_errors": "recent:errors:{dim}",
    "unique_ips": "unique:ips:{dim}",
}


def ws_trim(col: Column) -> Column:
    """Trim all Unicode white space (``trim`` alone removes blanks only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def tenant_or_default(col: Column) -> Column:
    return F.coalesce(empty_to_null(ws_trim(col)), F.lit(DEFAULT_TENANT))


def is_error(level: Column) -> Column:
    """Errors are the two upper-case levels, exactly as written."""
    return level.isin(ERROR_LEVELS)


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The distinct lower-case tokens of a search text."""
    found = re.findall(r"[^\W]+", query.lower(), flags=re.UNICODE)
    return sorted(set(found))


def contains_any_token(col: Column, terms: list[str]) -> Column:
    """True when one of ``terms`` stands as a whole token in ``col``.

    One regex scan that stops at the first hit, so no token array is built.
    """
    inside = r"[\p{L}\p{N}_]"
    alternatives = "|".join(rf"\Q{t}\E" for t in terms)
    return F.lower(col).rlike(f"(?<!{inside})(?:{alternatives})(?!{inside})")


def preview(message: Column, limit: int = 60, keep: int = 57) -> Column:
    """Texts over ``limit`` bytes become ``keep`` bytes and ``...``.

    The cut never splits a character: an incomplete one at the end is dropped.
    """
    raw = message.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(keep, keep - 4, -1)]
    return F.when(F.octet_length(message) > limit, F.concat(F.coalesce(*cuts), F.lit("..."))).otherwise(message)


def human_bytes(n: Column) -> Column:
    """1536 -> ``1.5 KB``: steps of 1024, one decimal, ties to even."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB", "PB", "EB"], start=1):
        step = 1024**power
        scaled = F.bround(n.cast("double") / F.lit(float(step)), 1)
        out = F.when(n >= F.lit(step).cast("long"), F.format_string(f"%.1f {unit}", scaled)).otherwise(out)
    return out


def metric_key(tenant: Column, metric: Column, dim: Column) -> Column:
    """The flat key of a counter; tenants other than the default get a prefix."""
    body = F.lit(None).cast("string")
    for name, pattern in METRIC_KEYS.items():
        head = pattern.removesuffix("{dim}")
        value = F.concat(F.lit(head), F.lower(dim) if name == "logs_level" else dim)
        body = F.when(metric == name, value if "{dim}" in pattern else F.lit(head)).otherwise(body)
    owner = F.coalesce(empty_to_null(ws_trim(tenant)), F.lit(DEFAULT_TENANT))
    prefix = F.when(owner == DEFAULT_TENANT, F.lit("")).otherwise(F.concat(F.lit("tenant:"), tenant, F.lit(":")))
    return F.concat(prefix, body)


def split_list(text: str | None) -> list[str]:
    """``a, b,,c`` -> ``[a, b, c]`` (a request argument, not data)."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]
