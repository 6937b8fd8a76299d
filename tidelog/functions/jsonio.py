"""Strict decoding of the fixed JSON event, and encoding with blanks left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import empty_to_null
from tidelog.schemas import EVENT_FIELDS

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BAD = "unreadable_record"
_WITH_BAD = {**_STRICT, "columnNameOfCorruptRecord": _BAD}
_TEXTS = ", ".join(f"{name} string" for name in EVENT_FIELDS)
_VARIANTS = ", ".join(f"{name} variant" for name in EVENT_FIELDS)

# A name with a capital in it; unescaped and before a colon, so no part of a text.
_CAPITAL_NAME = r'"[A-Za-z_]*[A-Z][A-Za-z_]*"\s*:'
# A name followed by anything but a text.
_NOT_A_TEXT = r'"\s*:\s*[^"\s]'


def _elements(text: Column, fields: str) -> Column:
    """``text`` as the only element of an array, which refuses anything behind it."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{fields}>>", _STRICT)


def _absent_but_named(event: Column, text: Column) -> Column:
    """Some known field was not found although its name occurs, in whatever case.

    Also when any name has capitals: of names that differ in case only the last counts.
    """
    folded = F.lower(text)
    found = F.lit(False)
    for name in EVENT_FIELDS:
        found = found | (event[name].isNull() & folded.contains(f'"{name}"'))
    return found | text.rlike(_CAPITAL_NAME)


def _lower_keys(text: Column) -> Column:
    """``text`` with the names of known fields in lower case.

    An unescaped quoted name before a colon cannot be part of a JSON string.
    """
    for name in EVENT_FIELDS:
        text = F.regexp_replace(text, rf'"(?i:{name})"(\s*):', rf'"{name}"$1:')
    return text


def _wrong_type(typed: Column) -> Column:
    """Any known field holds something other than a text or null."""
    bad = F.lit(False)
    for name in EVENT_FIELDS:
        kind = F.schema_of_variant(typed[name])
        bad = bad | F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))
    return bad


# The decoders work in steps that are separate projections, and the last one
# unnests an array, so that Spark runs them once per row however often a field is
# used later.  The usual text is read once, as strings; it is read again only when
#   * a known name occurs but its field is missing (names match in any case), or
#   * some value is not a text (strings would swallow numbers and objects), or
#   * a "}" followed by "]" could have closed the array around it.


def decode_whole(df: DataFrame, value: str) -> DataFrame:
    """Add ``_at``, ``_event`` and ``_wrong`` for the one object that ``value`` is.

    ``_at`` is NULL for a text that is not exactly one object (or ``null``);
    ``_wrong`` tells that a known field is not a text.
    """
    names = df.columns
    first = F.get("_array", F.lit(0))
    steps = df.select(*names, F.col(value).alias("_text"), _elements(F.col(value), _TEXTS).alias("_array"))
    steps = steps.withColumn(
        "_text", F.when((F.size("_array") == 1) & _absent_but_named(first, F.col("_text")), _lower_keys(F.col("_text"))).otherwise(F.col("_text"))
    )
    renamed = F.col("_text") != F.col(value)
    steps = steps.withColumn("_array", F.when(renamed, _elements(F.col("_text"), _TEXTS)).otherwise(F.col("_array")))
    steps = steps.withColumn("_typed", F.when(F.col("_text").rlike(_NOT_A_TEXT), _elements(F.col("_text"), _VARIANTS)))
    inside_object = F.from_json(F.concat(F.lit('{"body":'), F.col("_text"), F.lit("}")), f"body string, {_BAD} string", _WITH_BAD)
    closes_array = F.col("_text").contains("]") & F.col("_text").rlike(r"\}\s*\]")
    whole = (F.size("_array") == 1) & (~closes_array | inside_object[_BAD].isNull())
    return steps.select(
        *names,
        _wrong_type(F.get("_typed", F.lit(0))).alias("_wrong"),
        F.posexplode_outer(F.when(whole, F.col("_array"))).alias("_at", "_event"),
    )


def decode_first(df: DataFrame, value: str) -> DataFrame:
    """Add ``_event`` and ``_wrong`` for the first JSON object of ``value``.

    Whatever follows it is ignored; ``unreadable_record`` of ``_event`` is set when
    there is no readable object at the start.
    """
    names = df.columns

    def read(text: Column) -> Column:
        return F.from_json(text, f"{_TEXTS}, {_BAD} string", _WITH_BAD)

    steps = df.select(*names, F.col(value).alias("_text"), read(F.col(value)).alias("_event"))
    steps = steps.withColumn(
        "_text", F.when(_absent_but_named(F.col("_event"), F.col("_text")), _lower_keys(F.col("_text"))).otherwise(F.col("_text"))
    )
    renamed = F.col("_text") != F.col(value)
    steps = steps.withColumn("_event", F.when(renamed, read(F.col("_text"))).otherwise(F.col("_event")))
    typed = F.from_json(F.col("_text"), _VARIANTS, _STRICT)
    steps = steps.withColumn("_typed", F.when(F.col("_text").rlike(_NOT_A_TEXT), typed))
    return steps.select(
        *names, _wrong_type(F.col("_typed")).alias("_wrong"), F.explode(F.array(F.col("_event"))).alias("_event")
    )


def is_unreadable(decoded: Column) -> Column:
    return decoded.isNull() | decoded[_BAD].isNotNull()


def encode(*cols: Column | str) -> Column:
    """JSON object of the given columns; NULL and empty ones are left out."""
    return F.to_json(F.struct(*cols))


def blank_out(name: str) -> Column:
    """A column that ``encode`` leaves out when it is empty."""
    return empty_to_null(F.col(name)).alias(name)
