"""Order-insensitive comparison of a Spark result with an oracle result (tests only)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

Table = tuple[list[str], list[tuple]]


def _cell(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    return value if value is None or isinstance(value, bool) else str(value)


def _table(names: list[str], rows) -> Table:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_cell(row[i]) for i in order) for row in rows]


def spark_rows(df: DataFrame) -> Table:
    return _table(df.columns, df.collect())


def oracle_rows(con, sql: str) -> Table:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return _table(names, cursor.fetchall())


def difference(mine: Table, theirs: Table) -> str | None:
    """None when equal, else a short text about the first differences."""
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    left, right = Counter(mine[1]), Counter(theirs[1])
    if left == right:
        return None
    extra, lacking = list((left - right).elements()), list((right - left).elements())
    return f"rows {len(mine[1])} against {len(theirs[1])}; only here {extra[:3]}; only in oracle {lacking[:3]}"
