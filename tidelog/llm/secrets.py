"""Secrets in texts: fixed formats, and random strings told apart by Markov models.

The fixed kinds are regular expressions.  Besides them every long run of key
characters is scored by two first-order character models, one of random strings
and one of ordinary identifiers: the mean log-likelihood ratio of its
transitions.  Both models are counted over the whole table from labelled samples:
values of the fixed kinds and one encoded digest per row are random, words of
letters are ordinary.

Everything is Spark expressions.  Spans are computed inside their row, so neither
the scan nor the redaction shuffles; only the transition counts, at most one per
pair of alphabet characters, leave the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import scans

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kind, pattern, group whose length counts, least length.  Fixed values.
KINDS = [
    (
        "assign",
        "(" + "|".join(map(_any_case, ["password", "passwd", "secret", "token"])) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    ("access", "(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", "([0-9a-f]+)", 1, 32),
]
MARKOV = "markov"
NAMES = [k[0] for k in KINDS] + [MARKOV]
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ORDINARY = "[A-Za-z]{8,}"
MIN_RATIO = 0.1
#: Different characters a candidate has to have; a repeated pattern is no key.
MIN_DISTINCT = 8
MASK = "[secret]"
_ONE = "struct<start:int,kind:int,end:int,value:string>"
_SPAN = f"array<{_ONE}>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, kind: int) -> str:
    """Leftmost non-overlapping matches with code-point offsets: lengths of gaps and matches in turn."""
    p = _sql(pattern)
    pieces = f"arrays_zip(transform(split({text}, {p}, -1), x -> length(x)), regexp_extract_all({text}, {p}, 0))"
    span = f"named_struct('start', acc.at + p.`0`, 'kind', {kind}, 'end', acc.at + p.`0` + length(p.`1`), 'value', p.`1`)"
    return f"case when {text} rlike {p} then {scans.placed(pieces, 'p.`0`', 'length(p.`1`)', span, _ONE)} else cast(array() as {_SPAN}) end"


def _found_by(kind: int) -> str:
    """The pattern that finds a kind; one of a single class of characters asks for the least length itself, and misses nothing by it."""
    _, pattern, group, least = KINDS[kind]
    return pattern if group == 2 else pattern.replace("+)", f"{{{least - 4 if kind == 1 else least},}})")


def base_spans(text: str = "text") -> Column:
    """All spans of the fixed kinds, by start, then kind."""
    parts = []
    for kind, (_, pattern, group, least) in enumerate(KINDS):
        found = _found_by(kind)
        value = f"length(regexp_extract(s.value, {_sql(pattern)}, {group}))"
        parts.append(f"filter({_matches(text, found, kind)}, s -> {value} >= {least})")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _pieces(word: str) -> str:
    """A word of two characters or more in pieces of at most 64 that share their ends: offsets in a long one are slow."""
    return f"transform(sequence(0, (length({word}) - 2) div 63), k -> substring({word}, 63 * k + 1, 64))"


def transition_counts(docs: DataFrame) -> DataFrame:
    """``(pair, random, ordinary)``: transitions between neighbouring characters in both samples."""
    text = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.select(
        F.expr(f"concat(regexp_extract_all(text, {_sql(ORDINARY)}, 0))").alias("ordinary"),
        F.concat(F.transform(base_spans(), lambda s: s["value"]), F.array(F.base64(F.unhex(F.sha2(F.coalesce("id", F.lit("")), 256))))).alias("random"),
    )
    samples = rows.select(F.explode("ordinary").alias("w"), F.lit(0).alias("r"))
    samples = samples.unionAll(rows.select(F.explode("random").alias("w"), F.lit(1).alias("r")))
    pieces = samples.where("length(w) > 1").select("r", F.explode(F.expr(_pieces("w"))).alias("w"))
    pairs = pieces.select("r", "w", F.explode(F.expr("sequence(1, length(w) - 1)")).alias("i"))
    pairs = pairs.select("r", F.expr("substring(w, i, 2)").alias("pair"))
    return pairs.groupBy("pair").agg(F.count_if(F.col("r") == 1).alias("random"), F.count_if(F.col("r") == 0).alias("ordinary"))


def train(docs: DataFrame) -> list[int]:
    """Thousandths of the log-likelihood ratio of each transition, by 128 * first + second code.

    Counts are smoothed by one.  What is collected is bounded by the square of
    the alphabet, 4,489 rows, whatever the size of the table.
    """
    rows = [r for r in transition_counts(docs).collect() if all(c in ALPHABET for c in r.pair)]
    totals: dict[str, list[int]] = {c: [0, 0] for c in ALPHABET}
    counts = {r.pair: (r.random, r.ordinary) for r in rows}
    for pair, (random, ordinary) in counts.items():
        totals[pair[0]][0] += random
        totals[pair[0]][1] += ordinary
    out = [0] * (128 * 128)
    size = len(ALPHABET)
    for a in ALPHABET:
        for b in ALPHABET:
            random, ordinary = counts.get(a + b, (0, 0))
            ratio = math.log((random + 1) / (totals[a][0] + size)) - math.log((ordinary + 1) / (totals[a][1] + size))
            out[128 * ord(a) + ord(b)] = math.floor(1000 * ratio + 0.5)
    return out


def find_secrets(docs: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``(start, kind, end, value)`` by start and kind.

    Offsets are code points, the end exclusive; ``kind`` indexes ``NAMES``.  A
    candidate is a run of 16 or more key characters, ``MIN_DISTINCT`` different
    ones and a letter among them, outside all base spans; it counts when its mean log-likelihood ratio is at least
    ``min_ratio``.  A null text counts as empty.  Rows are never joined, so null
    or repeated ids do no harm; columns named like the added ones are replaced.
    """
    model = ",".join(map(str, train(docs)))
    df = docs.drop("base", "spans", "_text", "_found", "_assigned", "_llr")
    df = df.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("base", base_spans("_text")).withColumn("_found", F.expr(_matches("_text", CANDIDATE, len(KINDS))))
    df = df.withColumn("_assigned", F.expr(f"filter(base, b -> {' or '.join(f'b.kind = {k}' for k in range(len(KINDS)) if KINDS[k][2] != 1)})"))
    df = df.withColumn("_llr", F.split(F.lit(model), ",").cast("array<int>"))
    score = f"""aggregate({_pieces("s.value")}, 0L, (total, w) -> total + aggregate(sequence(1, length(w) - 1), 0L, (t, i) ->
        t + _llr[128 * ascii(substring(w, i, 1)) + ascii(substring(w, i + 1, 1))]))"""
    # Candidates are whole runs, and base spans of one class of characters lie within one, so the run itself tells whether it holds one.
    within = " and ".join(f"not s.value rlike {_sql(_found_by(kind))}" for kind in range(len(KINDS)) if KINDS[kind][2] == 1)
    added = f"""filter(_found, s -> s.value rlike '[A-Za-z]' and size(array_distinct(split(s.value, ''))) >= {MIN_DISTINCT}
        and {within} and not exists(_assigned, b -> b.start < s.end and s.start < b.end)
        and {score} >= {round(1000 * min_ratio)} * (length(s.value) - 1))"""
    return df.withColumn("spans", F.expr(f"array_sort(concat(base, {added}))")).drop("_text", "_found", "_assigned", "_llr")


def span_text(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")


def redact(docs: DataFrame, mask: str = MASK, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with every secret replaced by ``mask`` in ``text``; ``n_chars``, if there, follows.

    Overlapping spans are masked once.  Rows without secrets stay as they are.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    found = find_secrets(whole, min_ratio)
    parts = f"""aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, s) ->
        if(s.start < acc.at, named_struct('at', greatest(acc.at, s.end), 'out', acc.out),
           named_struct('at', s.end, 'out', concat(acc.out, array(substring(text, acc.at + 1, s.start - acc.at), '{mask}')))),
        acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"""
    masked = found.withColumn("text", F.expr(f"case when size(spans) > 0 then {parts} else text end"))
    n_chars = F.expr("case when size(spans) > 0 then cast(length(text) as bigint) else row.n_chars end") if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": n_chars}
    return masked.select([new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
