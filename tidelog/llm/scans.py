"""Running sums over the matches of a text, as SQL expressions inside its row."""

from __future__ import annotations

#: Matches folded together; an array that grows by one element at a time is copied each time.
CHUNK = 256


def _let(value: str, name: str, then: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def placed(pieces: str, gap: str, hit: str, fields: str, kind: str) -> str:
    """An array of one struct per match, each knowing where it stands.

    ``pieces`` is an array of structs with fields 0 and 1, a gap and the match behind it (null behind the last gap).
    ``gap`` and ``hit`` are the lengths of those of ``p``; ``fields`` the struct's fields, in which ``acc.at`` is the place
    where ``p`` begins; ``kind`` its type.  The time is about linear in the number of matches.
    """
    chunk = f"slice(ps, k * {CHUNK} + 1, {CHUNK})"
    every = f"sequence(0, (size(ps) - 1) div {CHUNK})"
    sums = f"transform({every}, k -> aggregate({chunk}, 0L, (t, p) -> t + {gap} + if(p.`1` is null, 0, {hit})))"
    fold = f"""aggregate({chunk}, named_struct('at', aggregate(slice(sums, 1, k), 0L, (t, x) -> t + x), 'found', cast(array() as array<{kind}>)),
        (acc, p) -> if(p.`1` is null, acc, named_struct('at', acc.at + {gap} + {hit}, 'found', concat(acc.found, array(cast({fields} as {kind}))))),
        acc -> acc.found)"""
    return _let(pieces, "ps", _let(sums, "sums", f"flatten(transform({every}, k -> {fold}))"))
