"""Boolean trigram queries that every match of a regular expression must meet.

A query is ``None`` (no trigram is certain: everything has to be scanned), a string (one trigram),
or a tuple ("and" | "or", query, ...). It is derived bottom-up from the parsed expression: a part
that can only match a few strings is kept as that set, so neighbouring parts join into longer
strings; where a set would grow past ``LARGEST`` or a part is open, the trigrams of the strings
known so far are required and the joining starts again with their ends. Letters are folded to
lower case (ASCII), as in the index, so a query holds for any case.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

LARGEST = 64


def _folded(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _all(*queries):
    parts = [q for q in queries if q is not None]
    if not parts:
        return None
    flat = sorted({x for q in parts for x in (q[1:] if isinstance(q, tuple) and q[0] == "and" else [q])}, key=repr)
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _any(queries):
    queries = list(queries)
    if not queries or any(q is None for q in queries):
        return None
    flat = {x for q in queries for x in (q[1:] if isinstance(q, tuple) and q[0] == "or" else [q])}
    # a query that asks for more than another one adds nothing
    least = sorted((q for q in flat if not any(_parts(p) < _parts(q) for p in flat)), key=repr)
    return least[0] if len(least) == 1 else ("or", *least)


def _parts(query) -> set:
    return set(query[1:]) if isinstance(query, tuple) and query[0] == "and" else {query}


def _of_strings(strings: set[str]):
    """Query met by every text that holds one of ``strings``; only ASCII trigrams, whose folding is certain."""
    return _any(_all(*(t for i in range(len(s) - 2) if (t := s[i:i + 3]).isascii())) for s in strings)


def _class(items) -> set[str] | None:
    """The single characters that a character class matches, folded; None if they are too many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(_folded(arg))
        elif op is C.RANGE and arg[1] - arg[0] < LARGEST:
            out |= {_folded(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= LARGEST // 4 else None


def _sequence(parsed) -> tuple[set[str] | None, object]:
    """(all strings it can match or None, query)."""
    known, open_before, required = {""}, False, None
    for op, arg in parsed:
        strings, query = _part(op, arg)
        if strings is not None:
            joined = {a + b for a in known for b in strings}
            if len(joined) <= LARGEST:
                known = joined
                continue
            # too many: what is known so far is required, and only its last two characters join on
            required = _all(required, _of_strings(known))
            known, open_before = {s[-2:] for s in known}, True
            joined = {a + b for a in known for b in strings}
            known = joined if len(joined) <= LARGEST else strings
            continue
        required = _all(required, _of_strings(known), query)
        known, open_before = {""}, True
    if not open_before:
        return known, _of_strings(known)
    return None, _all(required, _of_strings(known))


def _part(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {_folded(arg)}, None
    if op is C.IN:
        return _class(arg), None
    if op is C.AT:
        return {""}, None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return (strings if strings is not None and len(strings) <= LARGEST else None), _any(q for _, q in parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most <= 1:
            return strings | {""} if least == 0 else strings, query if least else None
        if strings is not None and least == most and len(strings) ** least <= LARGEST:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, _of_strings(out)
        return None, query if least else None
    return None, None  # anything else (any character, look-around, back-reference) is open


def trigram_query(pattern: str):
    """The query of ``pattern``, in the syntax that Python and Java share."""
    return _sequence(_parser.parse(pattern))[1]


def trigrams_in(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_in(q) for q in query[1:]))


def holds(query, present) -> bool:
    """Whether a text whose folded trigrams are ``present`` meets ``query``."""
    if query is None:
        return True
    if isinstance(query, str):
        return query in present
    return (all if query[0] == "and" else any)(holds(q, present) for q in query[1:])
