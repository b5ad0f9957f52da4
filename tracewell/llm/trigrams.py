"""Boolean trigram queries that every match of a regular expression fulfils.

A query is True (no demand), a trigram, or ("and" | "or", parts). It holds for a text if its trigrams are those of the
text, letters folded to small ones, so a text for which it does not hold has no match. Runs of the pattern
that stand for few exact strings give their trigrams; anything else ends a run and gives what it demands itself.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: A run of a pattern stands for so many strings at most.
STRINGS = 64


def _parts(found: object) -> list:
    return list(found[1]) if isinstance(found, tuple) and found[0] == "and" else [found]


def both(parts: list) -> object:
    kept = list(dict.fromkeys(q for p in parts if p is not True for q in _parts(p)))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def any_of(parts: list) -> object:
    """One of several; a part that demands more than another adds nothing."""
    if True in parts:
        return True
    parts = list(dict.fromkeys(parts))
    sets = [set(_parts(p)) for p in parts]
    kept = [p for p, s in zip(parts, sets, strict=True) if not any(t < s for t in sets)]
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def of_string(text: str) -> object:
    return both([text[i : i + 3] for i in range(len(text) - 2)])


def _of_strings(strings: set[str]) -> object:
    return any_of([of_string(s) for s in sorted(strings)])


def _chars(items: list) -> set[str] | None:
    """The folded characters of a class, or none if there are too many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _joined(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= STRINGS else None


def _exact(kind, value) -> set[str] | None:
    """All strings that a part of a pattern stands for, if they are few."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found = _chars(value)
        return found if found and len(found) <= 8 else None
    if kind is op.SUBPATTERN:
        return _exact_all(value[3])
    if kind is op.BRANCH:
        found = [_exact_all(b) for b in value[1]]
        return set().union(*found) if all(f is not None for f in found) and sum(map(len, found)) <= STRINGS else None
    if kind is op.MAX_REPEAT and value[1] is not parser.MAXREPEAT and value[1] <= 4:
        one, out, power = _exact_all(value[2]), set(), {""}
        for n in range(value[1] + 1):
            if power is None or one is None:
                return None
            out |= power if n >= value[0] else set()
            power = _joined(power, one)
        return out if len(out) <= STRINGS else None
    return None


def _exact_all(parts) -> set[str] | None:
    out: set[str] | None = {""}
    for kind, value in parts:
        found = _exact(kind, value)
        out = None if found is None or out is None else _joined(out, found)
    return out


def _demand(kind, value) -> object:
    """What a part that stands for too many strings demands."""
    if kind is op.SUBPATTERN:
        return _query(value[3])
    if kind is op.BRANCH:
        return any_of([_query(b) for b in value[1]])
    if kind is op.MAX_REPEAT and value[0] > 0:
        return _query(value[2])
    return True


def _query(parts) -> object:
    found, run = [], {""}
    for kind, value in parts:
        strings = _exact(kind, value)
        more = None if strings is None else _joined(run, strings)
        if more is not None:
            run = more
            continue
        found.append(_of_strings(run))
        run = strings if strings is not None else {""}
        if strings is None:
            found.append(_demand(kind, value))
    return both([*found, _of_strings(run)])


def query(pattern: str) -> object:
    return _query(parser.parse(pattern))


def grams(found: object) -> set[str]:
    """All trigrams a query names."""
    if found is True:
        return set()
    return {found} if isinstance(found, str) else set().union(*map(grams, found[1]))
