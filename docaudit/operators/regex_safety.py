"""Whether a team's pattern can take a backtracking matcher very long: an ambiguity test on the pattern's automaton.

A pattern becomes positions (its single-character parts) and which may follow which. If two different ways lead from a
position back to itself over one text, the ways double with each turn. If a text leads around one position, around a
second and from the first to the second, each place of it may be where the first gives over to the second; three such
positions in a row make a cubic number of ways.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

#: Longer patterns, and ones with more single-character parts, are not run.
MOST_CHARACTERS, MOST_POSITIONS = 500, 400
#: A bounded repeat of more turns counts as unbounded.
MOST_TURNS = 4
#: Characters of every kind that a class may hold, beside those that the pattern names.
SAMPLES = {*map(ord, "aZ09_ \n\t-.,é中あ")}


class _Positions:
    """Sets of characters of each position, and which positions may follow it."""

    def __init__(self, alphabet: list[int]):
        self.alphabet, self.sets, self.follow = alphabet, [], []

    def leaf(self, holds) -> tuple[bool, set[int], set[int]]:
        self.sets.append(frozenset(c for c in self.alphabet if holds(c)))
        self.follow.append(set())
        if len(self.sets) > MOST_POSITIONS:
            raise ValueError("has too many parts")
        k = len(self.sets) - 1
        return False, {k}, {k}

    def joined(self, a, b):
        for k in a[2]:
            self.follow[k] |= b[1]
        return a[0] and b[0], a[1] | (b[1] if a[0] else set()), b[2] | (a[2] if b[0] else set())

    def looped(self, a):
        for k in a[2]:
            self.follow[k] |= a[1]
        return a

    def read(self, parsed) -> tuple[bool, set[int], set[int]]:
        out = (True, set(), set())
        for op, value in parsed:
            out = self.joined(out, self.part(op, value))
        return out

    def part(self, op, value):
        if op in (C.LITERAL, C.NOT_LITERAL):
            return self.leaf(lambda c: (c == value) == (op is C.LITERAL))
        if op is C.ANY:
            return self.leaf(lambda c: c != 10)
        if op is C.IN:
            return self.leaf(_class(value))
        if op is C.BRANCH:
            ways = [self.read(x) for x in value[1]]
            return any(w[0] for w in ways), set().union(*(w[1] for w in ways)), set().union(*(w[2] for w in ways))
        if op is C.SUBPATTERN:
            return self.read(value[-1])
        if op is C.ATOMIC_GROUP:
            return self.read(value)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            if most is C.MAXREPEAT or most > MOST_TURNS:
                nullable, first, last = self.looped(self.read(inner))
                return nullable or least == 0, first, last
            out = (True, set(), set())
            for k in range(most):
                own = self.read(inner)
                out = self.joined(out, (own[0] or k >= least, own[1], own[2]))
            return out
        if op in (C.ASSERT, C.ASSERT_NOT):
            self.read(value[1])  # apart from the rest: its own loops count
        elif op in (C.GROUPREF, C.GROUPREF_EXISTS):
            raise ValueError("refers back to a group")
        return True, set(), set()


def _class(items):
    tests, negated = [], False
    for op, value in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            tests.append(lambda c, v=value: c == v)
        elif op is C.RANGE:
            tests.append(lambda c, v=value: v[0] <= c <= v[1])
        elif op is C.CATEGORY:
            named = {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W"}[value]
            tests.append(lambda c, p=re.compile(named): p.match(chr(c)) is not None)
    return lambda c: any(t(c) for t in tests) != negated


def _named(parsed, found: set[int]) -> set[int]:
    """Characters that the pattern names, and those beside the ends of its ranges."""
    for op, value in parsed:
        if op in (C.LITERAL, C.NOT_LITERAL):
            found.add(value)
        elif op is C.RANGE:
            found |= {value[0], value[1], value[0] - 1, value[1] + 1} - {-1, 0x110000}
        elif op is C.IN:
            _named(value, found)
        elif op is C.BRANCH:
            for x in value[1]:
                _named(x, found)
        elif op is C.SUBPATTERN:
            _named(value[-1], found)
        elif op is C.ATOMIC_GROUP:
            _named(value, found)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            _named(value[2], found)
        elif op in (C.ASSERT, C.ASSERT_NOT):
            _named(value[1], found)
    return found


def _reached(starts, steps) -> set:
    seen, open_ = set(starts), list(starts)
    while open_:
        for x in steps(open_.pop()):
            if x not in seen:
                seen.add(x)
                open_.append(x)
    return seen


def positions(pattern: str) -> _Positions:
    # An empty look ahead keeps the parser from making one class of alternatives, which matchers try one by one.
    apart = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\|", lambda m: "|(?=)" if m[0] == "|" else m[0], pattern, flags=re.S)
    parsed = P.parse(apart)
    own = _Positions(sorted(_named(parsed, set(SAMPLES))))
    own.first = own.read(parsed)[1]
    return own


def ambiguity(pattern: str) -> str | None:
    """Why the pattern's number of ways over a text grows too fast, or None. The pattern is in Python's dialect."""
    own = positions(pattern)
    n, follow, sets = len(own.sets), own.follow, own.sets

    def steps(state):
        """All states that follow over one character that all parts share."""
        out = [((), None)]
        for p in state:
            out = [((*done, q), sets[q] if shared is None else shared & sets[q]) for done, shared in out for q in follow[p] if shared is None or shared & sets[q]]
        return [done for done, shared in out if shared]

    after = [_reached(follow[p], lambda q: follow[q]) for p in range(n)]
    turning = [p for p in range(n) if p in after[p]]
    pairs: dict = {}

    def pair_steps(state):
        if state not in pairs:
            pairs[state] = steps(state)
        return pairs[state]

    for p in turning:
        for q, r in _reached(pair_steps((p, p)), pair_steps):
            if q < r and p in after[q] and p in after[r] and (p, p) in _reached([(q, r)], pair_steps):
                return "has two ways around one loop over the same text"
    gives = {p: {q for q in turning if q != p and q in after[p] and sets[p] & sets[q] and (p, q, q) in _reached(steps((p, p, q)), steps)} for p in turning} if len(turning) <= 40 else {}
    if len(turning) > 40:
        return "has too many loops"
    if any(gives.get(q) for p in turning for q in gives[p]):
        return "has three loops in a row that share a text"
    return None
