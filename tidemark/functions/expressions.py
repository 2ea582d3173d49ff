"""Which regular expressions may run on executors: those that backtracking can't make exponential.

Java's matcher goes back and tries again.  That is dear where text can be split in several
ways among repetitions: one inside another, alternatives that begin alike inside one, or
two in a row over the same characters.  The expression's parsed form is looked through for
these; what is not understood counts as unsafe.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Longer expressions are not looked at.
LONGEST = 250
#: A repetition of up to so many times is taken for a bounded one.
BOUNDED = 16

_REPEATS = (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT)
_CATEGORIES = {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S", K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_WORD: r"\W"}
#: Characters by which sets are compared, besides those that the expression names.
_SAMPLE = frozenset(map(chr, range(128))) | frozenset("é¼Ω中 　")


class _Unsafe(Exception):
    pass


def _literals(nodes) -> set[str]:
    """Every character an expression names, and the ends of its ranges."""
    out: set[str] = set()
    for op, arg in nodes:
        if op in (K.LITERAL, K.NOT_LITERAL):
            out.add(chr(arg))
        elif op is K.RANGE:
            out |= {chr(arg[0]), chr(arg[1])}
        elif op is K.IN:
            out |= _literals(arg)
        else:
            for inner in _inside(op, arg):
                out |= _literals(inner)
    return out


def _inside(op, arg) -> list:
    """The sequences within a node."""
    if op is K.BRANCH:
        return list(arg[1])
    if op is K.SUBPATTERN:
        return [arg[3]]
    if op in _REPEATS:
        return [arg[2]]
    if op in (K.ASSERT, K.ASSERT_NOT):
        return [arg[1]]
    if op is K.ATOMIC_GROUP:
        return [arg]
    return []


class _Judge:
    def __init__(self, universe: set[str]):
        self.universe = universe

    def characters(self, op, arg) -> set[str] | None:
        """What a node that takes one character takes; None for other nodes."""
        if op is K.LITERAL:
            return {chr(arg)}
        if op is K.NOT_LITERAL:
            return self.universe - {chr(arg)}
        if op is K.ANY:
            return self.universe - {"\n"}
        if op is K.IN:
            out: set[str] = set()
            for kind, value in arg:
                if kind is K.LITERAL:
                    out.add(chr(value))
                elif kind is K.RANGE:
                    out |= {c for c in self.universe if value[0] <= ord(c) <= value[1]}
                elif kind is K.CATEGORY:
                    out |= {c for c in self.universe if re.match(_CATEGORIES[value], c)}
                elif kind is not K.NEGATE:
                    raise _Unsafe
            return self.universe - out if arg[0][0] is K.NEGATE else out
        return None

    def nullable(self, nodes) -> bool:
        return all(self.node_nullable(op, arg) for op, arg in nodes)

    def node_nullable(self, op, arg) -> bool:
        if op in _REPEATS:
            return arg[0] == 0 or self.nullable(arg[2])
        if op is K.BRANCH:
            return any(map(self.nullable, arg[1]))
        if op in (K.SUBPATTERN, K.ATOMIC_GROUP):
            return self.nullable(_inside(op, arg)[0])
        return op in (K.AT, K.ASSERT, K.ASSERT_NOT)

    def first(self, nodes) -> set[str]:
        """Characters that text matched by a sequence may begin with."""
        out: set[str] = set()
        for op, arg in nodes:
            own = self.characters(op, arg)
            out |= own if own is not None else set().union(*map(self.first, _inside(op, arg))) if op not in (K.ASSERT, K.ASSERT_NOT) else set()
            if not self.node_nullable(op, arg):
                break
        return out

    def next_runs(self, nodes) -> set[str]:
        """Characters of unbounded repetitions that a sequence may begin with."""
        out: set[str] = set()
        for op, arg in nodes:
            if op in _REPEATS and arg[1] > BOUNDED:
                out |= self.first(arg[2])
            elif op in (K.SUBPATTERN, K.BRANCH, K.ATOMIC_GROUP) or op in _REPEATS:
                out |= set().union(*map(self.next_runs, _inside(op, arg)))
            if not self.node_nullable(op, arg):
                break
        return out

    def check(self, nodes, follow: set[str], runs: set[str], looped: bool) -> None:
        """Raises for what is ambiguous; follow and runs are what comes after, looped whether an unbounded repetition is around."""
        nodes = list(nodes)
        for i, (op, arg) in enumerate(nodes):
            rest = nodes[i + 1 :]
            through = self.nullable(rest)
            after = self.first(rest) | (follow if through else set())
            after_runs = self.next_runs(rest) | (runs if through else set())
            if op in _REPEATS:
                least, most, body = arg
                own = self.first(body)
                unbounded = most > BOUNDED
                if unbounded and self.nullable(body):
                    raise _Unsafe
                if looped and least != most and own & after:
                    raise _Unsafe
                if unbounded and len(body) == 1 and self.characters(*body[0]) is not None and own & after_runs:
                    raise _Unsafe
                self.check(body, after | own if most > 1 else after, after_runs, looped or unbounded)
            elif op is K.BRANCH:
                heads = [self.first(b) | (after if self.nullable(b) else set()) for b in arg[1]]
                if looped and any(a & b for n, a in enumerate(heads) for b in heads[:n]):
                    raise _Unsafe
                for branch in arg[1]:
                    self.check(branch, after, after_runs, looped)
            elif inside := _inside(op, arg):
                self.check(inside[0], after, after_runs, looped)
            elif op is not K.AT and self.characters(op, arg) is None:
                raise _Unsafe


def is_safe(pattern: str | None) -> bool:
    """Whether an expression is not empty, not too long, understood, and free of ambiguous repetition."""
    p = (pattern or "").strip()
    if not p or len(p) > LONGEST:
        return False
    try:
        nodes = _parser.parse(p)
        _Judge(set(_SAMPLE) | _literals(nodes)).check(nodes, set(), set(), False)
    except (_Unsafe, re.error, KeyError, RecursionError, OverflowError):
        return False
    return True
