"""Boolean trigram queries that every match of a regex must satisfy.

A query is a list of alternatives, each a set of trigrams that must all occur in the lower-cased text. ``None``
says that the regex demands no trigram, so its rule has to scan all texts.
"""

from __future__ import annotations

import itertools
import re._parser as sre

#: At most so many strings are followed through alternatives before a run of literals is closed.
MOST_STRINGS = 64


def _strings(items) -> list[str] | None:
    """All strings that a sequence of regex nodes can match, lower-cased, or None if they are not few and finite."""
    out = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg).lower()]
        elif name == "SUBPATTERN":
            some = _strings(arg[3])
        elif name == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            some = None if any(x is None for x in each) else list(itertools.chain(*each))
        elif name == "MAX_REPEAT" and arg[1] == 1:
            one = _strings(arg[2])
            some = None if one is None else one + [""] * (arg[0] == 0)
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            some = [chr(a).lower() for _, a in arg]
        elif name == "AT":
            some = [""]
        else:
            some = None
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in some]
    return list(dict.fromkeys(out))


def _flat(items):
    """Groups that are neither optional nor alternatives are opened up."""
    for op, arg in items:
        if str(op) == "SUBPATTERN" and _strings([(op, arg)]) is None:
            yield from _flat(arg[3])
        else:
            yield op, arg


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives of ``pattern``: a text that matches has all trigrams of at least one of them."""
    runs, run = [], []
    for node in _flat(sre.parse(pattern)):
        if _strings(run + [node]) is not None:
            run.append(node)
        else:
            runs.append(run)
            run = [node] if _strings([node]) is not None else []
    runs.append(run)
    best: list[frozenset[str]] = [frozenset()]
    for run in runs:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in _strings(run)}
        if frozenset() in grams:  # some string is shorter than a trigram: the run demands nothing
            continue
        best = [a | b for a in best for b in grams]
    best = sorted({x for x in best if not any(y < x for y in best)}, key=sorted)
    return best if all(best) else None
