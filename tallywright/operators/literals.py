"""Regex taxonomies searched by required literals first.

Most patterns cannot match unless one of a few plain strings occurs. These are read
off each pattern's parse, all of a taxonomy's go into one automaton, and a text is
handed to a pattern only if one of its strings is in it. Matches are those of
Python's `re`, case-blind, left to right. A pattern without such strings is always
searched.

Texts reach Python as one Arrow column, and only spans come back; context,
negation and flags stay expressions over them.
"""

from __future__ import annotations

import re
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "struct<matches:array<struct<category:string,pattern:string,start:int,end:int,hit:string>>,n_searched:int>"
#: A string shorter than this tells too little.
SHORTEST = 3
#: The letters outside ASCII that equal one inside when case is ignored.
FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """`text` in which every literal that occurs without regard to case occurs in lower case."""
    return (text if text.isascii() else text.translate(FOLDED)).lower()


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two sets of strings, the one whose shortest is longer; of equals the smaller."""
    if a is None or b is None:
        return b if a is None else a
    weight = lambda s: (min(map(len, s)), -len(s))
    return max(a, b, key=weight)


def _of(parsed) -> frozenset | None:
    """Strings one of which is in every match of a parsed sequence, or None."""
    best, run = None, ""
    for op, value in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if name == "AT":  # takes no room
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if name == "SUBPATTERN":
            best = _better(best, _of(value[3]))
        elif name == "BRANCH":
            parts = [_of(p) for p in value[1]]
            if all(p is not None for p in parts):
                best = _better(best, frozenset().union(*parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            best = _better(best, _of(value[2]))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _of(value))
    return best


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case strings one of which is in whatever `pattern` matches without regard to case; None where none is long enough."""
    found = _of(parser.parse(pattern, re.IGNORECASE))
    return found if found and min(map(len, found)) >= SHORTEST else None


class Search:
    """A taxonomy ready to be searched for."""

    def __init__(self, taxonomy: dict[str, list[str]]):
        self.patterns = [(c, p, re.compile(p, re.IGNORECASE)) for c, ps in taxonomy.items() for p in ps]
        wanted: dict[str, set[int]] = {}
        self.always: set[int] = set()
        for i, (_, p, _) in enumerate(self.patterns):
            strings = required(p)
            if strings is None:
                self.always.add(i)
            for s in strings or ():
                wanted.setdefault(s, set()).add(i)
        self.wanted, self.automaton = wanted, None
        try:
            import ahocorasick
        except ImportError:  # the strings are then looked for one by one
            return
        if wanted:
            self.automaton = ahocorasick.Automaton()
            for s, of in wanted.items():
                self.automaton.add_word(s, of)
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Patterns that may match in `text`, in order."""
        low, found = folded(text), set(self.always)
        if self.automaton is not None:
            for _, of in self.automaton.iter(low):
                found |= of
        else:
            for s, of in self.wanted.items():
                if s in low:
                    found |= of
        return sorted(found)

    def __call__(self, text: str) -> dict:
        tried = self.candidates(text)
        hits = [{"category": c, "pattern": p, "start": m.start(), "end": m.end(), "hit": m[0]} for c, p, rx in map(self.patterns.__getitem__, tried) for m in rx.finditer(text)]
        return {"matches": hits, "n_searched": len(tried)}


def found(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Struct of all matches in `text` (none in null) and the number of patterns it was searched for."""
    state: dict = {}
    kind = pa.struct([("matches", pa.list_(pa.struct([("category", pa.string()), ("pattern", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hit", pa.string())]))), ("n_searched", pa.int32())])

    def run(texts: pa.Array) -> pa.Array:
        search = state.get("search") or state.setdefault("search", Search(taxonomy))
        return pa.array([search(t or "") for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, FOUND)(text)
