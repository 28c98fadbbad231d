"""Many fixed patterns at once.

A few patterns are a chain of conditions, which stays in generated code. Many are an Aho-Corasick automaton: it finds all of
them in one pass over a text, whatever their number. The patterns go to the tasks with the function (beyond a megabyte Spark
broadcasts it), a worker builds the automaton once, and each batch is searched by its distinct texts.

Of regular expressions, the characters that every hit has one of say which texts need not be searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many patterns are a chain of conditions.
FEW = 16


def by_length(patterns: Sequence[str]) -> list[str]:
    """The distinct patterns, the longest (in UTF-16 units) first, of equally long ones the first declared."""
    return sorted(dict.fromkeys(patterns), key=lambda p: -len(p.encode("utf-16-le", "surrogatepass")))


@lru_cache(maxsize=8)
def _automaton(ranked: tuple[str, ...]):
    import ahocorasick

    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for rank, pattern in enumerate(ranked):
        if pattern:
            built.add_word(pattern, rank)
    built.make_automaton()
    return built


def _best(text: str, ranked: tuple[str, ...]) -> int | None:
    """The least rank of the patterns in a text. Every text contains the empty pattern, which is last."""
    found = min((rank for _, rank in _automaton(ranked).iter(text)), default=None) if any(ranked) else None
    return found if found is not None or not ranked or ranked[-1] else len(ranked) - 1


def _distinct(texts: pa.Array, found) -> list:
    """``found`` of each text, asked once for each distinct text; nulls stay."""
    coded = pc.dictionary_encode(texts)
    known = [found(t) for t in coded.dictionary.to_pylist()]
    return [None if i is None else known[i] for i in coded.indices.to_pylist()]


def longest_of(text: Column, values: Mapping[str, str], few: int = FEW) -> Column:
    """The longest pattern that a text contains and its value, as a struct (pattern, value); of equally long patterns the
    first declared. Null text, and a text without any: null."""
    ranked = by_length(list(values))
    kind = "struct<pattern: string, value: string>"
    if len(ranked) <= few:
        hits = [F.when(F.contains(text, F.lit(p)), F.struct(F.lit(p).alias("pattern"), F.lit(values[p]).alias("value"))) for p in ranked]
        return F.coalesce(*hits, F.lit(None).cast(kind))
    told, result = tuple(ranked), [values[p] for p in ranked]

    def search(texts: pa.Array) -> pa.Array:
        rows = _distinct(texts, lambda t: None if (i := _best(t, told)) is None else {"pattern": told[i], "value": result[i]})
        return pa.array(rows, pa.struct([("pattern", pa.string()), ("value", pa.string())]))

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, kind)(text)


def any_of(text: Column, patterns: Sequence[str], few: int = FEW) -> Column:
    """Whether a text contains any of the patterns; null text: null."""
    told = tuple(dict.fromkeys(patterns))
    if "" in told or not told:
        return F.when(text.isNotNull(), F.lit(bool(told)))
    if len(told) <= few:
        out = F.contains(text, F.lit(told[0]))
        for p in told[1:]:
            out = out | F.contains(text, F.lit(p))
        return out

    def search(texts: pa.Array) -> pa.Array:
        found = _automaton(told)
        return pa.array(_distinct(texts, lambda t: next(found.iter(t), None) is not None), pa.bool_())

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, "boolean")(text)


#: What a rule's pattern may hold for ``hit_chars`` to read it: escapes and groups that mean the same wherever they are read.
_READABLE = re.compile(r"(?:[^\\(\[]|\\[dDwWsSbBtnr!-/:-@\[-`{-~]|\((?:\?(?::|=|!|<=|<!))?(?!\?)|\[(?:[^\\\[\]]|\\[dDwWsStnr!-/:-@\[-`{-~])+\])*")
#: Sets of more characters than this are no help.
_MOST = 64


def _rarest(sets: Iterable[frozenset[str] | None]) -> frozenset[str] | None:
    """The set whose characters texts have least, by a rough guess: letters, blanks and common signs weigh more."""
    return min((x for x in sets if x), key=lambda x: sum(20 if c.isalpha() or c.isspace() or c in ".,'-" else 1 for c in x), default=None)


def _chars(op: str, arg) -> frozenset[str] | None:
    """Characters of which each match of one node of a parsed pattern has one; None where nothing is known."""
    match op:
        case "LITERAL":
            return frozenset(chr(arg))
        case "RANGE":
            return frozenset(map(chr, range(arg[0], arg[1] + 1))) if arg[1] - arg[0] < _MOST else None
        case "CATEGORY":
            return frozenset("0123456789") if str(arg) == "CATEGORY_DIGIT" else None
        case "IN" | "BRANCH":
            parts = [_chars(str(o), a) for o, a in arg] if op == "IN" else [_rarest(_chars(str(o), a) for o, a in x) for x in arg[1]]
            return frozenset().union(*parts) if all(parts) and sum(map(len, parts)) <= _MOST else None
        case "SUBPATTERN":
            return _rarest(_chars(str(o), a) for o, a in arg[3])
        case "MAX_REPEAT" | "MIN_REPEAT":
            return _rarest(_chars(str(o), a) for o, a in arg[2]) if arg[0] else None
    return None


def hit_chars(pattern: str, flags: str = "") -> frozenset[str] | None:
    """Characters of which every hit of a rule's pattern has at least one, or None where that is not known."""
    if not _READABLE.fullmatch(pattern):
        return None
    try:
        found = _rarest(_chars(str(op), arg) for op, arg in re._parser.parse(pattern))
    except (re.error, AttributeError, OverflowError, RecursionError):
        return None
    folded = "i" in flags and found and any(not c.isascii() or c.isalpha() for c in found)
    return None if folded else found


def may_hit(text: Column, rules: Sequence[tuple[str, str]]) -> Column | None:
    """Whether a text has a character that some rule (pattern, flags) needs; None where a rule may hit any text."""
    sets = [hit_chars(*r) for r in rules]
    if not sets or not all(sets):
        return None
    return text.rlike("[" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted(frozenset().union(*sets))) + "]")
