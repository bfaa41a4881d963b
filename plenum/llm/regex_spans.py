"""Spans of regular-expression matches as native columns.

Spark gives the matches of a pattern and the pieces between them, but not places; their running lengths are the places.
Running values go over an array in blocks: the totals of the blocks first, then each block from its own total, so that no
fold grows an array longer than a block or the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
CONTEXT_CHARS = 48
SPANS = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

Step = Callable[[Column, Column], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: as the variable of a lambda, lest it be computed again at every element."""
    return F.transform(F.array(value), use)[0]


def running(array: Column, zero: Column, state: str, add: Step, merge: Step) -> Column:
    """Of each element what ``add`` makes of all before it; ``merge`` joins two states of SQL type ``state``, of which ``zero`` is the neutral one."""

    def before_each(values: Column, first: Column, step: Step) -> Column:
        start = F.struct(first.alias("at"), F.array().cast(f"array<{state}>").alias("out"))
        return F.aggregate(values, start, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def in_blocks(blocks: Column) -> Column:
        firsts = before_each(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), zero, merge)
        return F.flatten(F.zip_with(blocks, firsts, lambda b, first: before_each(b, first, add)))

    def whole(values: Column) -> Column:
        count = F.ceil(F.size(values) / BLOCK).cast("int")
        return bound(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: F.slice(values, (b - 1) * BLOCK + 1, F.lit(BLOCK))), in_blocks)

    return bound(array, whole)


def starts(pieces: Column, matches: Column) -> Column:
    """Where the matches start, from the sizes of the pieces before them (of any number after) and of the matches."""

    def of(both: Column) -> Column:
        before = running(both, F.lit(0), "int", lambda s, x: s + x["gap"] + x["size"], lambda s, t: s + t)
        return F.zip_with(before, both, lambda s, x: s + x["gap"])

    return bound(F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(a.alias("gap"), b.alias("size"))), of)


def spans(text: Column, pattern: Column) -> Column:
    """The non-overlapping matches, leftmost first: start and end in code points, the match, and the characters around it.

    What stands around is taken from the text between matches, so that no span walks over the whole text; before a match it
    reaches over the match before, too.
    """
    near = F.lit(CONTEXT_CHARS)

    def of(s: Column) -> Column:
        pieces, matches = s["pieces"], s["matches"]

        def one(start: Column, i: Column) -> Column:
            match = F.get(matches, i)
            before = F.concat(F.when(i > 0, F.concat(F.right(F.get(pieces, i - 1), near), F.get(matches, i - 1))).otherwise(F.lit("")), F.right(F.get(pieces, i), near))
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.right(before, near).alias("before"), F.left(F.get(pieces, i + 1), near).alias("after"))

        return F.transform(starts(F.transform(pieces, F.length), F.transform(matches, F.length)), one)

    return bound(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches")), of)


def no_spans() -> Column:
    return F.array().cast(SPANS)
