"""All matches of a pattern in a text, with their line and what stands before them, without leaving the JVM.

split() and regexp_extract_all() see the same matches, so the text between them gives positions. Groups are taken from the
match itself, so a text is searched twice whatever the number of groups; patterns must not look beyond their match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import folded

#: Bytes that ``before`` covers at least; it has as many characters.
TAIL = 8
_FOUND = "array<struct<groups:array<string>,line:bigint,before:string,last:string>>"
# White space of Unicode, what \s stands for in the patterns.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def _lines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def _last(x: Column, earlier: Column) -> Column:
    """The last character of x that is no white space, or the earlier one."""
    return F.coalesce(F.nullif(F.right(F.rtrim(x, F.lit(_WHITE)), F.lit(1)), F.lit("")), earlier)


def matches(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<groups, line, before, last>>: groups from 0, the 1-based line of the match's start, the TAIL characters
    before it, and the last character before it that is no white space (empty if there is none)."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    zero = F.struct(F.lit(1).cast("bigint").alias("line"), F.lit("").alias("tail"), F.lit("").alias("last"))

    def step(a: Column, x: Column) -> Column:
        line = (a["line"] + _lines(x["gap"])).cast("bigint")
        before = F.right(F.concat(a["tail"], F.right(x["gap"], F.lit(TAIL))), F.lit(TAIL))
        last = _last(x["gap"], a["last"])
        parts = F.array(x["hit"], *[F.regexp_extract(x["hit"], pattern, g) for g in range(1, groups + 1)])
        one = F.struct(parts.alias("groups"), line.alias("line"), before.alias("before"), last.alias("last"))
        whole = F.coalesce(x["hit"], F.lit(""))
        return F.struct(
            (line + _lines(whole)).cast("bigint").alias("line"),
            F.right(F.concat(before, F.right(whole, F.lit(TAIL))), F.lit(TAIL)).alias("tail"),
            _last(whole, last).alias("last"),
            F.when(x["hit"].isNull(), a["found"]).otherwise(F.array_append(a["found"], one)).alias("found"),
        )

    return folded(both, zero, _FOUND, step)
