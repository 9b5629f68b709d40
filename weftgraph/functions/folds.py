"""Folds over arrays that collect as they go, in near linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def blocks(items: Column) -> Column:
    """The items in order, in about as many lists as each list has items."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return let(size, lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items)), b), lambda i: F.slice(items, i, b)))


def folded(items: Column, state: Column, found: str, step) -> Column:
    """What ``step`` appends to the field ``found`` (an array of that type) while it goes over the items; the other fields
    of the struct ``state`` are carried along. Appending to an array copies it, so each block of items has a list of its
    own: n items cost about n ** 1.5 copied references, not n ** 2."""
    none = F.array().cast(found)

    def block(a: Column, part: Column) -> Column:
        return F.array_append(a, F.aggregate(part, F.element_at(a, -1).withField("found", none), step))

    def whole(x: Column) -> Column:
        return F.flatten(F.transform(F.aggregate(blocks(x), F.array(state.withField("found", none)), block), lambda r: r["found"]))

    return let(items, whole)
