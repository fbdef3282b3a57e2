"""Helpers for operators made of DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Elements of an array, and code points of a text, that are handled as one.
BLOCK = 512


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, op) -> Column:
    """For each of the numbers (0 or more) what ``op``, a sum or maximum, makes of those before it; one more for the end.

    Runs within blocks, then over blocks: an array of n numbers is copied about n times the size of a block, not n times n.
    """
    ints = F.array().cast("array<int>")

    def walk(xs: Column, of) -> Column:
        start = F.struct(F.lit(0).alias("now"), ints.alias("seen"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(op(acc["now"], of(x)).cast("int").alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")))

    def all_blocks(blocks: Column) -> Column:
        whole = walk(blocks, lambda x: x["now"])
        return let(whole, lambda w: F.concat(F.flatten(F.zip_with(blocks, w["seen"], lambda x, v: F.transform(x["seen"], lambda y: op(y, v)))), F.array(w["now"])))

    cut = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK)), lambda i: walk(F.slice(vs, (i * BLOCK + 1).cast("int"), F.lit(BLOCK)), lambda x: x))
    return let(values, lambda vs: F.when(F.size(vs) == 0, F.array(F.lit(0))).otherwise(let(cut(vs), all_blocks)))
