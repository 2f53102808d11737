"""Bind a value once inside an expression.

The optimizer may inline a column into every place that uses it, also into a
lambda that runs for each element. A one-element array keeps it a single value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def let_all(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` called with every named value computed once."""
    return let(F.struct(*(v.alias(k) for k, v in values.items())), lambda x: body(**{k: x[k] for k in values}))


def in_blocks(items: Column) -> Column:
    """``items`` cut into about as many blocks as each has items. A fold that copies
    what it has made so far at each step copies a block's worth, not all of it."""

    def cut(items: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(8))
        return let(n, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / n).cast("int") - 1, F.lit(0))), lambda b: F.slice(items, b * n + 1, n)))

    return let(items, cut)


def fold_last(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """array<kind>: ``step`` (made so far, item) for each item in order, where
    ``step`` looks at, replaces or appends behind the last one made only."""
    begin = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("last"))

    def block(acc: Column, part: Column) -> Column:
        def closed(made: Column) -> Column:
            n = F.size(made)
            return F.struct(F.concat(acc["done"], F.array(F.slice(made, 1, F.greatest(n - 1, F.lit(0))))).alias("done"), F.slice(made, F.greatest(n, F.lit(1)), 1).alias("last"))

        return let(F.aggregate(part, acc["last"], step), closed)

    return F.aggregate(in_blocks(items), begin, block, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))
