"""Running folds over arrays, without copying all that was found at every step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.text import bound


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each of ``items``, beginning with ``start``.

    A fold copies its state at every step, so one that carries all states would cost the square of their number.
    Items are cut into blocks of the cubic root of their number: one fold gives the state before each block, then each
    block is folded by itself.  ``items`` is read several times: pass a column.  Null items give null.
    """
    n = F.size(items)
    width = F.greatest(F.ceil(F.cbrt(n)).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width)
    blocks = F.when(items.isNotNull(), F.transform(starts, lambda i: F.slice(items, i + 1, width)))

    def last(array: Column) -> Column:
        return F.try_element_at(array, F.lit(-1))

    def states(block: Column, before: Column) -> Column:
        seen = F.aggregate(block, F.array(before), lambda seen, x: F.concat(seen, F.array(step(last(seen), x))))
        return F.slice(seen, F.lit(2), F.size(block))

    def befores(blocks: Column) -> Column:
        return F.aggregate(
            blocks, F.array(start), lambda seen, block: F.concat(seen, F.array(F.aggregate(block, last(seen), step)))
        )

    def along(blocks: Column) -> Column:
        return bound(befores(blocks), lambda b: F.transform(blocks, lambda block, i: states(block, F.get(b, i))))

    return F.flatten(bound(blocks, along))
