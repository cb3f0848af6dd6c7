"""Array expressions that built-in functions lack: sums along an array, filling one in a fold, differences of two. All inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it. What the body gives is copied, so a
    fold that fills an array does not go through here."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 64) -> Column:
    """Inclusive sums from the start of an array. Sums of blocks come first, so no step looks back over more than a block."""
    def summed(items):
        return F.aggregate(items, F.lit(0), lambda a, x: a + x)

    def in_blocks(array):
        count = F.ceil(F.size(array) / F.lit(block)).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), count), lambda b: b < count), lambda b: F.slice(array, b * block + 1, block))

    def along(blocks):
        return let(F.transform(blocks, summed), lambda totals: F.flatten(F.transform(blocks, lambda items, b: let(
            summed(F.slice(totals, 1, b)), lambda before: F.transform(items, lambda _, i: before + summed(F.slice(items, 1, i + 1)))))))

    return let(let(values, in_blocks), along)


def cut(array: Column, start: Column, count: Column) -> Column:
    """``count`` items from the 0-based place ``start``; unlike ``slice`` it does not copy the whole array each time."""
    return F.when(count > 0, F.transform(F.sequence(start, start + F.greatest(count, F.lit(1)) - 1), lambda i: F.get(array, i))).otherwise(
        F.array().cast("array<string>"))


def _same_ahead(a: Column, b: Column, x: Column, y: Column) -> Column:
    """How many items of ``a`` from x on equal those of ``b`` from y on: slices of falling powers of two are compared."""
    room = F.least(F.size(a) - x, F.size(b) - y)
    one = F.get(a, x) == F.get(b, y)

    def further(limit):
        widths = F.transform(F.reverse(F.sequence(F.lit(0), F.floor(F.log2(limit)).cast("int"))), lambda j: F.pow(F.lit(2), j).cast("int"))
        return F.aggregate(F.concat(widths, widths), F.lit(0), lambda got, width: F.when(
            (got + width <= limit) & (F.slice(a, x + got + 1, width) == F.slice(b, y + got + 1, width)), got + width).otherwise(got))

    return F.when((room > 0) & one, let(room, further)).otherwise(0)


def differences(a: Column, b: Column) -> Column:
    """Changed stretches of two arrays of texts without nulls, in order: (a_from, a_to, b_from, b_to), ends exclusive.

    The fewest items are taken out and put in: a fold over the number of changes keeps the furthest point of every
    diagonal, a second one walks back. Among equal ways items are put in only where that has got further. Work grows with
    the changes squared and hardly with the length, so two long texts with few changes are cheap.
    """
    point, change = "array<int>", "struct<x:int,y:int,out:int>"

    def forward(n, m):
        def ahead(x, k):
            return x + _same_ahead(a, b, x, x - k)

        def step(trace, d):
            v = F.element_at(trace, -1)
            # The end lies on one diagonal, so one point tells whether it was reached.
            at = n - m + F.size(v) - 1
            done = (at % 2 == 0) & F.coalesce(F.get(v, (at / 2).cast("int")) >= n, F.lit(False))

            def furthest(i):
                out, into = F.get(v, i - 1), F.get(v, i)
                x = F.when(i == 0, into).when(i == d, out + 1).when(out < into, into).otherwise(out + 1)
                return let(x, lambda at: ahead(at, i * 2 - d))

            return F.when(done, trace).otherwise(F.concat(trace, F.array(F.transform(F.sequence(F.lit(0), d), furthest).cast(point))))

        start = F.array(F.array(ahead(F.lit(0), F.lit(0))).cast(point))
        return F.aggregate(F.filter(F.sequence(F.lit(0), n + m), lambda d: d > 0), start, step)

    def back(trace, n, m):
        def step(edits, d):
            before = F.get(trace, d - 1)
            here_x, here_y = F.coalesce(F.get(edits, F.lit(0))["x"], n), F.coalesce(F.get(edits, F.lit(0))["y"], m)

            def chosen(i):
                out, into = F.get(before, i - 1), F.get(before, i)
                puts_in = (i == 0) | ((i != d) & (out < into))
                x = F.when(puts_in, into).otherwise(out)
                return F.struct(x.alias("x"), (x - (i * 2 - d) - F.when(puts_in, 1).otherwise(-1)).alias("y"),
                                F.when(puts_in, 0).otherwise(1).alias("out")).cast(change)

            return F.concat(F.array(let(((here_x - here_y + d) / 2).cast("int"), chosen)), edits)

        return F.aggregate(F.filter(F.reverse(F.sequence(F.lit(0), F.size(trace) - 1)), lambda d: d > 0),
                           F.array().cast(f"array<{change}>"), step)

    def stretches(edits):
        def begins(i):
            before, this = F.get(edits, i - 1), F.get(edits, i)
            return (i == 0) | (before["x"] + before["out"] != this["x"]) | (before["y"] + 1 - before["out"] != this["y"])

        places = F.filter(F.transform(edits, lambda _, i: F.when(begins(i), i).otherwise(-1)), lambda i: i >= 0)

        def stretch(at, last):
            return F.struct(at["x"].alias("a_from"), (last["x"] + last["out"]).alias("a_to"), at["y"].alias("b_from"), (last["y"] + 1 - last["out"]).alias("b_to"))

        return let(places, lambda found: F.transform(found, lambda i, j: stretch(
            F.get(edits, i), F.get(edits, F.coalesce(F.get(found, j + 1), F.size(edits)) - 1))))

    n, m = F.size(a), F.size(b)
    return let(let(forward(n, m), lambda trace: back(trace, n, m)), stretches)
