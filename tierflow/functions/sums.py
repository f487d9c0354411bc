"""Sums of doubles that do not depend on the order of the rows, over the whole range of a double.

A sum of doubles may differ in its last bit each time a lost shuffle block is computed
again, and such a sum must not feed a join, a tie test or a distinct. Here every number is
taken by its decimal digits, at most 17, and added as a decimal of 38 digits. Three kinds
of numbers have sums of their own, each exact for 10^12 rows and more of a key:

* near: below 10^5, with 20 places after the point;
* large: from 10^5 to 10^14, where 17 digits leave no more than 12 places;
* far: all others, by bands of eight decades. A number of a band is divided by the band's
  first power of ten, which leaves 16 places.

Near and large numbers are added by key in one aggregate. Far ones are rare: they are filtered
by ranges that Parquet's statistics know, added by band, and joined to the sums of their
keys; without any, adaptive execution drops that join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decades of a band, and places after the point of its numbers.
BAND, PLACES = 8, 16
_NEAR, _LARGE, _FAR, _WHOLE = "decimal(38,20)", "decimal(38,12)", f"decimal(38,{PLACES})", "decimal(38,0)"

# The expressions are SQL text: the driver parses one far faster than it builds it call by call.


def _may_be_far(v: str) -> str:
    """Ranges that hold all far numbers, plain enough for a scan to skip by its statistics."""
    return f"({v} >= 1e14D or {v} <= -1e14D or ({v} < 1e-3D and {v} > -1e-3D and {v} <> 0D))"


def _reads_back(v: str) -> str:
    """Whether 20 places hold the number: text with fewer digits than it needs is another number's."""
    return f"coalesce(cast(try_cast({v} as {_NEAR}) as double) = {v}, false)"


def _is_far(v: str) -> str:
    finite = f"{v} < double('infinity') and {v} > double('-infinity')"
    return f"({finite} and {_may_be_far(v)} and (abs({v}) >= 1e14D or not {_reads_back(v)}))"


def _close_sums(v: str, i: int) -> list[Column]:
    near = f"abs({v}) < 1e5D and (abs({v}) >= 1e-3D or {_reads_back(v)})"
    return [
        F.expr(f"sum(case when {near} then try_cast({v} as {_NEAR}) end) as __near{i}"),
        F.expr(f"sum(case when abs({v}) >= 1e5D and abs({v}) < 1e14D then try_cast({v} as {_LARGE}) end) as __large{i}"),
        F.expr(f"sum(case when isnan({v}) or abs({v}) = double('infinity') then {v} end) as __odd{i}"),
    ]


def _close(near: str, large: str) -> str:
    """The double nearest to near + large; null where both are."""
    both = f"cast(try_cast({near} as decimal(37,20)) + try_cast({large} as decimal(37,20)) as double)"
    apart = f"cast({near} as double) + cast({large} as double)"
    return f"coalesce({both}, {apart}, cast({near} as double), cast({large} as double))"


def _whole(scaled: str) -> str:
    """The number as a multiple of its last place."""
    high, unit = f"cast(floor({scaled}) as decimal(22,0))", f"cast(1{'0' * PLACES} as decimal({PLACES + 1},0))"
    low = f"cast(cast({scaled} - {high} as decimal({PLACES + 1},{PLACES})) * {unit} as {_WHOLE})"
    return f"cast(cast(try_multiply({high}, {unit}) as {_WHOLE}) + {low} as {_WHOLE})"


def _banded(parts: str) -> str:
    """Sum of (band, far) parts, null without any: exact in a band, then from the lowest band up."""
    own = f"filter({parts}, p -> p.band = b)"
    total = f"aggregate({own}, cast(0 as {_WHOLE}), (s, p) -> cast(s + {_whole('p.far')} as {_WHOLE}))"
    one = f"cast(concat(cast({total} as string), 'E', cast({BAND} * b - {PLACES} as string)) as double)"
    bands = f"array_sort(array_distinct(transform({parts}, p -> p.band)))"
    return f"case when size({parts}) > 0 then aggregate({bands}, 0D, (t, b) -> t + {one}) end"


def _far_parts(rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """Keys that have far numbers, with the total of each sum's bands."""
    some = " or ".join(_may_be_far(f"__v{i}") for i in range(n))
    each = ", ".join(f"named_struct('__i', {i}, '__v', __v{i})" for i in range(n))
    keys = [F.col(f"`{k}`") for k in names]
    far = rows.where(some).select(*keys, F.expr(f"inline(array({each}))")).where(_is_far("__v"))
    # the text of such a number has an exponent
    far = far.select(*keys, "__i", F.expr("cast(__v as string) as __text"))
    far = far.select("*", F.expr("cast(substring_index(__text, 'E', -1) as int) as __power"))
    far = far.select("*", F.expr(f"cast(floor(__power / {BAND}) as int) as __band"))
    scaled = f"cast(concat(substring_index(__text, 'E', 1), 'E', cast(__power - {BAND} * __band as string)) as {_FAR})"
    by_band = far.groupBy(*keys, "__i", "__band").agg(F.expr(f"sum({scaled}) as __far"))
    return by_band.groupBy(*keys).agg(F.expr("collect_list(named_struct('i', __i, 'band', __band, 'far', __far)) as __parts"))


def exact_sums(
    df: DataFrame,
    keys: Sequence[Column | str],
    sums: Mapping[str, Column | str],
    counts: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """One row per key with the named sums, and the named whole-number sums beside them.

    As ``sum`` does, a sum leaves nulls out, is null over nulls alone, NaN where a NaN or
    both infinities occur, and infinite where one does or the total is beyond a double.
    """
    counts = counts or {}
    col = lambda c: F.col(c) if isinstance(c, str) else c
    keyed = [col(k) for k in keys]
    rows = df.select(
        *keyed,
        *[col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(sums.values())],
        *[col(c).cast("long").alias(f"__n{i}") for i, c in enumerate(counts.values())],
    )
    names = rows.columns[: len(keyed)]
    close = rows.groupBy(*[F.col(f"`{k}`") for k in names]).agg(
        *[c for i in range(len(sums)) for c in _close_sums(f"__v{i}", i)],
        *[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(len(counts))],
    )
    far = _far_parts(rows, names, len(sums)).withColumnsRenamed({k: f"__key{j}" for j, k in enumerate(names)})
    same = " and ".join(f"`{k}` <=> __key{j}" for j, k in enumerate(names))

    def total(i: int) -> Column:
        near_and_large = _close(f"__near{i}", f"__large{i}")
        banded = _banded(f"filter(__parts, q -> q.i = {i})")
        return F.expr(f"coalesce(__odd{i}, {near_and_large} + {banded}, {near_and_large}, {banded})")

    return close.join(far, F.expr(same), "left").select(
        *[F.col(f"`{k}`") for k in names],
        *[total(i).alias(name) for i, name in enumerate(sums)],
        *[F.col(f"__n{i}").alias(name) for i, name in enumerate(counts)],
    )
