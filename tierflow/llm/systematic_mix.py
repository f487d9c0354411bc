"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size.
The prefix sum of expected copies runs over the source in the order of document size; one
random offset is added, and a document is emitted once for each integer the sum crosses.
Neighbours in that order are of like size, so the words taken stay near the target.

The prefix sum has two levels, so no source is one task: rows are counted by slice
(source, size class, hash part), a window over the few slice counts gives each slice its
start, and a window inside the slice numbers its rows. The number of hash parts of a size
class grows with its rows. Sums are whole numbers in units of 2**-24 copies: no rounding
depends on the order of work, and reruns agree.

Defined results: a null text is empty and has size 0; null sources are one source, placed
last; null or repeated ids and repeated rows are documents of their own (equal rows may
trade places, which leaves the result the same); a source without words has target 0 and
none of its documents is taken; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.quality_rules import words_of

_P = "__mix_"
UNIT = 1 << 24
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Rows of a slice, about.
SLICE_ROWS = 20_000


def _c(name: str) -> Column:
    return F.col(_P + name)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: its size, number of documents, and target.

    Sources take the weights in turn, in code point order, null last. Targets share the
    whole size by weight. One above MOST_COPIES times its source's size stops there and
    the others share the excess: in the order of limit / weight, a source is at its limit
    exactly when the share that the earlier ones leave it reaches its limit. One row per
    source; both windows run over that list alone.
    """
    per = sizes.groupBy(_P + "source").agg(F.sum(_P + "size").alias(_P + "source_size"), F.count(F.lit(1)).alias(_P + "docs"))
    order = Window.orderBy(F.col(_P + "source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn(_P + "weight", weight).withColumn(_P + "cap", MOST_COPIES * _c("source_size"))
    by_cap = Window.orderBy(_c("cap") / _c("weight"), F.col(_P + "source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        _P + "left": F.sum(_P + "source_size").over(whole) - F.coalesce(F.sum(_P + "cap").over(before), F.lit(0)),
        _P + "open": F.sum(_P + "weight").over(whole) - F.coalesce(F.sum(_P + "weight").over(before), F.lit(0)),
    })
    share = _c("left").cast("double") / _c("open")
    per = per.withColumn(_P + "capped", _c("cap") <= share * _c("weight"))
    # The first source below its limit has the share that holds for all after it.
    free = F.min(F.when(~_c("capped"), F.struct((_c("cap") / _c("weight")).alias("o"), F.col(_P + "source").isNull().alias("n"), F.col(_P + "source").alias("s"), share.alias("share")))).over(whole)
    target = F.when(_c("capped"), _c("cap").cast("double")).otherwise(free["share"] * _c("weight"))
    return per.withColumn(_P + "target", target).select(*[_P + n for n in ("source", "source_size", "docs", "target")])


def sized(docs: DataFrame) -> DataFrame:
    """docs with source, size in words, and size class of about a tenth."""
    df = docs.withColumns({_P + "source": F.col("source").cast("string"), _P + "size": F.size(words_of(F.col("text"))).cast("long")})
    top = F.length(F.bin(_c("size") + 1)) - 1
    # Eight classes between powers of two, in whole numbers.
    return df.withColumn(_P + "class", (8 * top + F.expr(f"shiftright(shiftleft({_P}size + 1, 3), length(bin({_P}size + 1)) - 1)") - 8).cast("int"))


def _number(*parts: Column) -> Column:
    """A repeatable number below 2**60 from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def decided(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with `__mix_size`, `__mix_source_size`, `__mix_target` and `__mix_copies`."""
    df = sized(docs)
    by_source = targets(df, weights)
    per_class = df.groupBy(_P + "source", _P + "class").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias(_P + "parts"))
    order = _number(F.lit(seed), F.col("doc_id").cast("string"), _c("size"))
    per_class = per_class.withColumnsRenamed({_P + "source": _P + "s", _P + "class": _P + "k"})
    df = df.withColumn(_P + "order", order).join(per_class, _c("source").eqNullSafe(_c("s")) & (_c("class") == _c("k")), "left").drop(_P + "s", _P + "k")
    df = df.withColumn(_P + "part", F.pmod(_c("order"), _c("parts")).cast("int"))

    slices = df.groupBy(_P + "source", _P + "class", _P + "part").agg(F.count(F.lit(1)).alias(_P + "rows"))
    along = Window.partitionBy(_P + "source").orderBy(_P + "class", _P + "part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn(_P + "start", F.coalesce(F.sum(_P + "rows").over(along), F.lit(0)))
    rate = F.when(_c("source_size") == 0, F.lit(0)).otherwise(F.least(F.lit(MOST_COPIES * UNIT), F.floor(_c("target") * UNIT / _c("source_size")))).cast("long")
    rates = by_source.withColumns({_P + "rate": rate, _P + "offset": F.pmod(_number(F.lit(seed), F.coalesce(F.concat(F.lit("s"), _c("source")), F.lit(""))), F.lit(UNIT))})
    rates = rates.withColumnRenamed(_P + "source", _P + "s")
    slices = slices.join(rates, _c("source").eqNullSafe(_c("s")), "left").drop(_P + "s", _P + "rows")
    slices = slices.withColumnsRenamed({_P + "source": _P + "s", _P + "class": _P + "k", _P + "part": _P + "p"})

    df = df.join(slices, _c("source").eqNullSafe(_c("s")) & (_c("class") == _c("k")) & (_c("part") == _c("p")), "left")
    inside = Window.partitionBy(_P + "source", _P + "class", _P + "part").orderBy(_P + "order", F.col("doc_id").asc_nulls_last())
    passed = (_c("start") + F.row_number().over(inside)) * _c("rate") + _c("offset")
    df = df.withColumn(_P + "passed", passed)
    return df.withColumn(_P + "copies", (F.shiftright(_c("passed"), 24) - F.shiftright(_c("passed") - _c("rate"), 24)).cast("int"))


def mixed(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix: the rows of docs, each as often as it is taken, with the columns of docs."""
    df = decided(docs, seed, weights).where(_c("copies") > 0)
    df = df.withColumn(_P + "copy", F.explode(F.sequence(F.lit(1), _c("copies"))))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every row."""
    df = decided(docs.select("doc_id", "text", "source"), seed, weights)
    return df.select("doc_id", _c("size").alias("size"), _c("source_size").alias("source_size"), _c("target").alias("target"), (_c("copies") * _c("size")).alias("taken"))
