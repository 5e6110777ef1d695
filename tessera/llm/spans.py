"""Where a pattern matches, as code point spans, with DataFrame functions only.

Spark's regular expression functions return what matched but not where. The pieces between matches
(``split`` with the same pattern) give the rest: a match starts after all pieces and matches before it.
Patterns here are possessive, or anchored at the start of a run by a lookbehind, so that texts of any
length are matched in linear time and without recursion; they match what the plain forms match.

Sums over earlier matches, and the comparison of two lists of spans, are ``running`` values of sorted arrays: linear in
the number of spans of a text (to within a factor of ``BLOCK`` array copies), so that a text may hold any number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Items of an array that are gone through together, and characters of a text that are cut off together.
BLOCK, CHUNK = 256, 256
FARTHEST = 2**31 - 1


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column, kind: str) -> Column:
    """For each value, what ``merge`` makes of ``zero`` and the values before it.

    Accumulated arrays are copied at each step, so values are taken in blocks: first the blocks' totals, then each block by itself.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def grow(items: Column, start: Column) -> Column:
        begin = F.struct(start.alias("now"), none.alias("seen"))
        step = lambda a, x: F.struct(merge(a["now"], x).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen"))
        return F.aggregate(items, begin, step, lambda a: a["seen"])

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda i: F.slice(values, i, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: merge(a, x)))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, grow(totals, zero), grow))).otherwise(none)


def add_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add a column of spans for each ``name: (pattern, gate)``; ``gate`` false means no match, cheaply."""
    keep, names = df.columns, list(patterns)
    found = df.select(
        *keep, *[F.when(gate, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"{n}__found") for n, (p, gate) in patterns.items()]
    )
    # Characters between a match and the one before it.
    gaps = found.select(
        *keep, *[f"{n}__found" for n in names],
        *[F.when(F.size(f"{n}__found") > 0, F.transform(F.split(text, p, -1), lambda piece: F.length(piece))).alias(f"{n}__gaps") for n, (p, _) in patterns.items()],
    )
    lengths = gaps.select("*", *[F.zip_with(f"{n}__found", f"{n}__gaps", lambda value, gap: F.length(value) + gap).alias(f"{n}__lengths") for n in names])
    # There is one piece more than there are matches.
    lengths = lengths.withColumns({f"{n}__lengths": F.slice(f"{n}__lengths", F.lit(1), F.size(f"{n}__found")) for n in names})
    placed = lengths.withColumns({f"{n}__before": running(F.col(f"{n}__lengths"), lambda a, x: a + x, F.lit(0), "int") for n in names})
    return placed.select(*keep, *[_located(n).alias(n) for n in names])


def _located(name: str) -> Column:
    none = F.expr(f"cast(array() as {SPAN})")
    ends = F.zip_with(f"{name}__before", f"{name}__lengths", lambda before, length: before + length)
    spans = F.zip_with(f"{name}__found", ends, lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))
    return F.when(F.size(f"{name}__found") > 0, spans).otherwise(none)


def chunks(text: Column) -> Column:
    """A text in pieces of ``CHUNK`` characters, so that any place of it is reached without going through what is before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(cut: str, start: Column, length: Column) -> Column:
    """``length`` characters, ``CHUNK`` at most, from ``start`` of a text that is cut into ``chunks``."""
    k = (start / CHUNK).cast("int")
    near = F.concat(F.coalesce(F.get(cut, k), F.lit("")), F.coalesce(F.get(cut, k + 1), F.lit("")))
    return F.substring(near, start - k * CHUNK + 1, length)


def written(kind: Column, span: Column) -> Column:
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))


def clear_of(df: DataFrame, spans: str, others: str) -> DataFrame:
    """Keep of the column ``spans`` those that overlap none of ``others``, in order of their starts."""
    own = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), i.alias("at")))
    other = F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), F.lit(-1).alias("at")))
    kept = df.columns
    both = (F.size(spans) > 0) & (F.size(others) > 0)
    df = df.withColumn("__marks", F.when(both, F.array_sort(F.concat(other, own))))
    ends = F.transform("__marks", lambda m: F.when(m["own"] == 0, m["end"]).otherwise(-1))
    starts = F.transform(F.reverse("__marks"), lambda m: F.when(m["own"] == 0, m["start"]).otherwise(FARTHEST))
    df = df.withColumns({"__ends": ends, "__starts": starts}).withColumns({
        "__ends": F.when(both, running(F.col("__ends"), F.greatest, F.lit(-1), "int")),
        "__starts": F.when(both, F.reverse(running(F.col("__starts"), F.least, F.lit(FARTHEST), "int")))})
    judged = F.zip_with(F.arrays_zip("__marks", "__ends"), "__starts", lambda m, start: F.struct(m["__marks"].alias("mark"), (m["__ends"] <= m["__marks"]["start"]).alias("after"), start.alias("next")))
    clear = F.filter(judged, lambda m: (m["mark"]["own"] == 1) & m["after"] & (m["next"] >= m["mark"]["end"]))
    return df.withColumn("__clear", clear).withColumn(
        spans, F.when(both, F.transform("__clear", lambda m: F.get(spans, m["mark"]["at"]))).otherwise(F.col(spans))).select(*kept)


def first_of_overlapping(df: DataFrame, spans: str) -> DataFrame:
    """Keep of the column ``spans`` those that no earlier one (by start, then end) reaches into, in that order."""
    kept = df.columns
    order = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("at"))))
    df = df.withColumn("__order", order)
    df = df.withColumn("__ends", F.transform("__order", lambda m: m["end"]))
    df = df.withColumn("__ends", running(F.col("__ends"), F.greatest, F.lit(-1), "int"))
    clear = F.filter(F.arrays_zip("__order", "__ends"), lambda m: m["__ends"] <= m["__order"]["start"])
    return df.withColumn("__clear", clear).withColumn(spans, F.transform("__clear", lambda m: F.get(spans, m["__order"]["at"]))).select(*kept)
