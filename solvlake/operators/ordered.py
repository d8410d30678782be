"""Scans in order within groups of any size.

A window takes a whole group into one task. Here groups of more than `most` rows are cut along the order
into parts of about that many rows: a window scans each part, and what the parts before it add up to (a
row a part, found by an aggregate) is carried in. Rows with equal values share a part, and all results
are those of a plain window, whatever the cuts are.

The borders of parts are approximate quantiles. They come to the driver, one number for each `most` rows
of large groups, so that every use of them sees the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task scans.
MOST = 1 << 20
#: Parts of a group: as many borders are compared with each of its rows.
MOST_PARTS = 4096
PART = "_part"


@dataclass
class Parted:
    """Rows with the number of their part. cut: whether any group has more than one."""

    rows: DataFrame
    keys: list[str]
    by: str
    cut: bool

    def window(self, *order: Column | str):
        return Window.partitionBy(*self.keys, PART).orderBy(*order)

    def before(self, descending: bool = False, **sums: Column) -> DataFrame:
        """For every part of a group that is cut: what the aggregates are, as arrays with one value for each
        part before it (after it, if descending). As many rows as there are parts."""
        each = self.rows.groupBy(*self.keys, PART).agg(*[c.alias(n) for n, c in sums.items()])
        order = F.desc(PART) if descending else F.col(PART)
        ahead = Window.partitionBy(*self.keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        told = each.select(*self.keys, PART, *[F.collect_list(F.struct(F.col(n).alias("v"))).over(ahead).alias(n) for n in sums])
        return told.filter(F.size(next(iter(sums))) > 0)

    def with_carry(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """rows with the columns of before()."""
        names = [*self.keys, PART]
        right = F.broadcast(carry.withColumnsRenamed({c: f"{c}_" for c in names}))  # a row a part
        return rows.join(right, same(rows, right, names, names, "_"), "left").drop(*[f"{c}_" for c in names])


def same(left: DataFrame, right: DataFrame, ours: list[str], theirs: list[str], suffix: str = "") -> Column:
    """Null-safe equality of columns."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[f"{b}{suffix}"]) for a, b in zip(ours, theirs, strict=True)], F.lit(True))


def parted(df: DataFrame, keys: list[str], by: str, most: int = MOST, counted: DataFrame | None = None) -> Parted:
    """df with its parts; `by` is a number, and NULL comes before all others. counted: rows by whose number the groups are
    told to be large, where that is less work than counting df's."""
    large = (df if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    found = large.collect()  # a row for each `most` rows of df at most
    if not found:
        return Parted(df.withColumn(PART, F.lit(0)), keys, by, False)
    parts = min(MOST_PARTS, 1 + max(r["_n"] for r in found) // most)
    some = df
    if keys:
        names = F.broadcast(df.sparkSession.createDataFrame([r[:-1] for r in found], large.drop("_n").schema))
        some = df.join(names, same(df, names, keys, keys), "left_semi")
    fractions = [k / parts for k in range(1, parts)]
    value = F.col(by).cast("double")
    borders = some.groupBy(*keys).agg(F.percentile_approx(value, fractions, 20 * parts).alias("_borders"))
    told = borders.collect()  # a number for each `most` rows
    fixed = F.broadcast(df.sparkSession.createDataFrame(told, borders.schema).withColumnsRenamed({k: f"{k}_" for k in keys}))
    joined = df.join(fixed, same(df, fixed, keys, keys, "_"), "left") if keys else df.crossJoin(fixed)  # without keys: one row of borders
    part = F.coalesce(F.size(F.filter("_borders", lambda b: b < value)), F.lit(0))
    return Parted(joined.withColumn(PART, part).drop("_borders", *[f"{k}_" for k in keys]), keys, by, True)


def running(at: Parted, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """The rows with the sum of value over the rows of their group up to them."""
    local = at.rows.withColumn(name, F.sum(value).over(at.window(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not at.cut:
        return local
    told = at.with_carry(local, at.before(_ahead=F.sum(value)))
    ahead = F.aggregate("_ahead", F.lit(0).cast(local.schema[name].dataType), lambda a, x: a + F.coalesce(x["v"], F.lit(0)).cast(local.schema[name].dataType))
    return told.withColumn(name, F.col(name) + F.coalesce(ahead, F.lit(0))).drop("_ahead")


def latest(at: Parted, order: list[Column | str], value: Column, name: str, descending: bool = False) -> DataFrame:
    """The rows with the last value that is not NULL among the rows of their group up to them. value is a
    struct that begins with `by` and `order` begins with `by`, so that the last of a part is its largest (its least, if
    descending: the scan then runs from the end)."""
    local = at.rows.withColumn(name, F.last(value, ignorenulls=True).over(at.window(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not at.cut:
        return local
    told = at.with_carry(local, at.before(descending, _ahead=(F.min if descending else F.max)(value)))
    values = F.filter(F.transform("_ahead", lambda x: x["v"]), lambda x: x.isNotNull())
    carried = F.array_min(values) if descending else F.array_max(values)
    return told.withColumn(name, F.coalesce(name, carried)).drop("_ahead")


def islands(at: Parted, order: list[Column | str], gap: float, name: str) -> DataFrame:
    """The rows with the number, from 0, of their island: a new one begins where the next value of `by` in the order,
    which begins with it, is more than gap away."""
    value, w = F.col(at.by), at.window(*order)
    local = at.rows.withColumn("_new", F.when(value - F.lag(value).over(w) > gap, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w))
    if not at.cut:
        return local.drop("_new")
    # a row a part: its islands, and whether its first row begins one
    parts = local.groupBy(*at.keys, PART).agg(F.sum("_new").alias("_k"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    ahead = Window.partitionBy(*at.keys).orderBy(PART)
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_first", F.when(F.col("_low") - F.last("_high", ignorenulls=True).over(earlier) > gap, 1).otherwise(0))
    carry = parts.select(*at.keys, PART, (F.coalesce(F.sum(F.col("_k") + F.col("_first")).over(earlier), F.lit(0)) + F.col("_first")).alias("_ahead"))
    return at.with_carry(local, carry).withColumn(name, F.col(name) + F.coalesce("_ahead", F.lit(0))).drop("_new", "_ahead")


def medians(rows: DataFrame, keys: list[str], columns: dict[str, Column], most: int = MOST) -> DataFrame:
    """keys and the exact median of each column. Groups of at most `most` rows by an aggregate; of larger ones the
    parts that hold the middle ranks are found by their counts, and the middle values in those parts alone."""
    named = rows.select(*keys, *[c.cast("double").alias(n) for n, c in columns.items()])
    sizes = named.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    found = sizes.collect()  # a row for each `most` rows of the table at most
    plain = lambda df: df.groupBy(*keys).agg(*[F.median(n).alias(n) for n in columns])
    if not found:
        return plain(named)
    if not keys:
        each = [_median(named, keys, n, most) for n in columns]
        return reduce(DataFrame.crossJoin, each)  # one row each
    large = F.broadcast(named.sparkSession.createDataFrame([r[:-1] for r in found], sizes.drop("_n").schema).withColumnsRenamed({k: f"{k}_" for k in keys}))
    big, small = (named.join(large, same(named, large, keys, keys, "_"), how) for how in ("left_semi", "left_anti"))
    told = big.select(*keys).distinct()
    for n in columns:
        right = _median(big, keys, n, most).withColumnsRenamed({k: f"{k}_" for k in keys})
        told = told.join(F.broadcast(right), same(told, right, keys, keys, "_"), "left").drop(*[f"{k}_" for k in keys])  # large groups only
    return plain(small).unionByName(told)


def _median(rows: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """keys and the median of a column, by the ranks of its values."""
    at = parted(rows.select(*keys, column).filter(F.col(column).isNotNull()), keys, column, most)
    parts = at.rows.groupBy(*keys, PART).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumn("_before", before).withColumn("_all", F.sum("_n").over(whole))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # ranks from 1
    holds = lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_n"))
    wanted = ranked.filter(holds(low) | holds(high)).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col(PART).alias("_p"), "_before", low.alias("_low"), high.alias("_high"))
    wanted = F.broadcast(wanted)  # two parts a group at most
    here = at.rows.join(wanted, same(at.rows, wanted, keys, keys, "_") & (at.rows[PART] == wanted["_p"])).drop(*[f"{k}_" for k in keys])
    # ties are one row, so that a part of one value is no work
    counts = here.groupBy(*keys, PART, column, "_before", "_low", "_high").agg(F.count("*").alias("_n"))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, PART).orderBy(column))
    told = counts.withColumn("_end", end)
    hit = lambda r: F.max(F.when((F.col(r) <= F.col("_end")) & (F.col(r) > F.col("_end") - F.col("_n")), F.col(column)))
    return told.groupBy(*keys).agg((0.5 * hit("_low") + 0.5 * hit("_high")).alias(column))
