"""Entries of categories: selection by position, dedupe, concatenation, sorts, statistics.

Tables are the schemas of prefixloom.schema; `kind` is geoip or geosite.  Every operator works on all categories of a table at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.functions import cidr, site
from prefixloom.operators import ranges
from prefixloom.shared import stored

SLOT = ["file", "cat_ord", "cat"]


def key_of(kind: str) -> Column:
    if kind == "geoip":
        return cidr.entry_key(F.col("fam"), F.col("pfx"), F.col("ip"))
    return site.rule_key(F.col("type"), F.col("val"), F.col("attrs"))


CELL_BITS = 16


def ord_cell(col: str = "ord") -> Column:
    """A coarse place that grows with a number: cells of 65,536."""
    return F.shiftright(col, CELL_BITS)


def renumbered(df: DataFrame, *order: Column | str, keys: list[str] = SLOT, coarse: list[Column] | None = None) -> DataFrame:
    """ord counted from 0 per category in the given order.

    coarse: columns that grow with the order, coarsest first, which cut a category into cells: rows are ranked within a cell only,
    and a cell's first number comes from the pre-aggregated sizes of the cells before it, level by level.  So a category of any size
    is many tasks.  As the rows are read for both, they are stored in the shared folder first, which also cuts the plan of a chain of
    edits; where there is no such folder, a category is ranked as one.  Without an order, rows keep the order of ord."""
    if not order:
        order, coarse = ("ord",), coarse or [ord_cell()]
    names = [f"__g{i}" for i in range(len(coarse or []))]
    celled = df.withColumns({n: F.struct(c.alias("v")) for n, c in zip(names, coarse or [], strict=True)})
    table = stored(celled, "cells") if names else None
    if table is None:
        names, table = [], celled
    celled = table
    rank = (F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)) - 1).cast("long")
    out = celled.withColumn("__rank", rank)
    sizes = celled.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n")) if names else None
    place = F.col("__rank")
    while names:
        before = Window.partitionBy(*keys, *names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
        start = f"__start{len(names)}"
        starts = sizes.select(*keys, *names, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
        out = out.join(starts, [*keys, *names])
        place = place + F.col(start)
        names = names[:-1]
        sizes = sizes.groupBy(*keys, *names).agg(F.sum("__n").alias("__n"))
    kept = [F.col(c) for c in df.columns if c != "ord"]
    at = df.columns.index("ord") if "ord" in df.columns else len(kept)
    return out.select(*kept[:at], place.cast("long").alias("ord"), *kept[at:])


def pick(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by (cat_ord, ord), in the index's order of `pos`."""
    got = df.join(index.select("cat_ord", "ord", "pos"), ["cat_ord", "ord"])
    return renumbered(got, "pos", coarse=[ord_cell("pos")]).select(df.columns)


def remove(df: DataFrame, index: DataFrame) -> DataFrame:
    return renumbered(df.join(index.select("cat_ord", "ord"), ["cat_ord", "ord"], "left_anti"))


def dedupe(df: DataFrame, kind: str, keys: list[str] = SLOT) -> DataFrame:
    """Keep the first entry of every normalised key.  The survivor is found by a pre-aggregated minimum, so a key
    with very many rows collapses before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, "ord")]
    first = df.withColumn("__k", key_of(kind)).groupBy(*keys, "__k").agg(F.min_by(F.struct("ord", *rest), "ord").alias("r"))
    return first.select(*keys, "r.*").select(df.columns)


def concat(tables: list[DataFrame], file: str, cat_ord: int, cat: str) -> DataFrame:
    """One category with all entries of the given ones in order."""
    tagged = [t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, tagged)
    rows = rows.withColumns({"file": F.lit(file), "__c": F.col("cat_ord"), "cat_ord": F.lit(cat_ord), "cat": F.lit(cat)})
    return renumbered(rows, "__t", "__c", "ord", coarse=[F.struct("__t", "__c", ord_cell().alias("o"))]).drop("__t", "__c")


def reverse_clash(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """Per file: do the geoip categories that have entries disagree on reverse?  counts: file, cat_ord, n."""
    some = categories.filter("kind = 'geoip'").join(counts.filter("n > 0"), ["file", "cat_ord"])
    return some.groupBy("file").agg((F.min("reverse") != F.max("reverse")).alias("clash"))


def reverse_of(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """Per file: reverse of the first category with entries, else of the first."""
    all_ = categories.join(counts, ["file", "cat_ord"], "left")
    first = F.min_by("reverse", F.struct(F.coalesce(F.col("n"), F.lit(0)) == 0, F.col("cat_ord")))
    return all_.groupBy("file").agg(F.coalesce(first, F.lit(False)).alias("reverse"))


def sort_order(kind: str, how: str = "value") -> list[Column]:
    """Order of a category: geoip by family, unmasked address, prefix; geosite by value, type or reversed host."""
    if kind == "geoip":
        return [F.col("fam"), F.when(F.col("fam") == 0, F.lit(b"")).otherwise(F.col("ip")), F.col("pfx"), F.col("ord")]
    val, type_ = F.col("val"), F.col("type")
    return {"value": [val, type_], "type": [type_, val], "host": [site.host_order(val), type_]}[how] + [F.col("ord")]


def ip_cell() -> Column:
    """Family and the leading bytes of an address: a coarse place in the order of blocks."""
    lead = F.when(F.col("fam") == 4, F.substring("ip", 1, 2)).when(F.col("fam") == 6, F.substring("ip", 1, 4))
    return F.struct(F.col("fam").alias("f"), lead.alias("l"))


def sort_cells(kind: str, how: str = "value") -> list[Column]:
    """Coarse places in the order that sort_order() gives."""
    if kind == "geoip":
        return [ip_cell()]
    val = {"value": F.col("val"), "type": F.col("val"), "host": site.host_order(F.col("val"))}[how]
    first = [F.col("type")] if how == "type" else []
    return [*first, F.substring(val, 1, 3), F.substring(val, 1, 8)]


def sort(df: DataFrame, kind: str, how: str = "value") -> DataFrame:
    return renumbered(df, *sort_order(kind, how), coarse=sort_cells(kind, how))


def page(df: DataFrame, start: int, rows: int) -> DataFrame:
    """A window of rows in file order: the global row number is a category's offset plus ord, which counts from 0 in every
    category, as all operators leave it.  Only the categories' sizes are aggregated; rows are filtered where they lie."""
    sizes = df.groupBy("file", "cat_ord").count()
    before = Window.partitionBy("file").orderBy("cat_ord").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("count").over(before), F.lit(0)))
    offsets = offsets.filter((F.col("__o") < start + rows) & (F.col("__o") + F.col("count") > start)).drop("count")
    placed = df.join(offsets, ["file", "cat_ord"]).withColumn("row", F.col("__o") + F.col("ord")).drop("__o")
    return placed.filter((F.col("row") >= start) & (F.col("row") < start + rows))


def between(df: DataFrame, start: int, end: int, shown: DataFrame | None = None) -> DataFrame:
    """Index (cat_ord, ord, pos) of the rows from row number start to end, both among them, in either direction; of `shown` rows
    (file, cat_ord, ord) only, if given."""
    lo, hi = min(start, end), max(start, end)
    got = page(df, lo, hi - lo + 1)
    if shown is not None:
        got = got.join(shown.select("file", "cat_ord", "ord"), ["file", "cat_ord", "ord"], "left_semi")
    return got.select("cat_ord", "ord", F.col("row").alias("pos"))


def counts(df: DataFrame, kind: str) -> DataFrame:
    """Per file: entries, and those that are not routable (bad; 0 for rules)."""
    bad = F.count_if(~cidr.is_valid(F.col("fam"), F.col("pfx"))) if kind == "geoip" else F.lit(0).cast("long")
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), bad.alias("bad"))


def quick_stats(df: DataFrame, kind: str, keys: list[str] = SLOT) -> DataFrame:
    if kind == "geoip":
        valid = cidr.is_valid(F.col("fam"), F.col("pfx"))
        return df.groupBy(*keys).agg(
            F.count_if(valid & (F.col("fam") == 4)).alias("v4"), F.count_if(valid & (F.col("fam") == 6)).alias("v6"), F.count_if(~valid).alias("bad")
        )
    t = F.col("type")
    named = [F.count_if(t == n).alias(name) for n, name in enumerate(("keyword", "regexp", "domain", "full"))]
    return df.groupBy(*keys).agg(*named, F.count_if(F.col("attrs").isNotNull()).alias("with_attr"), F.count_if(t > 3).alias("unknown"))


def stats(df: DataFrame, kind: str, keys: list[str] = SLOT) -> DataFrame:
    """quick_stats and, for geoip, merged ranges, IPv4 addresses and the least number of blocks."""
    quick = quick_stats(df, kind, keys)
    if kind == "geosite":
        return quick
    four = ranges.merge_ranges(ranges.ranges4(df, keys), keys)
    four = four.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ranges4"), ranges.address_count(F.col("lo"), F.col("end")).alias("addrs4"),
        F.sum(cidr.block_count(F.col("lo"), F.col("end"))).alias("__b4"),
    )
    six = ranges.merge_ranges(ranges.ranges6(df, keys), keys, v4=False).withColumn("__n", cidr.v6_block_count("lo", "end"))
    six = six.groupBy(*keys).agg(F.count(F.lit(1)).alias("ranges6"), F.sum("__n").alias("__b6"))
    out = quick.join(four, keys, "left").join(six, keys, "left").na.fill(0, ["ranges4", "addrs4", "__b4", "ranges6", "__b6"])
    return out.withColumn("optimal", F.col("__b4") + F.col("__b6")).drop("__b4", "__b6")
