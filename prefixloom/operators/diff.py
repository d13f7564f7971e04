"""Comparison of two files, entry by entry or by the address space they cover, and applying a difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions import cidr
from prefixloom.operators import entries, fold, ranges


def name_key() -> Column:
    return F.upper("name")


def first_of_name(categories: DataFrame) -> DataFrame:
    """The first category of every upper-cased name, and how often a repeated name occurs (0 if once)."""
    got = categories.groupBy(name_key().alias("key")).agg(
        F.min_by(F.struct("cat_ord", "name", F.coalesce("reverse", F.lit(False)).alias("reverse")), "cat_ord").alias("c"), F.count(F.lit(1)).alias("n")
    )
    return got.select("key", "c.cat_ord", "c.name", "c.reverse", F.when(F.col("n") > 1, F.col("n")).otherwise(0).cast("long").alias("dup"))


def _keyed(df: DataFrame, firsts: DataFrame) -> DataFrame:
    return df.join(firsts.select("cat_ord", "key"), "cat_ord")


def exact_summary(a: DataFrame, b: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Distinct keys only in a, only in b, and in both: one pre-aggregation over the union of both sides."""
    side = lambda d, s: d.select(*keys, entries.key_of(kind).alias("k"), F.lit(s).alias("s"))
    seen = side(a, 1).unionByName(side(b, 2)).groupBy(*keys, "k").agg(F.bit_or("s").alias("s"))
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("s") == 1).alias("onlyA"), F.count_if(F.col("s") == 2).alias("onlyB"), F.count_if(F.col("s") == 3).alias("common")
    )


def segments(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """IPv4 and IPv6 segments with side onlyA, onlyB or common."""
    four = ranges.sweep(ranges.ranges4(a, keys), ranges.ranges4(b, keys), keys)
    return four, ranges.sweep(ranges.ranges6(a, keys), ranges.ranges6(b, keys), keys, v4=False)


def coverage_summary(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The same in minimal blocks of address space; invalid entries don't count."""
    four, six = segments(a, b, keys)
    n4 = four.select(*keys, "side", cidr.block_count(F.col("lo"), F.col("end")).alias("n"))
    n6 = six.select(*keys, "side", cidr.v6_block_count("lo", "end").alias("n"))
    total = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s)
    return n4.unionByName(n6).groupBy(*keys).agg(total("onlyA"), total("onlyB"), total("common"))


def file_diff(a: DataFrame, a_cats: DataFrame, b: DataFrame, b_cats: DataFrame, kind: str, mode: str = "exact") -> DataFrame:
    """One row a name, in order of the upper-cased name: a full outer join of the first category of each name."""
    fa, fb = first_of_name(a_cats), first_of_name(b_cats)
    ka, kb = _keyed(a, fa), _keyed(b, fb)
    unit = "blocks" if mode == "coverage" and kind == "geoip" else "entries"
    summary = coverage_summary(ka, kb, ["key"]) if unit == "blocks" else exact_summary(ka, kb, kind, ["key"])
    side = lambda f, d, s: f.join(d.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").select(
        "key", F.col("name").alias(f"name{s}"), F.col("reverse").alias(f"rev{s}"), F.col("dup").alias(f"dup{s}"), F.coalesce("n", F.lit(0)).cast("long").alias(f"n{s}")
    )
    both = side(fa, ka, "a").join(side(fb, kb, "b"), "key", "full_outer").join(summary, "key", "left")
    in_a, in_b = F.col("namea").isNotNull(), F.col("nameb").isNotNull()
    pair = in_a & in_b
    n = lambda c: F.when(pair, F.coalesce(c, F.lit(0)))
    flipped = F.when(pair, F.col("reva") != F.col("revb")).otherwise(False) if kind == "geoip" else F.lit(False)
    out = both.select(
        "key", F.coalesce("namea", "nameb").alias("name"), F.coalesce("na", F.lit(-1).cast("long")).alias("na"), F.coalesce("nb", F.lit(-1).cast("long")).alias("nb"),
        n("onlyA").when(in_a, F.col("na")).otherwise(0).cast("long").alias("onlyA"), n("onlyB").when(in_b, F.col("nb")).otherwise(0).cast("long").alias("onlyB"),
        n("common").otherwise(0).cast("long").alias("common"), F.coalesce("dupa", F.lit(0)).cast("long").alias("dupA"), F.coalesce("dupb", F.lit(0)).cast("long").alias("dupB"),
        flipped.alias("reverseChanged"), F.when(pair, F.lit(unit)).alias("unit"), pair.alias("__pair"),
    )
    changed = (F.col("onlyA") > 0) | (F.col("onlyB") > 0) | F.col("reverseChanged")
    status = F.when(~F.col("__pair") & (F.col("na") < 0), "added").when(~F.col("__pair"), "removed").when(changed, "changed").otherwise("same")
    return out.withColumn("status", status).orderBy("key").drop("__pair", "key")


def totals(diff: DataFrame) -> DataFrame:
    s = F.col("status")
    return diff.agg(F.count_if(s != "same").alias("changed"), F.count_if(s == "added").alias("added"), F.count_if(s == "removed").alias("removed"))


def table_rows(diff: DataFrame, only_changed: bool = True, limit: int = 3001) -> DataFrame:
    """The rows a comparison shows; the limit is how many it shows at most."""
    rows = diff.filter("status <> 'same'") if only_changed else diff
    return rows.orderBy(F.upper("name")).limit(limit)


def exact_entries(a: DataFrame, b: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """Entries with side onlyA, onlyB or common (spelled as in a), the first of every key: one pre-aggregation over both sides."""
    keys = keys or []
    own = [c for c in a.columns if c not in keys]
    tag = lambda d, s: d.select(*keys, entries.key_of(kind).alias("__k"), "ord", F.struct(*own).alias("__r"), F.lit(s).alias("__s"))
    first = lambda s: F.min_by("__r", F.when(F.col("__s") == s, F.col("ord")))
    met = tag(a, 1).unionByName(tag(b, 2)).groupBy(*keys, "__k").agg(first(1).alias("__a"), first(2).alias("__b"))
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    side = F.when(in_a & in_b, "common").when(in_a, "onlyA").otherwise("onlyB")
    return met.select(*keys, F.coalesce("__a", "__b").alias("__r"), side.alias("side")).select(*keys, "__r.*", "side").select(*a.columns, "side")


def coverage_entries(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Minimal blocks (keys, side, fam, pfx, ip) of the address space only in a, only in b and in both."""
    keys = [*(keys or []), "side"]
    four, six = segments(a, b, keys[:-1])
    p4 = ranges.emit4(four, keys).select(*keys, F.lit(4).cast("byte").alias("fam"), F.col("pfx").cast("short"), cidr.v4_bytes(F.col("num")).alias("ip"))
    return p4.unionByName(ranges.emit6(six, keys).select(*keys, F.lit(6).cast("byte").alias("fam"), "pfx", "ip"))


def listing(diff_entries: DataFrame, which: str = "both") -> DataFrame:
    """Only-A entries, then only-B entries, or one side."""
    sides = {"both": ["onlyA", "onlyB"], "a": ["onlyA"], "b": ["onlyB"]}[which]
    return diff_entries.filter(F.col("side").isin(sides)).orderBy("side", *[c for c in ("ord",) if c in diff_entries.columns])


def in_slot(df: DataFrame, file: str, cat_ord: int, cat: str) -> DataFrame:
    return df.withColumns({"file": F.lit(file), "cat_ord": F.lit(cat_ord), "cat": F.lit(cat)})


def numbered_blocks(blocks: DataFrame, file: str, cat_ord: int, cat: str) -> DataFrame:
    """Blocks as entries of one category: all IPv4, then all IPv6, ascending."""
    rows = in_slot(blocks, file, cat_ord, cat)
    return entries.renumbered(rows, "fam", "ip", coarse=[entries.ip_cell()]).select(*entries.SLOT, "ord", "fam", "pfx", "ip")


def apply_diff(a: DataFrame, b: DataFrame, kind: str, what: str, mode: str, file: str, cat_ord: int, cat: str) -> DataFrame:
    """Category a after adding what only b has ('add'), removing what only a has ('remove'), or both ('both')."""
    if what not in ("add", "remove", "both"):
        raise ValueError(f"unknown change: {what}")
    out = in_slot(a, file, cat_ord, cat)
    b = in_slot(b, file, cat_ord, cat)
    covers = mode == "coverage" and kind == "geoip"
    if what in ("remove", "both"):
        if covers:
            kept = coverage_entries(out, b).filter("side = 'common'").drop("side")
            bad = out.filter(~cidr.is_valid(F.col("fam"), F.col("pfx")))
            out = entries.concat([numbered_blocks(kept, file, cat_ord, cat), bad], file, cat_ord, cat).select(a.columns)
        else:
            key = entries.key_of(kind)
            out = out.withColumn("__k", key).join(b.select(key.alias("__k")).distinct(), "__k", "left_semi").drop("__k")
            out = entries.renumbered(out).select(a.columns)
    if what in ("add", "both"):
        if covers:
            extra = numbered_blocks(coverage_entries(out, b).filter("side = 'onlyB'").drop("side"), file, cat_ord, cat)
            return fold.optimize(entries.concat([out, extra], file, cat_ord, cat), kind).select(a.columns)
        key = entries.key_of(kind)
        extra = b.withColumn("__k", key).join(out.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")
        out = entries.renumbered(entries.dedupe(entries.concat([out, extra], file, cat_ord, cat), kind)).select(a.columns)
    return out
