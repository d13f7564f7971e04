"""Folding of domain rules that broader ones cover, and optimisation of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions import cidr, site
from prefixloom.operators import entries, ranges
from prefixloom.schema import DOMAIN, FULL, KEYWORD, REGEXP


def _suffix_rows(df: DataFrame, keys: list[str], val: Column, *more: str) -> DataFrame:
    """A row for every value that would cover the rule: its suffixes, and for `full` itself."""
    own = F.when(F.col("type") == FULL, F.array(val)).otherwise(F.array().cast("array<string>"))
    return df.select(*keys, *more, F.explode(F.array_distinct(F.concat(site.suffixes(val), own))).alias("__d"))


def covered_by_domain(rules: DataFrame, domains: DataFrame, keys: list[str], val: Column, id_cols: list[str]) -> DataFrame:
    """ids of the domain and full rules that a domain of `domains` (keys, __d) covers: one equality join."""
    asked = rules.filter(F.col("attrs").isNull() & F.col("type").isin(DOMAIN, FULL))
    rows = _suffix_rows(asked, keys, val, *(c for c in id_cols if c not in keys))
    return rows.join(domains.distinct(), [*keys, "__d"], "left_semi").select(*id_cols).distinct()


def covered_by_keyword(rules: DataFrame, keywords: DataFrame, keys: list[str], val: Column, id_cols: list[str], same_type: bool = True) -> DataFrame:
    """ids of rules whose value contains a keyword of `keywords` (keys, __w).  A keyword rule doesn't fold an equal one.

    Keywords join on their first three characters with the rules' character triples, so a rule meets the few keywords that
    could be in it; keywords of one or two characters join on the rules' parts of that length, which are made only if there are any.
    """
    words = keywords.distinct().withColumn("__g", F.substring("__w", 1, 3))
    short = {n for (n,) in words.filter(F.length("__w") < 3).select(F.length("__w").alias("n")).distinct().collect()}  # 1 and 2 at most
    at = F.sequence(F.lit(1), F.greatest(F.length(val), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(F.substr(val, i, F.lit(n)) for n in sorted({3, *short}))))))
    rows = rules.select(*keys, *(c for c in id_cols if c not in keys), val.alias("__v"), F.col("type").alias("__t"), F.explode(grams).alias("__g"))
    hit = rows.join(words, [*keys, "__g"]).filter(F.contains("__v", "__w"))
    if same_type:
        hit = hit.filter((F.col("__t") != KEYWORD) | (F.col("__v") != F.col("__w")))
    return hit.select(*id_cols).distinct()


def fold(df: DataFrame, keys: list[str] = entries.SLOT, keyword: bool = False) -> DataFrame:
    """Drop plain keyword, domain and full rules that a plain domain (by suffix) or, if asked, a plain keyword
    (by substring) of the same category covers.  Case matters; rules with attributes, regexps and unknown types stay."""
    plain = df.filter(F.col("attrs").isNull())
    ids = [*keys, "ord"]
    domains = plain.filter(F.col("type") == DOMAIN).select(*keys, F.col("val").alias("__d"))
    gone = covered_by_domain(df, domains, keys, F.col("val"), ids)
    if keyword:
        words = plain.filter((F.col("type") == KEYWORD) & (F.col("val") != "")).select(*keys, F.col("val").alias("__w"))
        asked = plain.filter(F.col("type").isin(KEYWORD, DOMAIN, FULL))
        gone = gone.unionByName(covered_by_keyword(asked, words, keys, F.col("val"), ids)).distinct()
    return df.join(gone, ids, "left_anti")


def missing(have: DataFrame, want: DataFrame, keys: list[str] | None = None, keyword: bool = False) -> DataFrame:
    """Rules of want that have neither holds nor covers.  Coverage ignores case; rules with attributes need an equal one."""
    keys = keys or []
    pad = lambda d: d if keys else d.withColumn("__one", F.lit(1))
    have, want, own = pad(have), pad(want), keys or ["__one"]
    key = entries.key_of("geosite")
    asked = want.withColumn("__k", key).join(have.withColumn("__k", key).select(*own, "__k").distinct(), [*own, "__k"], "left_anti").drop("__k")
    plain = have.filter(F.col("attrs").isNull())
    low, ids = F.lower("val"), [*own, "ord"]
    gone = covered_by_domain(asked, plain.filter(F.col("type") == DOMAIN).select(*own, low.alias("__d")), own, low, ids)
    if keyword:
        words = plain.filter((F.col("type") == KEYWORD) & (F.col("val") != "")).select(*own, low.alias("__w"))
        rules = asked.filter(F.col("attrs").isNull() & (F.col("type") != REGEXP))
        gone = gone.unionByName(covered_by_keyword(rules, words, own, low, ids, same_type=False)).distinct()
    return asked.join(gone, ids, "left_anti").drop("__one")


def optimize(df: DataFrame, kind: str, fold_rules: bool = True, keyword: bool = False, sort: bool = False) -> DataFrame:
    """geoip: minimal blocks, then invalid entries as they were.  geosite: dedupe, fold, and sort by value if asked."""
    if kind == "geoip":
        least = ranges.aggregate(df, entries.SLOT).select(*entries.SLOT, F.lit(0).alias("__g"), F.lit(None).cast("long").alias("ord"), "fam", "pfx", "ip")
        bad = df.filter(~cidr.is_valid(F.col("fam"), F.col("pfx"))).select(*entries.SLOT, F.lit(1).alias("__g"), "ord", "fam", "pfx", "ip")
        both = least.unionByName(bad)
        place = [F.col("__g"), F.col("ord"), F.when(F.col("__g") == 0, F.col("fam")), F.when(F.col("__g") == 0, F.col("ip"))]
        cells = [F.struct(F.col("__g").alias("g"), entries.ord_cell().alias("o"), F.when(F.col("__g") == 0, entries.ip_cell()).alias("i"))]
        return entries.renumbered(both, *place, coarse=cells).select(*entries.SLOT, "ord", "fam", "pfx", "ip")
    out = entries.dedupe(df, kind)
    if fold_rules:
        out = fold(out, keyword=keyword)
    return entries.sort(out, kind) if sort else entries.renumbered(out)
