"""A typed query compiled to a column: the optimiser sees plain predicates, which reach the scan where they can."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions import cidr, patterns

#: Selections besides a rule type or address family.
WITH_ATTRS, INVALID = -2, -3


@dataclass(frozen=True)
class Spec:
    """What a query asks for; equal specs make equal plans."""

    kind: str
    how: str = "all"  # all, regex, prefix, overlap, octets, v6, text
    value: object = None
    type: int | None = None
    fam: int | None = None
    stored: tuple[str, ...] = ()  # columns that the table holds besides an entry's own

    @property
    def active(self) -> bool:
        return self.how != "all" or self.type is not None or bool(self.fam)

    @property
    def signature(self) -> str:
        return "|".join(map(str, (self.active, self.kind, self.how, self.value, self.type, self.fam)))


def parse_query(query: str, kind: str, type_: int | None = None, fam: int | None = None) -> Spec:
    q = query.strip(cidr.TRIM)
    make = lambda how, value=None: Spec(kind, how, value, type_, fam)
    if not q:
        return make("all")
    if len(q) > 2 and q[0] == q[-1] == "/":
        if patterns.fault(q[1:-1]) is None:
            return make("regex", q[1:-1])
    if kind == "geoip":
        if re.fullmatch(r"/[0-9]{1,3}", q):
            return make("prefix", int(q[1:]))
        if q.find("/") > 0:
            got = cidr.parsed(q)
            return make("overlap", got) if got else make("text", q.lower())
        if re.fullmatch(r"[0-9.]+", q):
            return make("octets", q)
        if ":" in q or re.fullmatch(r"[0-9a-fA-F]+", q):
            return make("v6", q.lower())
    return make("text", q.lower())


def _geoip(s: Spec) -> Column:
    fam, pfx, ip = F.col("fam"), F.col("pfx"), F.col("ip")
    valid = cidr.is_valid(fam, pfx)
    out = ~valid if s.fam == INVALID else valid & (fam == s.fam) if s.fam else F.lit(True)
    num = cidr.v4_num(F.when(fam == 4, ip))
    if s.how == "prefix":
        return out & (pfx == s.value)
    if s.how == "overlap":
        family, p, addr = s.value
        if family == 4:
            size = 1 << (32 - p)
            lo = int.from_bytes(addr, "big") // size * size
            own = F.least(pfx, F.lit(32))
            if {"lo", "end"} <= set(s.stored):  # plain comparisons of stored columns, which the scan prunes by
                return out & (fam == 4) & (pfx <= 32) & (F.col("lo") < lo + size) & (F.col("end") > lo)
            return out & (fam == 4) & (pfx <= 32) & (cidr.v4_lo(num, own) < lo + size) & (cidr.v4_end(num, own) > lo)
        lo, end = cidr.v6_bounds(addr, p)
        own = cidr.v6_range(F.when(fam == 6, ip), pfx)
        return out & (fam == 6) & (pfx <= 128) & (own["lo"] < F.lit(end)) & (own["end"] > F.lit(lo))
    if s.how == "octets":
        return out & (fam == 4) & F.coalesce(cidr.octet_prefix(num, s.value), F.lit(False))
    if s.how == "v6":
        return out & (fam == 6) & F.coalesce(F.contains(cidr.v6_text(F.when(fam == 6, ip)), F.lit(s.value)), F.lit(False))
    if s.how == "regex":
        return out & F.rlike(cidr.entry_text(fam, pfx, ip), F.lit(patterns.engine_pattern(s.value)))
    if s.how == "text":
        return out & F.contains(cidr.entry_text(fam, pfx, ip), F.lit(s.value))
    return out


def _geosite(s: Spec) -> Column:
    val = F.col("val")
    out = F.lit(True)
    if s.type == WITH_ATTRS:
        out = F.col("attrs").isNotNull()
    elif s.type is not None and s.type >= 0:
        out = F.col("type") == s.type
    if s.how == "regex":
        return out & F.rlike(val, F.lit(patterns.engine_pattern(s.value)))
    return out & F.contains(F.lower(val), F.lit(s.value)) if s.how == "text" else out


def condition(s: Spec) -> Column:
    return _geoip(s) if s.kind == "geoip" else _geosite(s)


def apply(df: DataFrame, query: str, kind: str, type_: int | None = None, fam: int | None = None) -> DataFrame:
    spec = replace(parse_query(query, kind, type_, fam), stored=tuple(c for c in ("lo", "end") if c in df.columns))
    return df.filter(condition(spec)) if spec.active else df


def visible(categories: DataFrame, filtered: DataFrame, hide_empty: bool = False) -> DataFrame:
    """Categories with how many of their entries are visible."""
    n = filtered.groupBy("file", "cat_ord").agg(F.count(F.lit(1)).alias("visible"))
    out = categories.join(n, ["file", "cat_ord"], "inner" if hide_empty else "left")
    return out.withColumn("visible", F.coalesce("visible", F.lit(0).cast("long")))
