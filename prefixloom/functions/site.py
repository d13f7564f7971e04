"""Domain rules: keys, suffixes, text of a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefixloom.schema import TYPE_NAMES


def attr_text(a: Column) -> Column:
    """An attribute's value as text: true, false or the number."""
    return F.coalesce(a["i"].cast("string"), F.when(a["b"], "true").otherwise("false"))


def attrs_key(attrs: Column) -> Column:
    """Attributes in any order, with multiplicity; true and 1 differ.  None and empty are alike."""
    each = F.transform(F.coalesce(attrs, F.array().cast("array<struct<k:string,b:boolean,i:bigint>>")), lambda a: F.concat(a["k"], F.lit("\x01"), attr_text(a)))
    return F.array_sort(each)


def rule_key(type_: Column, val: Column, attrs: Column) -> Column:
    return F.struct(type_.alias("type"), val.alias("val"), attrs_key(attrs).alias("attrs"))


def has_key(attrs: Column, key: str | Column) -> Column:
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.exists(attrs, lambda a: a["k"] == k), F.lit(False))


def suffixes(val: Column) -> Column:
    """Strict suffixes that follow a dot; none if the first dot comes first."""
    parts = F.split(val, "[.]", -1)
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(F.instr(val, ".") > 1, tails).otherwise(F.array().cast("array<string>"))


def host_order(val: Column) -> Column:
    return F.array_join(F.reverse(F.split(val, "[.]", -1)), ".")


def type_text(type_: Column) -> Column:
    out = F.concat(F.lit("type"), type_.cast("string"))
    for n, name in TYPE_NAMES.items():
        out = F.when(type_ == n, F.lit(name)).otherwise(out)
    return out


def rule_text(type_: Column, val: Column, attrs: Column) -> Column:
    """type:value @key @key=value"""
    plain = lambda a: F.when(a["i"].isNull() & a["b"], F.lit("")).otherwise(F.concat(F.lit("="), attr_text(a)))
    tail = F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" @"), a["k"], plain(a))), "")
    return F.concat(type_text(type_), F.lit(":"), val, F.coalesce(tail, F.lit("")))
