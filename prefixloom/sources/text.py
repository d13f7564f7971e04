"""Text form: one rule or block a line, comments, attributes, `include:` lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prefixloom.functions import cidr, patterns, site
from prefixloom.operators import entries
from prefixloom.schema import TYPE_NUMBERS

#: White space of the text form, for regular expressions.
SPACE = r"[ \t\n\x0B\f\r   -     　﻿]"
MOST_ERRORS = 5000
NO_VALUE = "empty value"
NO_BLOCK = "not an IP or CIDR"
REFERENCE = "a reference (geosite:, ext:) points to another file and has no place in a rule category"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text), lines counted from 1, cut at CRLF, CR or LF."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return lines(whole, ["file"], F.col("text"))


def lines(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    cut = df.select(*keys, F.posexplode(F.split(text, "\r\n|\r|\n", -1)).alias("line", "text"))
    return cut.withColumn("line", F.col("line") + 1)


def stripped(text: Column) -> Column:
    """Without a comment, which `#` or `//` open anywhere, and trimmed."""
    cut = F.substring_index(F.substring_index(text, "#", 1), "//", 1)
    return F.btrim(cut, F.lit(cidr.TRIM))


def parse_lines(lines_df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    return parse_rules(lines_df, keys) if kind == "geosite" else parse_blocks(lines_df, keys)


def _attrs(tokens: Column) -> Column:
    """@k, @k=number (leading digits; true if there are none); a bare @ says nothing."""
    bodies = F.filter(F.transform(tokens, lambda t: F.substring(t, 2, 1 << 30)), lambda b: b != "")
    number = lambda b: F.regexp_extract(b, r"^[^=]+=\s*([+-]?\d+)", 1)
    one = lambda b: F.struct(
        F.when(F.instr(b, "=") > 1, F.substring_index(b, "=", 1)).otherwise(b).alias("k"),
        F.when((F.instr(b, "=") <= 1) | (number(b) == ""), F.lit(True)).alias("b"),
        F.when(F.instr(b, "=") > 1, number(b).try_cast("long")).alias("i"),
    )
    out = F.transform(bodies, one)
    return F.when(F.size(out) > 0, out)


@F.pandas_udf(StringType())
def regexp_fault(val: pd.Series) -> pd.Series:
    """Why a pattern isn't valid, null if it is."""
    return val.map(lambda v: None if v is None else patterns.fault(v))


def _number_fault(tokens: Column) -> Column:
    """The first attribute whose number doesn't fit 64 bits."""
    digits = lambda t: F.regexp_extract(t, r"^@[^=]+=\s*([+-]?\d+)", 1)
    bad = F.filter(tokens, lambda t: (digits(t) != "") & digits(t).try_cast("long").isNull())
    return F.when(F.size(bad) > 0, F.concat(F.lit("number out of range: "), F.get(bad, F.lit(0))))


def parse_rules(lines_df: DataFrame, keys: list[str]) -> DataFrame:
    """Per significant line: keys, line, text, error, include, type, val, attrs; exactly one of error, include and val is set."""
    raw = lines_df.withColumn("__s", stripped(F.col("text"))).filter("__s <> ''")
    parts = raw.withColumn("__p", F.split("__s", f"{SPACE}+"))
    head, rest = F.element_at("__p", 1), F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0)))
    odd = F.filter(rest, lambda t: ~F.startswith(t, F.lit("@")))
    colon = F.instr(head, ":")
    pre = F.when(colon > 1, F.lower(F.substring_index(head, ":", 1))).otherwise("")
    tail = F.expr("substring(element_at(__p, 1), instr(element_at(__p, 1), ':') + 1)")
    number = F.regexp_extract(pre, r"^type(\d{1,3})$", 1).try_cast("int")
    known = F.lit(None).cast("int")
    for name, n in TYPE_NUMBERS.items():
        known = F.when(pre == name, F.lit(n)).otherwise(known)
    type_ = F.coalesce(known, F.when(number < 256, number))
    named = type_.isNotNull()
    val = F.when(named, tail).otherwise(head)
    bad_token = F.size(odd) > 0
    is_include = ~bad_token & (pre == "include") & _number_fault(rest).isNull()
    typed = F.coalesce(type_, F.lit(2)).cast("short")
    got = parts.select(
        *keys, "line", "text", F.when(bad_token, F.concat(F.lit('unexpected token "'), F.element_at(odd, 1), F.lit('"')))
        .when(pre.isin("geosite", "ext"), REFERENCE).when((pre != "include") & (val == ""), NO_VALUE).otherwise(_number_fault(rest)).alias("error"),
        F.when(is_include, tail).alias("include"), typed.alias("type"), val.alias("val"), _attrs(rest).alias("attrs"),
    )
    fault = regexp_fault(F.when((F.col("type") == 1) & F.col("error").isNull() & F.col("include").isNull(), F.col("val")))
    got = got.withColumn("error", F.coalesce("error", F.concat(F.lit("invalid regexp: "), fault)))
    keep = F.col("error").isNull() & F.col("include").isNull()
    return got.withColumns({"type": F.when(keep, F.col("type")), "val": F.when(keep, F.col("val"))})


def parse_blocks(lines_df: DataFrame, keys: list[str]) -> DataFrame:
    """Per significant line: keys, line, text, error, include, fam, pfx, ip.  A line that opens with a separator is skipped."""
    raw = lines_df.withColumn("__s", stripped(F.col("text"))).filter("__s <> ''")
    include = F.lower(F.substring("__s", 1, 8)) == "include:"
    words = F.split("__s", f"{SPACE}+")
    second = F.when(F.size(words) > 1, F.get(words, F.lit(1)))
    token = F.element_at(F.split("__s", f"(?:{SPACE}|[,;])+"), 1)
    raw = raw.withColumn("__t", F.when(~include, token)).filter("__t is null or __t <> ''")
    got = raw.withColumn("__4", cidr.parse_v4(F.col("__t")))
    # the Arrow parser sees a token only where the columns' parser found no IPv4 block
    other = cidr.parse_cidr(F.when(F.col("__4").isNull() & F.contains("__t", F.lit(":")), F.col("__t")))
    four = F.struct(F.lit(4).cast("byte").alias("fam"), F.col("__4.pfx").cast("short").alias("pfx"), cidr.v4_bytes(F.col("__4.num")).alias("ip"))
    got = got.withColumn("__c", F.when(F.col("__4").isNotNull(), four).otherwise(other))
    error = (
        F.when(include & F.startswith(second, F.lit("@")), "an include of blocks can't ask for @attributes")
        .when(include & second.isNotNull(), F.concat(F.lit('unexpected token "'), second, F.lit('"')))
        .when(~include & F.col("__c.fam").isNull(), NO_BLOCK)
    )
    name = F.when(include & second.isNull(), F.substring("__s", 9, 1 << 30))
    return got.select(*keys, "line", "text", error.alias("error"), name.alias("include"), F.col("__c.fam").alias("fam"), F.col("__c.pfx").alias("pfx"), F.col("__c.ip").alias("ip"), F.lit(None).cast("array<struct<k:string,b:boolean,i:bigint>>").alias("attrs"))


def errors(parsed: DataFrame, order: list[str], limit: int = MOST_ERRORS) -> DataFrame:
    """Line errors in order, at most `limit` of them."""
    return parsed.filter("error is not null").select(*order, "text", F.col("error").alias("msg")).orderBy(*order).limit(limit)


def expand_includes(parsed: DataFrame, entries_df: DataFrame, categories: DataFrame, kind: str, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put the entries of included categories (first of a name, any case) in the place of `include:` lines.

    Returns (entries with keys and ord, errors, includes: keys, line, name, n).  Wanted attributes must all be there,
    excluded ones (`@-k`) must not; reverse categories are refused.
    """
    own_cols = ["fam", "pfx", "ip"] if kind == "geoip" else ["type", "val", "attrs"]
    by_name = categories.groupBy(F.upper("name").alias("__n")).agg(F.min_by(F.struct("cat_ord", "name", "reverse"), "cat_ord").alias("__c"))
    asked = parsed.filter("include is not null").withColumn("__n", F.upper("include")).join(by_name, "__n", "left")
    fault = (
        F.when(F.col("include") == "", "include: without a name")
        .when(F.col("__c").isNull(), F.concat(F.lit("include of an unknown category: "), F.col("include")))
        .when(F.coalesce(F.col("__c.reverse"), F.lit(False)), F.concat(F.lit("include of a reverse category: "), F.col("__c.name")))
    )
    asked = asked.withColumn("msg", fault)
    good = asked.filter("msg is null").select(*keys, "line", F.col("__c.cat_ord").alias("cat_ord"), F.col("__c.name").alias("name"), F.col("attrs").alias("__want"))
    rows = good.join(entries_df.select("cat_ord", F.col("ord").alias("__src"), *own_cols), "cat_ord")
    if kind == "geosite":
        names = F.transform(F.coalesce("__want", F.array().cast("array<struct<k:string,b:boolean,i:bigint>>")), lambda a: a["k"])
        wanted = F.filter(names, lambda k: ~F.startswith(k, F.lit("-")))
        unwanted = F.transform(F.filter(names, lambda k: F.startswith(k, F.lit("-")) & (F.length(k) > 1)), lambda k: F.substring(k, 2, 1 << 30))
        rows = rows.filter(F.forall(wanted, lambda k: site.has_key(F.col("attrs"), k)) & ~F.exists(unwanted, lambda k: site.has_key(F.col("attrs"), k)))
    n = rows.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"))
    includes = good.select(*keys, "line", "name").join(n, [*keys, "line"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    plain = parsed.filter("include is null and error is null").select(*keys, "line", F.lit(0).cast("long").alias("__src"), *own_cols)
    woven = plain.unionByName(rows.select(*keys, "line", "__src", *own_cols))
    cells = [F.shiftright("line", 12), F.struct("line", entries.ord_cell("__src").alias("s"))]
    woven = entries.renumbered(woven, "line", "__src", keys=keys, coarse=cells)
    faults = errors(parsed, [*keys, "line"]).unionByName(asked.filter("msg is not null").select(*keys, "line", "text", "msg"))
    return woven.drop("line", "__src"), faults, includes


def _kind(tokens: list[str]) -> str | None:
    """geoip or geosite, by the first tokens of significant lines; ties are geoip, none is None."""
    ip = sum(cidr.parsed(t) is not None for t in tokens)
    return None if not tokens else "geoip" if ip >= len(tokens) - ip else "geosite"


def sniff(lines_df: DataFrame) -> str | None:
    """Kind of a text by at most 40 significant lines."""
    raw = lines_df.withColumn("__s", stripped(F.col("text"))).filter("__s <> '' and lower(substring(__s, 1, 8)) <> 'include:'")
    head = raw.orderBy("line").limit(40).select(F.element_at(F.split("__s", f"{SPACE}+"), 1).alias("t")).collect()
    return _kind([r["t"] for r in head])


def sniff_text(body: str) -> str | None:
    """sniff() of a text that the driver holds."""
    cut = (x.split("#", 1)[0].split("//", 1)[0].strip(cidr.TRIM) for x in re.split("\r\n|\r|\n", body))
    return _kind([re.split(f"[{cidr.TRIM}]+", x)[0] for x in cut if x and x[:8].lower() != "include:"][:40])


def mentioned(body: str) -> dict[str, str]:
    """Names in the include lines of a text that the driver holds: in upper case, with the first spelling."""
    out: dict[str, str] = {}
    for m in re.findall(f"(?im)^[{cidr.TRIM}]*include:([^{cidr.TRIM}#]+)", body.replace("\r", "\n")):
        out.setdefault(m.split("//")[0].upper(), m.split("//")[0])
    return out


def sniff_bytes(name: str, raw: bytes) -> bool:
    """Is a file text?  By its ending, or by its first bytes where it has none."""
    ending = name.rpartition(".")[2].lower() if "." in name else ""
    if ending:
        return ending in ("txt", "list", "csv", "conf")
    from prefixloom.sources.routedat import sniff as sniff_dat

    return not any(b < 9 for b in raw[:4096]) and sniff_dat(raw) is None


def entry_lines(df: DataFrame, kind: str) -> DataFrame:
    """df with `line`, the entry's text."""
    text = cidr.entry_text(F.col("fam"), F.col("pfx"), F.col("ip")) if kind == "geoip" else site.rule_text(F.col("type"), F.col("val"), F.col("attrs"))
    return df.withColumn("line", text)


def text_lines(df: DataFrame, kind: str, headed: bool = False) -> DataFrame:
    """The lines that write_text() writes, as (cat_ord, o, value) to be ordered by cat_ord and o."""
    rows = entry_lines(df, kind).select("cat_ord", F.col("ord").alias("o"), F.col("line").alias("value"))
    if headed:
        sizes = df.groupBy("cat_ord", "cat").count()
        title = F.concat(F.lit("# "), F.col("cat"), F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
        first = sizes.agg(F.min("cat_ord").alias("__first"))  # one row
        rows = rows.unionByName(sizes.select("cat_ord", F.lit(-1).cast("long").alias("o"), title.alias("value")))
        blank = sizes.join(F.broadcast(first), F.col("cat_ord") != F.col("__first"))
        rows = rows.unionByName(blank.select("cat_ord", F.lit(-2).cast("long").alias("o"), F.lit("").alias("value")))
    return rows


def write_text(df: DataFrame, kind: str, path: str, headed: bool = False) -> None:
    """Lines in file order, sorted by range over tasks; with headers, `# NAME (n)` and a blank line between categories."""
    rows = text_lines(df, kind, headed)
    rows.repartitionByRange("cat_ord", "o").sortWithinPartitions("cat_ord", "o").select("value").write.mode("overwrite").text(path)


def write_diff(diff_entries: DataFrame, kind: str, path: str, title: str) -> None:
    """The title, then only-A entries marked `-`, then only-B entries marked `+`, each in order."""
    rows = diff_lines(diff_entries, kind)
    side = F.when(F.col("side") == "onlyA", 0).otherwise(1)
    order = [F.col("ord")] if "ord" in rows.columns else [F.col("fam"), F.col("ip"), F.col("pfx")]
    rows = rows.select(side.alias("s"), F.struct(*order).alias("o"), F.col("line").alias("value"))
    # the title is the first line of the first range's file, whatever that range is
    ranged = rows.repartitionByRange("s", "o").sortWithinPartitions("s", "o").select("value")
    head = rows.sparkSession.createDataFrame([(title,)], "value string").coalesce(1)
    head.unionAll(ranged).write.mode("overwrite").text(path)


def diff_title(cat: str, a: str, b: str, mode: str) -> str:
    return f"# {cat}: {a} vs {b} ({mode})"


def diff_lines(entries_df: DataFrame, kind: str) -> DataFrame:
    """Only-A entries marked `-`, then only-B entries marked `+`."""
    mark = F.when(F.col("side") == "onlyA", "-").otherwise("+")
    return entry_lines(entries_df.filter("side <> 'common'"), kind).withColumn("line", F.concat(mark, F.col("line")))


def file_name(cat: str) -> str:
    return re.sub(r"[^a-z0-9._-]+", "-", cat.lower()) + ".txt"
