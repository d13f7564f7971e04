"""Query catalog: name -> query over the driver's tables, and name -> the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.functions import cidr, site
from prefixloom.operators import diff, entries, filters, fold, ranges
from prefixloom.plans import views
from prefixloom.plans.database import Database, Version
from prefixloom.plans.views import IP4, IP6, SITE
from prefixloom.sources import routedat, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _islands(source: str, keys: str, name: str) -> str:
    """SQL of merged ranges of `source` (keys, lo, hi), as CTEs ending in `name`."""
    return f"""{name}_f AS (SELECT {keys}, lo, max(hi) AS hi FROM {source} GROUP BY {keys}, lo),
{name}_o AS (SELECT *, max(hi) OVER (PARTITION BY {keys} ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_f),
{name}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY lo) AS g FROM {name}_o),
{name} AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi FROM {name}_g GROUP BY {keys}, g)"""


def _sweep(source: str, keys: str, name: str) -> str:
    """SQL of segments of `source` (keys, side 0 or 1, lo, hi) by label, merged, as CTEs ending in `name` (keys, label, lo, hi)."""
    return f"""{name}_e AS (SELECT {keys}, lo AS x, CASE WHEN side = 0 THEN 1 ELSE 0 END AS a, CASE WHEN side = 1 THEN 1 ELSE 0 END AS b FROM {source}
  UNION ALL SELECT {keys}, hi, CASE WHEN side = 0 THEN -1 ELSE 0 END, CASE WHEN side = 1 THEN -1 ELSE 0 END FROM {source}),
{name}_p AS (SELECT {keys}, x, sum(a) AS a, sum(b) AS b FROM {name}_e GROUP BY {keys}, x),
{name}_l AS (SELECT {keys}, x AS lo, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS hi, sum(a) OVER (PARTITION BY {keys} ORDER BY x) AS a,
  sum(b) OVER (PARTITION BY {keys} ORDER BY x) AS b FROM {name}_p),
{name}_s AS (SELECT {keys}, CASE WHEN a > 0 AND b > 0 THEN 'common' WHEN a > 0 THEN 'onlyA' ELSE 'onlyB' END AS label, lo, hi
  FROM {name}_l WHERE hi IS NOT NULL AND (a > 0 OR b > 0)),
{_islands(f"{name}_s", f"{keys}, label", name)}"""


def _split(source: str, keys: str, name: str) -> str:
    """SQL of the closed form: middle, left and right reach of every range."""
    return f"""{name} AS (SELECT {keys}, lo, hi, m - lo AS l, hi - m AS r, m FROM (
  SELECT *, (hi >> (length(bin(xor(lo, hi))) - 1)) << (length(bin(xor(lo, hi))) - 1) AS m FROM {source}))"""


def _blocks(source: str, keys: str) -> str:
    return f"""SELECT {keys}, lo + (l & ((1::BIGINT << i) - 1)) AS num, CAST(32 - i AS INTEGER) AS pfx
  FROM {source}, (SELECT unnest(range(0, 33)) AS i) WHERE (l >> i) & 1 = 1
UNION ALL SELECT {keys}, m + ((r >> (i + 1)) << (i + 1)), CAST(32 - i AS INTEGER)
  FROM {source}, (SELECT unnest(range(0, 33)) AS i) WHERE (r >> i) & 1 = 1"""


SUMMARY_SQL = """SELECT cat, CAST(sum(CASE WHEN label = 'onlyA' THEN n ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN label = 'onlyB' THEN n ELSE 0 END) AS BIGINT) AS only_b,
  CAST(sum(CASE WHEN label = 'common' THEN n ELSE 0 END) AS BIGINT) AS common FROM n GROUP BY cat"""
MERGED = f"{IP4}, {_islands('r4', 'cat', 'merged')}"
SWEPT = f"{IP4}, {_sweep('r4', 'cat', 'swept')}"
DOTTED = "CAST(({0} >> 24) & 255 AS VARCHAR) || '.' || CAST(({0} >> 16) & 255 AS VARCHAR) || '.' || CAST(({0} >> 8) & 255 AS VARCHAR) || '.' || CAST({0} & 255 AS VARCHAR)"


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("side = 0").drop("side"), df.filter("side = 1").drop("side")


# interval algebra


@query(f"WITH {MERGED} SELECT cat, lo, hi FROM merged")
def merge_ranges(spark, d):
    return ranges.merge_ranges(ranges.ranges4(views.ip4(spark, d), ["cat"]), ["cat"]).withColumnRenamed("end", "hi")


@query(f"WITH {MERGED}, {_split('merged', 'cat', 'cut')} SELECT cat, CAST(sum(bit_count(l) + bit_count(r)) AS BIGINT) AS blocks FROM cut GROUP BY cat")
def block_count(spark, d):
    merged = ranges.merge_ranges(ranges.ranges4(views.ip4(spark, d), ["cat"]), ["cat"])
    return merged.groupBy("cat").agg(F.sum(cidr.block_count(F.col("lo"), F.col("end"))).alias("blocks"))


@query(f"WITH {MERGED}, {_split('merged', 'cat', 'cut')} {_blocks('cut', 'cat')}")
def emit_blocks(spark, d):
    return ranges.emit4(ranges.merge_ranges(ranges.ranges4(views.ip4(spark, d), ["cat"]), ["cat"]), ["cat"])


@query(f"WITH {MERGED} SELECT cat, CAST(sum(hi - lo) AS BIGINT) AS addrs, count(*) AS ranges FROM merged GROUP BY cat")
def addr_count(spark, d):
    merged = ranges.merge_ranges(ranges.ranges4(views.ip4(spark, d), ["cat"]), ["cat"])
    return merged.groupBy("cat").agg(ranges.address_count(F.col("lo"), F.col("end")).alias("addrs"), F.count(F.lit(1)).alias("ranges"))


@query(f"WITH {SWEPT} SELECT cat, label, lo, hi FROM swept")
def coverage_diff_segments(spark, d):
    a, b = _sides(views.ip4(spark, d))
    got = ranges.sweep(ranges.ranges4(a, ["cat"]), ranges.ranges4(b, ["cat"]), ["cat"])
    return got.withColumnsRenamed({"side": "label", "end": "hi"})


@query(f"""WITH {SWEPT}, {_split('swept', 'cat, label', 'cut')}, n AS (SELECT cat, label, bit_count(l) + bit_count(r) AS n FROM cut)
{SUMMARY_SQL}""")
def coverage_summary(spark, d):
    a, b = _sides(views.ip4(spark, d))
    return diff.coverage_summary(a, b, ["cat"]).withColumnsRenamed({"onlyA": "only_a", "onlyB": "only_b"})


@query(f"""WITH {IP4}, side_b AS (SELECT 1 AS one, lo, hi FROM r4 WHERE side = 1), {_islands('side_b', 'one', 'merged')},
{_split('merged', 'one', 'cut')} SELECT num, pfx FROM ({_blocks('cut', 'one')})""")
def apply_make_match(spark, d):
    """Coverage mode: what a category, here of all rows, holds after it was made to match the other file's."""
    a, b = _sides(views.ip4(spark, d))
    got = diff.apply_diff(a, b, "geoip", "both", "coverage", "a", 0, "ALL")
    return got.select(cidr.v4_num(F.col("ip")).alias("num"), F.col("pfx").cast("int").alias("pfx"))


@query(f"""WITH {IP4} SELECT q.ord, w.num AS outer_num, w.pfx AS outer_pfx FROM r4 q JOIN r4 w ON w.pfx <= q.pfx AND w.lo <= q.lo AND w.hi >= q.hi""")
def containment_join_all(spark, d):
    """All rows against all blocks: every block of the view that contains a row's block."""
    rows = views.ip4(spark, d).select("ord", cidr.v4_num(F.col("ip")).alias("num"), F.col("pfx").cast("int").alias("pfx"))
    got = ranges.covering(rows, rows.select("num", "pfx"))
    return got.select("ord", F.col("block.num").alias("outer_num"), F.col("block.pfx").alias("outer_pfx"))


# IPv6

HEX6 = "'0020010DB8' || printf('%08X', u) || printf('%016X', {0})"


@query(f"WITH {IP6}, {_islands('r6', 'cat, u', 'merged')} SELECT cat, {HEX6.format('lo')} AS lo, {HEX6.format('hi')} AS hi FROM merged")
def v6_merge(spark, d):
    got = ranges.merge_ranges(ranges.ranges6(views.ip6(spark, d), ["cat"]), ["cat"], v4=False)
    return got.select("cat", F.hex("lo").alias("lo"), F.hex("end").alias("hi"))


@query(f"WITH {IP6}, {_sweep('r6', 'cat, u', 'swept')} SELECT cat, label, {HEX6.format('lo')} AS lo, {HEX6.format('hi')} AS hi FROM swept")
def v6_diff(spark, d):
    a, b = _sides(views.ip6(spark, d))
    got = ranges.sweep(ranges.ranges6(a, ["cat"]), ranges.ranges6(b, ["cat"]), ["cat"], v4=False)
    return got.select("cat", F.col("side").alias("label"), F.hex("lo").alias("lo"), F.hex("end").alias("hi"))


@query(f"""WITH {IP6}, {_islands('r6', 'cat, u', 'merged')}, {_split('merged', 'cat, u', 'cut')}
SELECT cat, CAST(sum(bit_count(l) + bit_count(r)) AS BIGINT) AS blocks FROM cut GROUP BY cat""")
def v6_block_count(spark, d):
    merged = ranges.merge_ranges(ranges.ranges6(views.ip6(spark, d), ["cat"]), ["cat"], v4=False)
    return ranges.emit6(merged, ["cat"]).groupBy("cat").agg(F.count(F.lit(1)).alias("blocks"))


# comparison

KEYED = "keyed AS (SELECT cat, side, ord, lo, pfx, row_number() OVER (PARTITION BY cat, side, lo, pfx ORDER BY ord) AS rn FROM r4)"


@query(f"""WITH {IP4}, {KEYED}, f AS (SELECT * FROM keyed WHERE rn = 1)
SELECT cat, ord, 'onlyA' AS label FROM f a WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.side = 1 AND b.cat = a.cat AND b.lo = a.lo AND b.pfx = a.pfx)
UNION ALL SELECT cat, ord, 'onlyB' FROM f a WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.side = 0 AND b.cat = a.cat AND b.lo = a.lo AND b.pfx = a.pfx)
UNION ALL SELECT cat, ord, 'common' FROM f a WHERE side = 0 AND EXISTS (SELECT 1 FROM f b WHERE b.side = 1 AND b.cat = a.cat AND b.lo = a.lo AND b.pfx = a.pfx)""")
def exact_diff(spark, d):
    a, b = _sides(views.ip4(spark, d))
    return diff.exact_entries(a, b, "geoip", ["cat"]).select("cat", "ord", F.col("side").alias("label"))


SUMMARY = f"""s AS (SELECT cat, lo, pfx, max(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS b FROM r4 GROUP BY cat, lo, pfx)"""


@query(f"""WITH {IP4}, {SUMMARY} SELECT cat, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b,
  count(*) FILTER (a = 1 AND b = 1) AS common FROM s GROUP BY cat""")
def exact_summary(spark, d):
    a, b = _sides(views.ip4(spark, d))
    return diff.exact_summary(a, b, "geoip", ["cat"]).withColumnsRenamed({"onlyA": "only_a", "onlyB": "only_b"})


def _two_files(spark, d):
    """File A without purchases, file B (names in upper case) without errors; B's views are reverse."""
    rows = views.ip4(spark, d).withColumn("cat_ord", F.pmod(F.crc32(F.col("cat").cast("binary")), F.lit(1000)).cast("int"))
    a, b = _sides(rows)
    a, b = a.filter("cat <> 'purchase'"), b.filter("cat <> 'error'").withColumn("cat", F.upper("cat"))
    cats = lambda x: x.select("cat_ord", F.col("cat").alias("name"), (F.col("cat") == "VIEW").alias("reverse")).distinct()
    return a, cats(a), b, cats(b)


FILE_DIFF = f"""WITH {IP4}, x AS (SELECT * FROM r4 WHERE (side = 0 AND cat <> 'purchase') OR (side = 1 AND cat <> 'error')),
s AS (SELECT cat, lo, pfx, max(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS b FROM x GROUP BY cat, lo, pfx),
k AS (SELECT cat, count(*) FILTER (a = 1 AND b = 0) AS oa, count(*) FILTER (a = 0 AND b = 1) AS ob, count(*) FILTER (a = 1 AND b = 1) AS c FROM s GROUP BY cat),
n AS (SELECT cat, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM x GROUP BY cat)
SELECT CASE WHEN na = 0 THEN upper(cat) ELSE cat END AS name, CASE WHEN na = 0 THEN -1 ELSE na END AS na, CASE WHEN nb = 0 THEN -1 ELSE nb END AS nb,
  CASE WHEN nb = 0 THEN na WHEN na = 0 THEN 0 ELSE oa END AS only_a, CASE WHEN na = 0 THEN nb WHEN nb = 0 THEN 0 ELSE ob END AS only_b,
  CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE c END AS common, na > 0 AND nb > 0 AND cat = 'view' AS reverse_changed,
  CASE WHEN na = 0 THEN 'added' WHEN nb = 0 THEN 'removed' WHEN oa > 0 OR ob > 0 OR cat = 'view' THEN 'changed' ELSE 'same' END AS status
FROM n JOIN k USING (cat)"""


@query(FILE_DIFF)
def file_diff(spark, d):
    got = diff.file_diff(*_two_files(spark, d), "geoip")
    return got.select("name", "na", "nb", F.col("onlyA").alias("only_a"), F.col("onlyB").alias("only_b"), "common", F.col("reverseChanged").alias("reverse_changed"), "status")


@query(f"SELECT count(*) FILTER (status <> 'same') AS changed, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed FROM ({FILE_DIFF})")
def file_diff_totals(spark, d):
    return diff.totals(diff.file_diff(*_two_files(spark, d), "geoip"))


# dedupe, fold, optimise


@query(f"WITH {IP4} SELECT cat, min(ord) AS ord FROM r4 GROUP BY cat, lo, pfx")
def dedupe_first(spark, d):
    return entries.dedupe(views.ip4(spark, d).drop("side"), "geoip", ["cat"]).select("cat", "ord")


@query("""SELECT CAST(event_id % 5 AS SMALLINT) AS type, event_type AS val, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, min(event_id) AS ord
FROM events GROUP BY 1, 2, 3""")
def dedupe_attr(spark, d):
    got = views.table(spark, d, "events").select(
        F.lit("C").alias("cat"), F.col("event_id").alias("ord"), (F.col("event_id") % 5).cast("short").alias("type"), F.col("event_type").alias("val"),
        F.array(F.struct(F.lit("k").alias("k"), F.lit(None).cast("boolean").alias("b"), F.from_json("props", "k long")["k"].alias("i"))).alias("attrs"),
    )
    return entries.dedupe(got, "geosite", ["cat"]).select("type", "val", F.col("attrs")[0]["i"].alias("i"), "ord")


PARTS = "list_transform(range(2, len(string_split(val, '.')) + 1), lambda k: array_to_string(string_split(val, '.')[k:], '.'))"
COVERED = f"""dom AS (SELECT DISTINCT cat, val AS dv FROM site WHERE type = 2 AND NOT has_attr),
suf AS (SELECT cat, ord, unnest(CASE WHEN instr(val, '.') > 1 THEN {PARTS} ELSE [] END) AS dv FROM site WHERE NOT has_attr AND type IN (2, 3)
  UNION ALL SELECT cat, ord, val FROM site WHERE NOT has_attr AND type = 3),
gone AS (SELECT DISTINCT suf.cat, suf.ord FROM suf JOIN dom USING (cat, dv))"""


@query(f"WITH {SITE}, {COVERED} SELECT cat, ord, type, val FROM site WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.cat = site.cat AND gone.ord = site.ord)")
def fold_suffix(spark, d):
    return fold.fold(views.site(spark, d)).select("cat", "ord", "type", "val")


SHORT = "CASE WHEN type = 0 THEN substr(val, 1, 7) ELSE val END"


@query(f"""WITH {SITE.replace('site AS', 'site0 AS')}, site AS (SELECT * REPLACE ({SHORT} AS val) FROM site0), {COVERED},
kw AS (SELECT DISTINCT cat, val AS w FROM site WHERE type = 0 AND NOT has_attr AND val <> ''),
byword AS (SELECT DISTINCT s.cat, s.ord FROM site s JOIN kw USING (cat) WHERE NOT s.has_attr AND s.type IN (0, 2, 3) AND contains(s.val, kw.w)
  AND NOT (s.type = 0 AND s.val = kw.w))
SELECT cat, ord, type, val FROM site s WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.cat = s.cat AND gone.ord = s.ord)
  AND NOT EXISTS (SELECT 1 FROM byword WHERE byword.cat = s.cat AND byword.ord = s.ord)""")
def fold_keyword(spark, d):
    rows = views.site(spark, d).withColumn("val", F.when(F.col("type") == 0, F.substring("val", 1, 7)).otherwise(F.col("val")))
    return fold.fold(rows, keyword=True).select("cat", "ord", "type", "val")


@query(f"""WITH {SITE}, have AS (SELECT * FROM site WHERE ord % 2 = 0), want AS (SELECT *, lower(val) AS lv FROM site WHERE ord % 2 = 1),
open AS (SELECT * FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.type = w.type AND h.val = w.val AND h.has_attr = w.has_attr)),
dom AS (SELECT DISTINCT lower(val) AS dv FROM have WHERE type = 2 AND NOT has_attr),
suf AS (SELECT ord, unnest(CASE WHEN instr(lv, '.') > 1 THEN {PARTS.replace('(val', '(lv')} ELSE [] END) AS dv FROM open WHERE NOT has_attr AND type IN (2, 3)
  UNION ALL SELECT ord, lv FROM open WHERE NOT has_attr AND type = 3)
SELECT ord, type, val FROM open WHERE ord NOT IN (SELECT ord FROM suf JOIN dom USING (dv))""")
def site_missing(spark, d):
    rows = views.site(spark, d)
    return fold.missing(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1")).select("ord", "type", "val")


@query(f"""WITH {SITE.replace('site AS', 'site0 AS')}, site AS (SELECT cat_ord, cat, min(ord) AS ord, type, val, has_attr FROM site0 GROUP BY cat_ord, cat, type, val, has_attr), {COVERED},
kept AS (SELECT * FROM site WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.cat = site.cat AND gone.ord = site.ord))
SELECT cat, type, val, CAST(row_number() OVER (PARTITION BY cat ORDER BY val, type, ord) - 1 AS BIGINT) AS ord FROM kept""")
def optimize_rules(spark, d):
    return fold.optimize(views.site(spark, d), "geosite", sort=True).select("cat", "type", "val", "ord")


@query(f"""WITH {MERGED}, {_split('merged', 'cat', 'cut')}, b AS ({_blocks('cut', 'cat')})
SELECT cat, num, pfx, CAST(row_number() OVER (PARTITION BY cat ORDER BY num) - 1 AS BIGINT) AS ord FROM b""")
def optimize_blocks(spark, d):
    got = fold.optimize(views.ip4(spark, d).drop("side"), "geoip")
    return got.select("cat", cidr.v4_num(F.col("ip")).alias("num"), F.col("pfx").cast("int").alias("pfx"), "ord")


# filters


def _ip_filter(text_, **how):
    def run(spark, d):
        return filters.apply(views.ip4(spark, d), text_, "geoip", **how).select("cat", "ord")

    return run


def _site_filter(text_, **how):
    def run(spark, d):
        return filters.apply(views.site(spark, d), text_, "geosite", **how).select("cat", "ord")

    return run


NET = DOTTED.format("num") + " || '/' || CAST(pfx AS VARCHAR)"
for _name, _run, _sql in (
    ("filter_prefix", _ip_filter("/30"), f"WITH {IP4} SELECT cat, ord FROM ip4 WHERE pfx = 30"),
    ("filter_overlap", _ip_filter("10.0.16.0/21"), f"WITH {IP4} SELECT cat, ord FROM r4 WHERE lo < 167772160 + 4096 + 2048 AND hi > 167772160 + 4096"),
    ("filter_octets", _ip_filter("10.0.1"), f"WITH {IP4} SELECT cat, ord FROM ip4 WHERE starts_with({DOTTED.format('num')}, '10.0.1')"),
    ("filter_octets_whole", _ip_filter("10.0.12."), f"WITH {IP4} SELECT cat, ord FROM ip4 WHERE (num >> 8) & 255 = 12"),
    ("filter_ip_regex", _ip_filter(r"/\.7\d\/2[67]$/"), f"WITH {IP4} SELECT cat, ord FROM ip4 WHERE regexp_matches({NET}, '\\.7[0-9]/2[67]$')"),
    ("filter_substring", _site_filter("EX"), f"WITH {SITE} SELECT cat, ord FROM site WHERE contains(lower(val), 'ex')"),
    ("filter_regex", _site_filter(r"/^M?\.?(?<x>TH).*\.(?:com|ORG)$/"), f"WITH {SITE} SELECT cat, ord FROM site WHERE regexp_matches(lower(val), '^m?[.]?th.*[.](com|org)$')"),
    ("filter_type", _site_filter("", type_=3), f"WITH {SITE} SELECT cat, ord FROM site WHERE type = 3"),
    ("filter_attr", _site_filter("", type_=filters.WITH_ATTRS), f"WITH {SITE} SELECT cat, ord FROM site WHERE has_attr"),
):
    QUERIES[_name], SQL[_name] = _run, _sql


@query(f"""WITH {IP6.replace('x - x %', 'x, x - x %', 1)} SELECT cat, ord FROM r6
WHERE contains(CASE WHEN u = 0 THEN '2001:db8::' ELSE '2001:db8:0:' || printf('%x', u) || '::' END || CASE WHEN x = 0 THEN '' ELSE printf('%x', x) END, 'a1')""")
def filter_v6_all(spark, d):
    """Part of an IPv6 address as printed, zero runs and all."""
    return filters.apply(views.ip6(spark, d), "a1", "geoip").select("cat", "ord")


@query(f"WITH {SITE}, v AS (SELECT cat_ord, count(*) AS visible FROM site WHERE contains(lower(val), 'ex') GROUP BY cat_ord) SELECT DISTINCT s.cat AS name, coalesce(v.visible, 0) AS visible FROM site s LEFT JOIN v USING (cat_ord)")
def visible_counts(spark, d):
    rows = views.site(spark, d)
    return filters.visible(views.categories(rows, "geosite"), filters.apply(rows, "ex", "geosite")).select("name", "visible")


# sorts and pages


@query(f"WITH {IP4} SELECT cat, ord, CAST(row_number() OVER (PARTITION BY cat ORDER BY num, pfx, ord) - 1 AS BIGINT) AS place FROM ip4")
def sort_ip(spark, d):
    rows = views.ip4(spark, d).withColumn("was", F.col("ord"))
    return entries.sort(rows, "geoip").select("cat", F.col("was").alias("ord"), F.col("ord").alias("place"))


def _sort_query(how: str, order: str) -> None:
    def run(spark, d):
        rows = views.site(spark, d).withColumn("was", F.col("ord"))
        return entries.sort(rows, "geosite", how).select("cat", F.col("was").alias("ord"), F.col("ord").alias("place"))

    QUERIES[f"sort_{how}"] = run
    SQL[f"sort_{how}"] = f"WITH {SITE} SELECT cat, ord, CAST(row_number() OVER (PARTITION BY cat ORDER BY {order}, ord) - 1 AS BIGINT) AS place FROM site"


_sort_query("value", "val, type")
_sort_query("type", "type, val")
_sort_query("host", "array_to_string(list_reverse(string_split(val, '.')), '.'), type")


@query(f"WITH {SITE}, n AS (SELECT cat, type, val, CAST(row_number() OVER (ORDER BY cat_ord, ord) - 1 AS BIGINT) AS row FROM site) SELECT * FROM n WHERE row >= 20 AND row < 60")
def page_rows(spark, d):
    return entries.page(entries.renumbered(views.site(spark, d)), 20, 40).select("cat", "type", "val", "row")


# statistics


@query(f"""WITH {MERGED}, {_split('merged', 'cat', 'cut')}, c AS (SELECT cat, count(*) AS ranges4, CAST(sum(hi - lo) AS BIGINT) AS addrs4,
  CAST(sum(bit_count(l) + bit_count(r)) AS BIGINT) AS optimal FROM cut GROUP BY cat), n AS (SELECT cat, count(*) AS v4 FROM ip4 GROUP BY cat)
SELECT cat, v4, CAST(0 AS BIGINT) AS v6, CAST(0 AS BIGINT) AS bad, ranges4, addrs4, CAST(0 AS BIGINT) AS ranges6, optimal FROM n JOIN c USING (cat)""")
def stats_ip(spark, d):
    return entries.stats(views.ip4(spark, d), "geoip", ["cat"])


@query(f"""WITH {SITE} SELECT cat, count(*) FILTER (type = 0) AS keyword, count(*) FILTER (type = 1) AS regexp, count(*) FILTER (type = 2) AS domain,
  count(*) FILTER (type = 3) AS "full", count(*) FILTER (has_attr) AS with_attr, count(*) FILTER (type > 3) AS unknown FROM site GROUP BY cat""")
def stats_site(spark, d):
    return entries.stats(views.site(spark, d), "geosite", ["cat"])


# concatenation


@query(f"WITH {SITE} SELECT type, val, CAST(row_number() OVER (ORDER BY cat_ord, ord) - 1 AS BIGINT) AS ord FROM site WHERE cat_ord IN (0, 2)")
def concat(spark, d):
    rows = views.site(spark, d)
    return entries.concat([rows.filter("cat_ord = 0"), rows.filter("cat_ord = 2")], "a", 9, "ALL").select("type", "val", "ord")


def _database(spark, d) -> Database:
    rows = views.site(spark, d)
    return Database("a", "geosite", Version(views.categories(rows, "geosite"), entries.renumbered(rows), "load"))


@query(f"""WITH {SITE}, a AS (SELECT cat, type, val, ord, 0 AS t FROM site WHERE cat_ord = 1 UNION ALL SELECT 'C1', type, val, ord, 1 FROM site WHERE cat_ord = 2)
SELECT type, val, CAST(row_number() OVER (ORDER BY t, ord) - 1 AS BIGINT) AS ord FROM a""")
def append(spark, d):
    db = _database(spark, d)
    return db.append("c1", db.of("C2")).of("C1").select("type", "val", "ord")


@query(f"""WITH {SITE.replace('site AS', 'site0 AS')}, o AS (SELECT type, val, has_attr, row_number() OVER (ORDER BY cat_ord, ord) AS n FROM site0 WHERE cat_ord IN (0, 2)),
site AS (SELECT 'ALL' AS cat, min(n) AS ord, type, val, has_attr FROM o GROUP BY type, val, has_attr), {COVERED}
SELECT type, val, CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS ord FROM site WHERE ord NOT IN (SELECT ord FROM gone)""")
def merge_cats(spark, d):
    return _database(spark, d).merge(["C0", "C2"], "ALL").of("ALL").select("type", "val", "ord")


@query("SELECT count(DISTINCT CAST(page_id % 3 AS INTEGER) % 2) > 1 AS clash, false AS reverse FROM pages")
def reverse_clash(spark, d):
    rows = views.site(spark, d)
    cats = views.categories(rows, "geoip")
    counts = rows.groupBy("file", "cat_ord").agg(F.count(F.lit(1)).alias("n"))
    return entries.reverse_clash(cats, counts).join(entries.reverse_of(cats, counts), "file").drop("file")


# text

BODY = """CASE page_id % 8 WHEN 0 THEN 'domain:' || h WHEN 1 THEN 'FULL:' || h || ' @ads @w=12 # note' WHEN 2 THEN '  ' || h WHEN 3 THEN 'keyword:' || h || ' // x'
 WHEN 4 THEN '# nothing' WHEN 5 THEN 'type7:' || h || ' @' WHEN 6 THEN 'full:' ELSE h || ' odd' END"""


def _rule_lines(spark, d):
    rows = views.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("h"))
    return rows.select(F.col("page_id").alias("line"), F.expr(BODY).alias("text"))


RULE_LINES = "p AS (SELECT page_id, page_id % 8 AS c, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages)"


@query(f"""WITH {RULE_LINES} SELECT page_id AS line, CAST(CASE c WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 7 END AS SMALLINT) AS type, h AS val,
  CASE WHEN c = 1 THEN 'ads=true,w=12' END AS attrs FROM p WHERE c NOT IN (4, 6, 7)""")
def text_parse_rules(spark, d):
    got = text.parse_rules(_rule_lines(spark, d), []).filter("val is not null")
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), site.attr_text(a))), ",")
    return got.select("line", "type", "val", attrs.alias("attrs"))


@query(f"WITH {RULE_LINES} SELECT page_id AS line, CASE c WHEN 6 THEN 'empty value' ELSE 'unexpected token \"odd\"' END AS msg FROM p WHERE c IN (6, 7)")
def text_errors(spark, d):
    return text.errors(text.parse_rules(_rule_lines(spark, d), []), ["line"], 1 << 30).select("line", "msg")


@query(f"""WITH {IP4} SELECT ord AS line, CAST(CASE WHEN ord % 3 = 0 THEN 32 ELSE pfx END AS SMALLINT) AS pfx, num FROM ip4 WHERE ord % 5 <> 4""")
def text_parse_blocks(spark, d):
    rows = views.ip4(spark, d)
    addr = cidr.v4_text(cidr.v4_num(F.col("ip")))
    body = F.when(F.col("ord") % 5 == 4, F.concat(addr, F.lit("/99"))).when(F.col("ord") % 3 == 0, F.concat(addr, F.lit(", x"))).otherwise(F.concat(addr, F.lit("/"), F.col("pfx").cast("string"), F.lit(" # c")))
    got = text.parse_blocks(rows.select(F.col("ord").alias("line"), body.alias("text")), []).filter("ip is not null")
    return got.select("line", "pfx", cidr.v4_num(F.col("ip")).alias("num"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS t, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS line FROM documents),
s AS (SELECT doc_id, CAST(line AS INTEGER) AS line, trim(regexp_replace(regexp_replace(t, '#.*$', ''), '//.*$', ''), E' \t\r\n') AS body FROM l)
SELECT doc_id, line, body FROM s WHERE body <> ''""")
def text_parse_lines(spark, d):
    rows = text.lines(views.table(spark, d, "documents"), ["doc_id"], F.col("text"))
    return rows.select("doc_id", "line", text.stripped(F.col("text")).alias("body")).filter("body <> ''")


@query(f"""WITH {SITE}, x AS (SELECT 0 AS a, 0 AS ord, CAST(2 AS SMALLINT) AS type, 'first.example' AS val UNION ALL SELECT 1, ord, type, val FROM site WHERE cat_ord = 0 AND has_attr
  UNION ALL SELECT 2, ord, type, val FROM site WHERE cat_ord = 2 AND NOT has_attr UNION ALL SELECT 3, 0, CAST(3 AS SMALLINT), 'last.example')
SELECT type, val, CAST(row_number() OVER (ORDER BY a, ord) - 1 AS BIGINT) AS ord FROM x""")
def include_expand(spark, d):
    body = "first.example\ninclude:c0 @ads\ninclude:C2 @-ads\ninclude:C1\nfull:last.example\ninclude:nobody"
    rows = text.lines(spark.createDataFrame([(body,)], "body string"), [], F.col("body"))
    site_rows = views.site(spark, d)
    got, _, _ = text.expand_includes(text.parse_rules(rows, []), site_rows, views.categories(site_rows, "geosite"), "geosite", [])
    return got.select("type", "val", "ord")


@query(f"""WITH {SITE} SELECT cat, ord, (CASE type WHEN 0 THEN 'keyword' WHEN 1 THEN 'regexp' WHEN 2 THEN 'domain' WHEN 3 THEN 'full' ELSE 'type' || CAST(type AS VARCHAR) END)
  || ':' || val || CASE WHEN has_attr THEN ' @ads' ELSE '' END AS line FROM site""")
def to_text(spark, d):
    return text.entry_lines(views.site(spark, d), "geosite").select("cat", "ord", "line")


@query(f"WITH {IP4} SELECT cat, ord, {NET} AS line, CASE WHEN pfx = 32 THEN 'host' ELSE CAST(1::BIGINT << (32 - pfx) AS VARCHAR) || ' addrs' END AS size FROM ip4")
def ip_to_text(spark, d):
    rows = text.entry_lines(views.ip4(spark, d), "geoip")
    return rows.select("cat", "ord", "line", cidr.block_text(F.col("fam"), F.col("pfx").cast("int")).alias("size"))


# not SQL: a binary round trip, and versions


@query(f"WITH {SITE} SELECT cat, type, val, has_attr, CAST(row_number() OVER (PARTITION BY cat ORDER BY ord) - 1 AS BIGINT) AS ord FROM site")
def dat_roundtrip(spark, d):
    """Entries after a file was written and read back.  The file lies in the shared folder."""
    from prefixloom.catalog_more import scratch

    db = _database(spark, d)
    path = f"{scratch(spark)}.dat"
    db.export_dat(path)
    return routedat.read_dat(spark, path, "geosite").select("cat", "type", "val", F.col("attrs").isNotNull().alias("has_attr"), "ord")


@query(f"WITH {SITE} SELECT cat, count(*) AS n FROM site WHERE cat_ord <> 1 GROUP BY cat UNION ALL SELECT 'C1', count(*) FROM site WHERE cat_ord = 1")
def undo_redo(spark, d):
    db = _database(spark, d).sort("C0", "host").clear("C1").undo().delete_categories(["C2"]).undo().redo().undo()
    return db.entries.groupBy("cat").agg(F.count(F.lit(1)).alias("n"))


from prefixloom import catalog_more  # noqa: E402, F401  its queries join the catalog
