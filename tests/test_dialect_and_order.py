"""Patterns of the format, odd binary files and names, numbers beyond 64 bits, order by cells, selection, sessions, ordered exports."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import cidr, patterns
from prefixloom.operators import entries, filters
from prefixloom.plans.database import Database, Session, bytes_text, number_text, percent_saved, snapshot
from prefixloom.sources import routedat, text

SITE = "file string, cat_ord int, cat string, ord long, type short, val string, attrs array<struct<k:string,b:boolean,i:bigint>>"


def site_rows(spark, vals, cat="C", at=0):
    return spark.createDataFrame([("f", at, cat, i, 2, v, None) for i, v in enumerate(vals)], SITE)


@pytest.mark.parametrize("query,kept", [
    ("/(?P<a>b)/", []), ("/(?<a>b)c/", ["bc"]), ("/É/", ["é.x"]), (r"/^x\/y$/", ["x/y"]), ("/a++/", ["/a++/"]), (r"/\p{L}/", ["p{l}"]), ("/[a&&b]c/", ["bc"]),
    (r"/^(?<w_1>ab)\k<w_1>$/", ["abab"]), ("/[/", []), ("/^$/", [""]), ("/B/", ["bc", "abab"]),
])
def test_regex_filters(spark, query, kept):
    """What isn't a pattern of the format is searched as text, slashes and all; letters match in either case."""
    vals = ["bc", "é.x", "x/y", "/a++/", "p{l}", "abab", ""]
    got = [r["val"] for r in filters.apply(site_rows(spark, vals), query, "geosite").orderBy("ord").collect()]
    assert got == kept


@pytest.mark.parametrize("pattern", [r"a{2,1}", "a**", "(", ")", "[b", "[z-a]", "(?i)a", "(?>a)", r"(?<a>x)(?<a>y)", r"(?<a>x)\k<b>", "\\", "^*", "a|?"])
def test_patterns_that_are_none(pattern):
    assert patterns.fault(pattern)
    with pytest.raises(patterns.PatternError):
        patterns.engine_pattern(pattern)


def test_patterns_agree_with_another_engine_where_both_know_them(spark):
    rng = random.Random(3)
    parts = ["a", "b", ".", "x*", "[ab]", "[^a]", "(?:ab)", "(a|b)", "a?", "b+?", "^", "$", r"\.", r"\d", "{", "]", r"[\d-]"]
    texts = ["", "a", "ab", "ba.", "xx9b", "{b]", "AB", "a\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    chosen = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    chosen = [p for p in chosen if patterns.fault(p) is None]
    got = rows.select("t", *(F.rlike("t", F.lit(patterns.engine_pattern(p))).alias(f"c{i}") for i, p in enumerate(chosen))).collect()
    for r in got:
        for i, p in enumerate(chosen):
            own = p.replace("$", r"\Z").replace("{", r"\{").replace("^", r"\A") if "[^" not in p else p.replace("$", r"\Z").replace("{", r"\{")
            assert r[f"c{i}"] == bool(re.search(own, r["t"], re.IGNORECASE)), (p, r["t"])
    assert len(chosen) > 20


def test_rules_with_patterns_of_the_format_and_large_numbers(spark):
    body = ["regexp:(?<n>a)b", r"regexp:\p{L}+", "regexp:(?P<n>a)", "full:x @k=9223372036854775807", "full:x @k=99999999999999999999", "full:x @k=-5z @t=no @", "include:y @k=99999999999999999999"]
    df = spark.createDataFrame(list(enumerate(body)), "line int, text string")
    got = {r["line"]: r for r in text.parse_rules(df, []).collect()}
    assert got[0]["val"] == "(?<n>a)b" and got[1]["val"] == r"\p{L}+" and got[2]["error"].startswith("invalid regexp")
    assert got[3]["attrs"][0]["i"] == 2**63 - 1 and got[4]["error"] == "number out of range: @k=99999999999999999999" and got[4]["val"] is None
    assert [(a["k"], a["b"], a["i"]) for a in got[5]["attrs"]] == [("k", None, -5), ("t", True, None)]
    assert got[6]["error"] and got[6]["include"] is None


def entry(body):
    return routedat._bytes(1, routedat._bytes(1, b"N") + routedat._bytes(2, body))


def test_sniff_by_the_first_field():
    b, n = routedat._bytes, routedat._number
    assert routedat.sniff(entry(n(2, 24) + b(1, bytes(4)))) == "geoip"
    assert routedat.sniff(entry(b(1, bytes(5)) + b(2, b"x"))) is None and routedat.sniff(entry(b"")) is None
    assert routedat.sniff(entry(n(1, 2))) == routedat.sniff(entry(b(2, b"x"))) == "geosite" and routedat.sniff(entry(b(1, bytes(16)))) == "geoip"
    assert routedat.sniff(n(1, 5)) is None and routedat.sniff(entry(b(7, b"x"))) is None


@pytest.mark.parametrize("split", [60, 1 << 22])
def test_names_with_any_character_and_slices_by_bytes(spark, tmp_path, split):
    names = ["two\nlines", "a=b", "", "ü\t"]
    parts = [site_rows(spark, [f"{n}{i}.example" for i in range(40)], n, k) for k, n in enumerate(names)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    cats = spark.createDataFrame([("f", "geosite", k, n, False) for k, n in enumerate(names)], "file string, kind string, cat_ord int, name string, reverse boolean")
    path = f"file://{tmp_path}/sub/n.dat"
    routedat.write_dat(rows.repartition(3), cats, "geosite", path)
    assert [p.name for p in (tmp_path / "sub").iterdir()] == ["n.dat"]
    spark.dataSource.register(routedat.RouteDat)
    got = spark.read.format("routedat").option("kind", "geosite").option("split", split).load(path)
    assert [(r["cat"], r["ord"], r["val"]) for r in got.orderBy("cat_ord", "ord").collect()] == [(n, i, f"{n}{i}.example") for n in names for i in range(40)]
    assert [r["name"] for r in routedat.read_categories(spark, path).orderBy("cat_ord").collect()] == names


def test_numbering_by_cells_is_the_plain_order(spark):
    rng = random.Random(5)
    vals = ["".join(rng.choice("ab.é字") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["www.same.example"] * 50
    df = site_rows(spark, vals).repartition(5).withColumn("was", F.col("ord"))
    for how in ("value", "type", "host"):
        got = [r["was"] for r in entries.sort(df, "geosite", how).orderBy("ord").collect()]
        key = (lambda v: ".".join(reversed(v.split("."))).encode()) if how == "host" else str.encode
        assert got == sorted(range(len(vals)), key=lambda i: (key(vals[i]), i))
    far = df.withColumn("ord", F.col("ord") * 70_001)  # several cells
    out = entries.renumbered(far).orderBy("ord").collect()
    assert [r["ord"] for r in out] == list(range(450)) and [r["was"] for r in out] == list(range(450))


def test_selection(spark):
    df = site_rows(spark, "abcdefgh", "A", 0).unionByName(site_rows(spark, "ijkl", "B", 1))
    index = spark.createDataFrame([(0, 5, 0), (0, 1, 1), (1, 2, 2), (0, 7, 3)], "cat_ord int, ord long, pos long")
    assert [(r["cat"], r["ord"], r["val"]) for r in entries.pick(df, index).orderBy("cat_ord", "ord").collect()] == [("A", 0, "f"), ("A", 1, "b"), ("A", 2, "h"), ("B", 0, "k")]
    assert [r["val"] for r in entries.remove(df, index).orderBy("cat_ord", "ord").collect()] == list("acdegijl")
    assert [r["val"] for r in entries.page(df, 6, 4).orderBy("row").collect()] == list("ghij")
    shown = df.filter("val in ('g', 'j')")
    assert sorted((r["cat_ord"], r["ord"]) for r in entries.between(df, 9, 5, shown).collect()) == [(0, 6), (1, 1)]


def lines_in_order(folder):
    return [x for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_exports_keep_their_order(spark, tmp_path):
    db = Database.empty(spark, "my.DAT", "geosite")
    db.new_category("B c", site_rows(spark, [f"{i}.example" for i in range(300)]))
    db.new_category("A", site_rows(spark, ["z", "y"]))
    db.export_text(f"file://{tmp_path}/all")
    assert lines_in_order(tmp_path / "all") == ["# B c (300)", *(f"domain:{i}.example" for i in range(300)), "", "# A (2)", "domain:z", "domain:y"]
    assert db.export_text_into(f"file://{tmp_path}", "b C").endswith("/b-c.txt") and lines_in_order(tmp_path / "b-c.txt")[:2] == ["domain:0.example", "domain:1.example"]
    assert db.file_name() == "my.DAT" and db.file_name(["A"]) == "subset-my.dat" and Database.empty(spark, "x", "geoip").file_name() == "x.dat"
    part = db.export_into(f"file://{tmp_path}", ["A"])
    assert [n for _, n, _ in Database.load(spark, part).names()] == ["A"]
    with pytest.raises(ValueError, match="no category"):
        Database.empty(spark, "x", "geoip").to_bytes(f"file://{tmp_path}")
    assert db.to_bytes(f"file://{tmp_path}")[:1] == b"\x0a"
    other = Database.empty(spark, "o", "geosite").new_category("A", site_rows(spark, ["y", "q", "p"]))
    db.export_diff(other, "a", f"file://{tmp_path}/diff")
    assert lines_in_order(tmp_path / "diff") == ["# a: my.DAT vs o (exact)", "-domain:z", "+domain:q", "+domain:p"]
    assert db.counts() == (302, 0) and snapshot(db).done == []


def test_sessions_and_formats(spark, tmp_path):
    s = Session(spark)
    one = s.new("one", "geosite").new_category("A", site_rows(spark, ["x"]))
    one.export_dat(f"file://{tmp_path}/one.dat")
    s.load(f"file://{tmp_path}/one.dat"), s.load(f"file://{tmp_path}/one.dat")
    assert [f.name for f in s.files] == ["one", "one.dat"] and s.active.name == "one.dat"
    s.switch("one")
    with pytest.raises(ValueError, match="unsaved"):
        s.close("one")
    s.close("one", discard=True)
    assert s.active.name == "one.dat"
    with pytest.raises(KeyError):
        s.switch("one")
    (tmp_path / "t.txt").write_text("include:a\nfull:new\n")
    (tmp_path / "u").write_text("10.0.0.0/8\n")
    got = s.load_many([f"file://{tmp_path}/t.txt", f"file://{tmp_path}/one.dat", f"file://{tmp_path}/u"])
    assert [(f.name, f.kind) for f in s.files] == [("one.dat", "geosite"), ("one.dat", "geosite"), ("u", "geoip")] and len(got) == 3
    assert [r["val"] for r in s.files[1].of("T").orderBy("ord").collect()] == ["x", "new"]
    assert number_text(1234567.4) == "1,234,567" and bytes_text(1023) == "1023 B" and bytes_text(1536) == "1.5 KB" and bytes_text(3 << 20) == "3.00 MB"
    assert percent_saved(0, 0) == "0%" and percent_saved(200, 50) == "75.0%"


def test_stored_bounds_are_compared_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, "C", i, 4, 24, bytes([10, 0, i, 0])) for i in range(20)], "file string, cat_ord int, cat string, ord long, fam byte, pfx short, ip binary")
    lo = cidr.v4_lo(cidr.v4_num(F.col("ip")), F.col("pfx"))
    rows.withColumn("lo", lo).withColumn("end", lo + 256).write.parquet(f"file://{tmp_path}/stored")
    stored = spark.read.parquet(f"file://{tmp_path}/stored")
    want = [r["ord"] for r in filters.apply(rows, "10.0.4.0/22", "geoip").orderBy("ord").collect()]
    got = filters.apply(stored, "10.0.4.0/22", "geoip")
    assert [r["ord"] for r in got.orderBy("ord").collect()] == want == [4, 5, 6, 7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "conv(" not in plan and "PushedFilters" in plan
