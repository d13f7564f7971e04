"""Addresses, keys, texts and filters on tables of cases."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import cidr, site
from prefixloom.operators import filters
from prefixloom.sources import text

GOOD = {
    "1.2.3.4": (4, 32, "01020304"), " 001.02.3.004/8 ": (4, 8, "01020304"), "0.0.0.0/0": (4, 0, "00000000"), "255.255.255.255/032": (4, 32, "ffffffff"),
    "::": (6, 128, "00" * 16), "::1/0": (6, 0, "00" * 15 + "01"), "1::": (6, 128, "0001" + "00" * 14), "2001:DB8::1/32": (6, 32, "20010db8" + "00" * 11 + "01"),
    "::ffff:1.2.3.4": (6, 128, "00" * 10 + "ffff01020304"), "1:2:3:4:5:6:7:8": (6, 128, "00010002000300040005000600070008"), "1:2:3:4:5:6:1.2.3.4": (6, 128, "00010002000300040005000601020304"),
    "1:2:3:4:5:6:7::": (6, 128, "0001000200030004000500060007" + "0000"),
}
BAD = [
    "", "/", "1.2.3", "1.2.3.4.5", "1.2.3.256", "1.2.3.4/33", "1.2.3.4/", "1.2.3.4/-1", "1.2.3.0004", "a.b.c.d", "1..2.3", ":", ":::", "1::2::3", "::g", "12345::",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "::1%eth0", "::/129", "1.2.3.4::", "::1.2.3", "1:1.2.3.4::", "+1.2.3.4", "1.2.3.4/0x1", "１.2.3.4",
]


def test_parser_table(spark):
    rows = [(t,) for t in [*GOOD, *BAD, None]]
    for r in spark.createDataFrame(rows, "t string").select("t", cidr.parse_cidr("t").alias("c"), cidr.parse_v4(F.trim("t")).alias("v")).collect():
        want = GOOD.get(r["t"])
        got = (r["c"]["fam"], r["c"]["pfx"], r["c"]["ip"].hex()) if r["c"] and r["c"]["ip"] is not None else None
        assert got == want, r["t"]
        four = (int(want[2], 16), want[1]) if want and want[0] == 4 else None
        assert (tuple(r["v"]) if r["v"] else None) == four, r["t"]


def test_v6_text_all_zero_patterns():
    for mask in range(256):
        words = [0 if mask >> i & 1 else i + 1 for i in range(8)]
        ip = b"".join(w.to_bytes(2, "big") for w in words)
        got = cidr.v6_string(ip)
        assert got == ipaddress.IPv6Address(ip).compressed and cidr.v6_parsed(got) == ip


def test_v4_columns(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 32), rng.randint(0, 32)) for _ in range(500)]
    for r in spark.createDataFrame(rows, "n long, p int").select("n", "p", cidr.v4_text(F.col("n")).alias("t"), cidr.v4_num(cidr.v4_bytes(F.col("n"))).alias("b"), cidr.v4_lo(F.col("n"), F.col("p")).alias("lo"), cidr.v4_end(F.col("n"), F.col("p")).alias("e")).collect():
        net = ipaddress.ip_network((r["n"], r["p"]), strict=False)
        assert r["t"] == str(ipaddress.ip_address(r["n"])) and r["b"] == r["n"]
        assert (r["lo"], r["e"]) == (int(net.network_address), int(net.broadcast_address) + 1)


ENTRIES = [
    (0, 4, 24, bytes([10, 0, 0, 7])), (1, 4, 33, bytes([10, 0, 1, 1])), (2, 6, 32, bytes.fromhex("20010db8" + "00" * 12)), (3, 0, 8, b"\x01\x02\x03"), (4, 0, 0, b""),
    (5, 4, 32, bytes([110, 1, 2, 3])), (6, 6, 129, bytes(16)), (7, 4, 0, bytes([1, 2, 3, 4])),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "ord long, fam byte, pfx short, ip binary")


def test_entry_texts(entries):
    got = [r["t"] for r in entries.orderBy("ord").select(cidr.entry_text(F.col("fam"), F.col("pfx"), F.col("ip")).alias("t")).collect()]
    assert got == ["10.0.0.7/24", "10.0.1.1/33", "2001:db8::/32", "0x01:02:03/8", "<invalid>/0", "110.1.2.3/32", "::/129", "1.2.3.4/0"]


@pytest.mark.parametrize("query,how,want", [
    ("", {}, range(8)), ("/24", {}, [0]), ("10.0.0.0/16", {}, [0, 7]), ("10.0.0.9/32", {}, [0, 7]), ("::/0", {}, [2]), ("10.", {}, [0, 1]), ("10.0.1.1.", {}, [1]), ("1", {}, [0, 1, 5, 7]),
    ("1.2.3.4.5", {}, []), (".1", {}, []), ("10..0", {}, []), ("db8", {}, [2]), ("FF", {}, []), ("/^1.*2.3/", {}, [5, 7]), ("/[/", {}, []), ("x01:02/", {}, []),
    ("invalid", {}, [4]), ("", {"fam": filters.INVALID}, [1, 3, 4, 6]), ("", {"fam": 4}, [0, 5, 7]), ("", {"fam": 6}, [2]), ("0x01", {}, [3]), ("2001:db8::1/128", {}, [2]),
])
def test_geoip_filters(entries, query, how, want):
    assert sorted(r["ord"] for r in filters.apply(entries, query, "geoip", **how).collect()) == list(want)


def test_spec_signatures():
    assert filters.parse_query(" /30 ", "geoip") == filters.parse_query("/30", "geoip") and not filters.parse_query("  ", "geoip").active
    assert filters.parse_query("/a/", "geosite").how == "regex" and filters.parse_query("10.0.0.0/8", "geosite").how == "text"


def test_keys_are_normalised(spark):
    rows = [(4, 24, bytes([1, 2, 3, 4])), (4, 24, bytes([1, 2, 3, 9])), (4, 33, bytes([1, 2, 3, 4])), (4, 33, bytes([1, 2, 3, 5])), (0, 1, b"a"), (0, 1, b"b"), (6, 64, b"a" * 16), (6, 64, b"a" * 8 + b"b" * 8)]
    df = spark.createDataFrame(rows, "fam byte, pfx short, ip binary").select(cidr.entry_key(F.col("fam"), F.col("pfx"), F.col("ip")).alias("k"))
    assert df.distinct().count() == 6
    attr = "array<struct<k:string,b:boolean,i:bigint>>"
    a, b, c = ("x", True, None), ("y", None, 1), ("x", None, 1)
    rules = spark.createDataFrame([([a, b],), ([b, a],), ([a, a, b],), ([c, b],), (None,), ([],)], f"attrs {attr}")
    assert rules.select(site.attrs_key(F.col("attrs")).alias("k")).distinct().count() == 4


def test_suffixes_and_hosts(spark):
    df = spark.createDataFrame([("a.b.c",), ("c",), (".b.c",), ("a..c",), ("a.",)], "v string")
    got = df.select(site.suffixes(F.col("v")).alias("s"), site.host_order(F.col("v")).alias("h")).collect()
    assert [r["s"] for r in got] == [["b.c", "c"], [], [], [".c", "c"], [""]] and got[0]["h"] == "c.b.a"


def test_rule_lines(spark):
    body = "Domain:A.example @ads @n=5 @f=x @\r\nplain.example # note\r\rtype9:v\ntype300:v\nregexp:^a(\nregex:^a.b$\nfull:\nweird:x\ngeosite:cn\nkeyword:k extra\nregexp:^https?://x\n  x  "
    rows = text.lines(spark.createDataFrame([(body,)], "b string"), [], F.col("b"))
    got = {r["line"]: r for r in text.parse_rules(rows, []).collect()}
    assert got[1]["type"] == 2 and got[1]["val"] == "A.example" and [(a["k"], a["b"], a["i"]) for a in got[1]["attrs"]] == [("ads", True, None), ("n", None, 5), ("f", True, None)]
    assert (got[2]["type"], got[2]["val"], got[2]["attrs"]) == (2, "plain.example", None)
    assert (got[4]["type"], got[4]["val"]) == (9, "v") and (got[5]["type"], got[5]["val"]) == (2, "type300:v")
    assert got[6]["error"].startswith("invalid regexp: ") and (got[7]["type"], got[7]["val"]) == (1, "^a.b$")
    assert got[8]["error"] == "empty value" and got[9]["val"] == "weird:x" and "reference" in got[10]["error"]
    assert got[11]["error"] == 'unexpected token "extra"' and got[12]["val"] == "^https?:" and got[13]["val"] == "x" and 3 not in got
    assert text.sniff(rows) == "geosite" and text.sniff(rows.filter("line = 3")) is None
    assert text.sniff_bytes("a.TXT", b"") and not text.sniff_bytes("a.dat", b"x") and text.sniff_bytes("a", b"hello\n")
    assert text.file_name("A b!C_d") == "a-b-c_d.txt"


def test_block_lines(spark):
    rows = text.lines(spark.createDataFrame([("1.2.3.4, x\n ::1/64;y\nnope\n,1.2.3.4\ninclude:X\ninclude:X @a\ninclude:X y\n# c",)], "b string"), [], F.col("b"))
    got = {r["line"]: r for r in text.parse_blocks(rows, []).collect()}
    assert (got[1]["fam"], got[1]["pfx"]) == (4, 32) and (got[2]["fam"], got[2]["pfx"]) == (6, 64) and got[3]["error"] == text.NO_BLOCK
    assert 4 not in got and got[5]["include"] == "X" and "@attributes" in got[6]["error"] and got[7]["error"] == 'unexpected token "y"'
    assert text.sniff(rows) == "geosite"  # a separator after an address makes it none
    assert text.sniff(rows.filter("line > 10")) is None
