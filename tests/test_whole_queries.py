"""Queries over whole views against brute force on a small table of events."""

import ipaddress

import duckdb

from prefixloom import catalog
from prefixloom.operators import ranges
from prefixloom.plans import views


def events(spark, tmp_path):
    """Rows of (event_id, event_type, user_id); dense ids, so that blocks contain each other at every prefix."""
    rows = [(i, "view" if i % 3 else "click", i * 7 % 40) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    return rows


def test_containment_join_all(spark, tmp_path):
    nets = [(i, 167772160 + (u * 7919 + i * 131) % 65536, 26 + i % 7) for i, _, u in events(spark, tmp_path)]
    want = sorted((i, m, q) for i, n, p in nets for _, m, q in nets if q <= p and n >> (32 - q) == m >> (32 - q))
    got = sorted((r["ord"], r["outer_num"], r["outer_pfx"]) for r in catalog.QUERIES["containment_join_all"](spark, str(tmp_path)).collect())
    assert got == want
    prefixes = {(p, q) for i, _, p in nets for j, _, q in want if i == j}
    assert {p for p, _ in prefixes} == set(range(26, 33)) == {q for _, q in prefixes}


def test_filter_v6_all(spark, tmp_path):
    rows = [(t, i, u % 16, (u * 7919 + i * 131) % 65536) for i, t, u in events(spark, tmp_path)]
    text = lambda u, x: str(ipaddress.IPv6Address((0x20010DB8 << 96) + (u << 64) + x))
    want = sorted((t, i) for t, i, u, x in rows if "a1" in text(u, x))
    got = sorted((r["cat"], r["ord"]) for r in catalog.QUERIES["filter_v6_all"](spark, str(tmp_path)).collect())
    assert got == want
    assert {u == 0 for t, i, u, x in rows if (t, i) in set(want)} == {True, False}


def test_containment_join_broadcasts_prefixes_alone(spark, tmp_path):
    """However small the files look, ancestors are joined by sorting; the rows of a block of all addresses too."""
    events(spark, tmp_path)
    query = catalog.QUERIES["containment_join_all"](spark, str(tmp_path))
    plan = query._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan
    rows = spark.createDataFrame([(i, i * 65537 % 2**32, 16 + i % 17) for i in range(3000)], "ord long, num long, pfx int")
    blocks = spark.createDataFrame([(0, 0), (0, 0), (65537 * 8, 24)], "num long, pfx int")
    got = ranges.covering(rows, blocks).groupBy("block.pfx").count().collect()
    inside = sum(1 for i in range(3000) if 16 + i % 17 >= 24 and i * 65537 % 2**32 >> 8 == 65537 * 8 >> 8)
    assert dict(map(tuple, got)) == {0: 6000, 24: inside} and inside


def test_ip_dat_roundtrip_begins_with_an_odd_address(spark, tmp_path):
    """The lowest category's first entry has an address of three bytes, which tells no kind; those behind it do."""
    rows = [(13 * (1 + i // 5) if i % 5 == 0 else 1000 + i, "signup", i % 40) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["ip_dat_roundtrip"](spark, str(tmp_path)).orderBy("ord").collect()
    want = views.mixed(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"], r["fam"], r["pfx"], r["ip"]) for r in got] == [(i, r["fam"], r["pfx"], bytes(r["ip"]).hex().upper()) for i, r in enumerate(want)]
    assert got[0]["fam"] == 0 and len(got) == 200


def test_compare_table_shows_equal_categories(spark, tmp_path):
    """Categories that both files hold alike are among the first names, as in the SQL."""
    rows = [(i, f"https://host.example/{i}") for i in range(840)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.SQL["compare_table"]).fetchall()
    got = catalog.QUERIES["compare_table"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) == [("C0", 1), ("C1", 2)]
