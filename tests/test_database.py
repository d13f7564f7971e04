"""Binary files, versions, edits, includes, comparison and folding."""

import random

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import cidr
from prefixloom.operators import diff, entries, fold
from prefixloom.plans.database import JOBS, Clash, Database, import_texts, parse_text, run, unique_name
from prefixloom.sources import routedat, text

ATTRS = "array<struct<k:string,b:boolean,i:bigint>>"


def site_file(cats):
    return b"".join(routedat.category_bytes(n, b"".join(routedat.rule_bytes(*r) for r in rules), False) for n, rules in cats)


def ip_file(cats):
    return b"".join(routedat.category_bytes(n, b"".join(routedat.block_bytes(f, p, ip) for f, p, ip in rows), rev) for n, rows, rev in cats)


SITES = [
    ("EMPTY", []), ("Ä" * 70, [(2, "a.example", None), (0, "", None), (3, "x" * 300, [{"k": "ads", "b": True, "i": None}, {"k": "ads", "b": None, "i": -3}, {"k": "f", "b": False, "i": None}])]),
    ("big", [(i % 6, f"host{i}.example", None) for i in range(900)]),
]
BLOCKS = [
    ("CORRUPT", [(0, 24, b"\x01\x02\x03\x04\x05"), (4, 64, bytes([10, 0, 0, 0])), (4, 24, bytes([1, 2, 3, 4])), (0, 0, b""), (0, 9, b"z" * 200)], False),
    ("REV", [(6, 32, bytes(range(16)))], True), ("HUGE", [(4, 20 + i % 13, i.to_bytes(4, "big")) for i in range(3000)], False),
]


@pytest.mark.parametrize("kind,raw", [("geosite", site_file(SITES)), ("geoip", ip_file(BLOCKS))])
@pytest.mark.parametrize("split", [200, 1 << 22])
def test_byte_identity(spark, tmp_path, kind, raw, split):
    src, out = tmp_path / "a.dat", tmp_path / "b.dat"
    src.write_bytes(raw)
    assert routedat.sniff(raw) in (kind, None) and routedat.kind_of(raw, f"my-{kind}.dat") == kind
    spark.dataSource.register(routedat.RouteDat)
    rows = spark.read.format("routedat").option("kind", kind).option("split", split).load(str(src))
    cats = routedat.read_categories(spark, str(src), kind)
    assert rows.rdd.getNumPartitions() > 10 if split == 200 else rows.rdd.getNumPartitions() == 1  # small categories share a task
    routedat.write_dat(rows.repartition(5), cats, kind, f"file://{out}")
    assert out.read_bytes() == raw and sorted(p.name for p in tmp_path.iterdir()) == ["a.dat", "b.dat"]


def test_decoder_limits():
    assert routedat.block(b"\x10\xff\x7f", 0, 3) == (0, 255, b"")
    assert routedat.rule(b"\x08\x83\x02\x12\x01x\x3a\x01y", 0, 9)[:2] == (3, "x")
    for bad in (b"\x0a\x05ab", b"\x0b", b"\x80"):
        with pytest.raises(ValueError):
            list(routedat.fields(bad, 0, len(bad)))
    assert routedat.sniff(b"\x0a\x05ab") is None and routedat.sniff(b"") is None
    with pytest.raises(ValueError):
        routedat.kind_of(b"", "nothing.dat")


def test_kind_behind_an_odd_first_entry():
    odd, four = routedat.block_bytes(0, 8, bytes(3)), routedat.block_bytes(4, 24, bytes(4))
    rule = routedat.rule_bytes(2, "a.b", None)
    file = lambda *e: routedat.category_bytes("A", b"".join(e), False)
    assert routedat.sniff(file(odd, four)) is None
    assert routedat.kind_of(file(odd, four), "x.dat") == routedat.kind_of(file(odd), "x.dat") == "geoip"
    assert routedat.kind_of(file(b"\x12\x00", rule), "x.dat") == routedat.kind_of(file() + file(rule), "x.dat") == "geosite"
    assert routedat.kind_of(file(odd, four), "my-geosite.dat") == "geosite"  # a name counts before later entries
    with pytest.raises(ValueError):
        routedat.kind_of(file(b"\x12\x00"), "x.dat")


def rules(spark, rows, cat="C", at=0):
    full = [("f", at, cat, i, t, v, a) for i, (t, v, a) in enumerate(rows)]
    return spark.createDataFrame(full, f"file string, cat_ord int, cat string, ord long, type short, val string, attrs {ATTRS}")


ADS = [("ads", True, None)]


@pytest.mark.parametrize("rows,keyword,kept", [
    ([(2, "example.com", None), (2, "a.example.com", None), (3, "example.com", None), (3, "xexample.com", None), (2, "com", ADS)], False, [0, 3, 4]),
    ([(2, "com", ADS), (2, "a.com", None)], False, [0, 1]), ([(2, "a.com", []), (3, "a.com", None)], False, [0, 1]), ([(2, "Example.com", None), (3, "a.example.com", None)], False, [0, 1]),
    ([(0, "goo", None), (0, "google", None), (2, "goo", None), (3, "x.google.com", None), (1, "goo", None), (9, "goo", None)], True, [0, 4, 5]),
    ([(0, "goo", None), (2, "google.com", None)], False, [0, 1]), ([(0, "", None), (2, "a.b", None)], True, [0, 1]), ([(2, "b", None), (3, ".b", None), (3, "a.b", None)], False, [0, 1]),
    ([(0, "ab", None), (3, "xaby", None), (0, "ab", None)], True, [0, 2]), ([(0, "é字", None), (2, "x.é字.y", None), (0, "y", None)], True, [0, 2]),
])
def test_fold_never_widens(spark, rows, keyword, kept):
    df = rules(spark, rows)
    assert sorted(r["ord"] for r in fold.fold(df, keyword=keyword).collect()) == kept
    assert fold.missing(fold.fold(df, keyword=keyword), df, keyword=keyword).isEmpty()


def test_missing_ignores_case_but_not_attributes(spark):
    have = rules(spark, [(2, "Example.COM", None), (0, "Goo", None), (3, "q", ADS)])
    want = rules(spark, [(3, "a.example.com", None), (3, "xgoox", None), (3, "q", ADS), (3, "q", None), (2, "example.com", ADS), (1, "goo", None)])
    assert sorted(r["ord"] for r in fold.missing(have, want, keyword=True).collect()) == [3, 4, 5]


def test_optimize_blocks_keeps_invalid_and_coverage(spark):
    rng = random.Random(3)
    rows = [(4, rng.randint(20, 32), (10 << 24 | rng.randrange(1 << 14)).to_bytes(4, "big")) for _ in range(400)] + [(0, 5, b"abc"), (4, 40, bytes(4)), (6, 64, bytes(16)), (6, 65, bytes(16))]
    df = spark.createDataFrame([("f", 0, "C", i, *r) for i, r in enumerate(rows)], "file string, cat_ord int, cat string, ord long, fam byte, pfx short, ip binary")
    once = fold.optimize(df, "geoip").cache()
    got = once.orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(len(got)))
    assert [(r["fam"], r["pfx"], bytes(r["ip"])) for r in got[-2:]] == rows[400:402] and (got[-3]["fam"], got[-3]["pfx"]) == (6, 64)
    assert [tuple(r) for r in fold.optimize(once, "geoip").orderBy("ord").collect()] == [tuple(r) for r in got]
    summary = diff.coverage_summary(df, once, ["cat"]).first()
    assert summary["onlyA"] == summary["onlyB"] == 0 and summary["common"] == len(got) - 2
    s = entries.stats(df, "geoip", ["cat"]).first()
    assert (s["v4"], s["v6"], s["bad"], s["optimal"]) == (400, 2, 2, len(got) - 2)


def ip_db(spark, name, cats):
    rows = [(name, o, n, i, *r) for o, (n, _, rs) in enumerate(cats) for i, r in enumerate(rs)]
    db = Database.empty(spark, name, "geoip")
    db.edit("fill", db._with([(o, n, rev) for o, (n, rev, _) in enumerate(cats)]), spark.createDataFrame(rows, db.entries.schema))
    return db


def net(t):
    return cidr.parsed(t)


A = [("ONE", False, [net("10.0.0.0/24"), net("10.0.1.0/24"), net("10.0.0.9/24"), (0, 1, b"q")]), ("TWO", True, [net("1.1.1.1")]), ("one", False, [net("9.9.9.9")]), ("NIL", False, [])]
B = [("One", False, [net("10.0.0.0/23"), net("::/8")]), ("Two", False, [net("1.1.1.1")]), ("NEW", False, [net("8.8.8.8"), net("8.8.8.8")])]


def test_file_diff(spark):
    a, b = ip_db(spark, "a", A), ip_db(spark, "b", B)
    rows = {r["name"]: r for r in a.compare(b).collect()}
    one = rows["ONE"]
    assert (one["na"], one["nb"], one["onlyA"], one["onlyB"], one["common"], one["status"], one["dupA"], one["unit"]) == (4, 2, 3, 2, 0, "changed", 2, "entries")
    assert rows["TWO"]["status"] == "changed" and rows["TWO"]["reverseChanged"] and rows["TWO"]["common"] == 1
    new, nil = rows["NEW"], rows["NIL"]
    assert (new["na"], new["nb"], new["onlyB"], new["status"], new["unit"]) == (-1, 2, 2, "added", None) and (nil["status"], nil["onlyA"], nil["nb"]) == ("removed", 0, -1)
    cover = {r["name"]: r for r in a.compare(b, "coverage").collect()}["ONE"]
    assert (cover["onlyA"], cover["onlyB"], cover["common"], cover["unit"], cover["status"]) == (0, 1, 1, "blocks", "changed")
    t = diff.totals(a.compare(b)).first()
    assert (t["changed"], t["added"], t["removed"]) == (4, 1, 1) and diff.table_rows(a.compare(b), limit=2).count() == 2
    with pytest.raises(ValueError):
        a.compare(a)


@pytest.mark.parametrize("mode", ["exact", "coverage"])
def test_apply_leaves_no_residue(spark, mode):
    a, b = ip_db(spark, "a", A), ip_db(spark, "b", B)
    a.apply_diff(b, "one", "both", mode)
    left = {r["name"].upper(): r for r in a.compare(b, mode).collect()}["ONE"]
    assert left["status"] == "same"
    if mode == "coverage":
        assert a.of("ONE").filter("fam = 0").count() == 1
    a.undo().apply_diff(b, "NEW")
    assert a.of("new").count() == 2 and a.undo().names()[-1][1] == "NIL"
    add = ip_db(spark, "a", A).apply_diff(b, "one", "add", mode).compare(b, mode).filter("upper(name) = 'ONE'").first()
    rem = ip_db(spark, "a", A).apply_diff(b, "one", "remove", mode).compare(b, mode).filter("upper(name) = 'ONE'").first()
    assert add["onlyB"] == 0 and rem["onlyA"] == 0
    made = ip_db(spark, "a", A).from_diff(b, "ONE", "both", mode)
    assert made.names()[-1][1] == "ONE-DIFF" and made.of("ONE-DIFF").count() == (5 if mode == "exact" else 1)


def test_edits_and_versions(spark, tmp_path):
    db = ip_db(spark, "a", A)
    size = lambda: {n: db.of(n).count() for _, n, _ in db.names() if n != "one"}
    start = size()
    db.rename("TWO", "2").duplicate("2").clear("NIL").delete_categories(["2"])
    assert [n for _, n, _ in db.names()] == ["ONE", "one", "NIL", "2-2"] and db.slot("2-2")[2]
    db.undo().undo().undo().undo()
    assert size() == start and len(db.undone) == 4
    db.redo().rename("ONE", "uno")
    assert not db.undone
    db.undo().undo()
    pick = db.of("ONE").filter("ord in (0, 3)").select("cat_ord", "ord")
    db.transfer(pick, "FRESH", move=True)
    assert [(r["ord"], r["fam"]) for r in db.of("FRESH").orderBy("ord").collect()] == [(0, 4), (1, 0)] and [r["ord"] for r in db.of("ONE").orderBy("ord").collect()] == [0, 1]
    db.undo().transfer(pick, "TWO")
    assert db.of("TWO").count() == 3 and db.of("ONE").count() == 4
    db.undo().delete(pick)
    assert db.of("ONE").count() == 2
    db.undo().append("ONE", db.of("TWO"), optimize=True)
    assert [cidr.v6_string(bytes(16)), *[bytes(r["ip"]) for r in db.of("ONE").orderBy("ord").collect()]][1:] == [bytes([1, 1, 1, 1]), bytes([10, 0, 0, 0]), b"q"]
    db.undo()
    with pytest.raises(Clash):
        db.merge(["ONE", "TWO"], "X")
    db.merge(["ONE", "NIL"], "X")
    assert [n for _, n, _ in db.names()] == ["X", "TWO", "one"] and db.of("X").count() == 2
    db.undo()
    other = ip_db(spark, "b", B)
    with pytest.raises(Clash):
        db.copy_to("TWO", other)
    db.copy_to("NIL", other)
    assert other.names()[-1][1] == "NIL"
    db.sort("ONE").optimize(["ONE"])
    assert db.of("ONE").count() == 2
    db.export_text(f"file://{tmp_path}/t")
    out = [r["value"] for r in spark.read.text(f"file://{tmp_path}/t").collect()]
    assert sorted(out) == sorted(["# ONE (2)", "10.0.0.0/23", "0x71/1", "", "# TWO (1)", "1.1.1.1/32", "", "# one (1)", "9.9.9.9/32"])
    for _ in range(70):
        db.edit("nothing")
    assert len(db.done) == 60
    marked = [r["line"] for r in text.diff_lines(diff.exact_entries(db.of("TWO"), other.of("NEW"), "geoip"), "geoip").collect()]
    assert sorted(marked) == ["+8.8.8.8/32", "-1.1.1.1/32"] and text.diff_title("X", "a", "b", "exact") == "# X: a vs b (exact)"


def test_jobs(spark, tmp_path):
    db = ip_db(spark, "a", A)
    assert len(JOBS) == 9
    run("write", db, path=f"file://{tmp_path}/x.dat")
    back = run("parse", spark=spark, path=f"file://{tmp_path}/x.dat")
    assert back.kind == "geoip" and back.names() == db.names() and back.entries.count() == db.entries.count()
    assert run("stats", db).count() == 3 and run("fileDiff", db, other=back).filter("status <> 'same'").isEmpty()
    assert run("catDiff", db, other=back, name="ONE").filter("side <> 'common'").isEmpty()
    run("sort", db, name="ONE"), run("optimize", db), run("append", db, name="ONE", chunk=back.of("TWO")), run("merge", db, names=["ONE", "NIL"], to="M")
    assert db.of("M").count() > 0
    with pytest.raises(ValueError):
        run("nothing", db)
    assert unique_name(["a", "A-2"], "A") == "A-3" and unique_name([], "x") == "x"


def test_includes(spark):
    db = Database.empty(spark, "f", "geosite")
    rows = rules(spark, [(2, "a", ADS), (2, "b", [("cn", True, None)]), (3, "c", ADS + [("cn", None, 1)]), (0, "d", None)])
    db.new_category("SRC", rows)
    got, errors, included = parse_text(spark, "full:first\ninclude:src @ads @-cn\nlast\ninclude:\ninclude:none\ninclude:SRC", "geosite", db)
    assert [r["val"] for r in got.orderBy("ord").collect()] == ["first", "a", "last", "a", "b", "c", "d"]
    assert [(r["line"], r["msg"]) for r in errors.orderBy("line").collect()] == [(4, "include: without a name"), (5, "include of an unknown category: none")]
    assert sorted((r["line"], r["name"], r["n"]) for r in included.collect()) == [(2, "SRC", 1), (6, "SRC", 4)]
    _, errors, _ = parse_text(spark, "include:SRC", "geosite", db, own="src")
    assert errors.first()["msg"] == "include of the category that is being read"
    rev = ip_db(spark, "r", A)
    _, errors, _ = parse_text(spark, "include:two", "geoip", rev)
    assert errors.first()["msg"] == "include of a reverse category: TWO"


def test_batch_import(spark):
    texts = {"one.txt": "domain:x\ninclude:two", "two.txt": "full:y\ninclude:one", "ips.list": "1.2.3.4\n", "blank.txt": "# nothing"}
    dbs = import_texts(spark, texts)
    assert [(d.kind, d.names()[0][1], [r["val" if d.kind == "geosite" else "pfx"] for r in d.entries.orderBy("ord").collect()]) for d in dbs] == [
        ("geosite", "ONE", ["x", "y"]), ("geosite", "TWO", ["y", "x"]), ("geoip", "IPS", [32]), ("geosite", "BLANK", []),
    ]


def test_stream(spark, tmp_path):
    from prefixloom.streaming.incremental import current, keep_optimal, new_entries

    src = f"file://{tmp_path}/in"
    rows = ip_db(spark, "a", A).entries.filter("cat = 'ONE'")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = keep_optimal(stream, "geoip", f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert current(spark, f"file://{tmp_path}/out", 0).count() == 2
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("ord")))
    q = new_entries(timed, "geoip", "at").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("fresh").count() == 3
