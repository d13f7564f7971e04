"""A routing-rule file as a handle on two DataFrames, with versions: every edit makes a new one, undo and redo walk them.

DataFrames are lazy and immutable, so a version is a plan, not a copy.  Categories are few and their names are handled by the
driver; entries never reach it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.operators import diff, entries, filters, fold
from prefixloom.schema import CATEGORIES, GEOIP, GEOSITE
from prefixloom.sources import routedat, text

MOST_VERSIONS = 60


class Clash(ValueError):
    """Reverse and ordinary categories don't mix."""


@dataclass(frozen=True)
class Version:
    categories: DataFrame
    entries: DataFrame
    label: str


@dataclass
class Database:
    name: str
    kind: str
    now: Version
    done: list[Version] = field(default_factory=list)
    undone: list[Version] = field(default_factory=list)

    # making

    @classmethod
    def empty(cls, spark: SparkSession, name: str, kind: str) -> Database:
        schema = GEOIP if kind == "geoip" else GEOSITE
        return cls(name, kind, Version(spark.createDataFrame([], CATEGORIES), spark.createDataFrame([], schema), "new"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str | None = None) -> Database:
        kind = kind or routedat.kind_of(routedat.Window(path), path)
        cats = routedat.read_categories(spark, path, kind)
        return cls(path.rsplit("/", 1)[-1], kind, Version(cats, routedat.read_dat(spark, path, kind), "load"))

    @property
    def spark(self) -> SparkSession:
        return self.now.entries.sparkSession

    @property
    def categories(self) -> DataFrame:
        return self.now.categories

    @property
    def entries(self) -> DataFrame:
        return self.now.entries

    def names(self) -> list[tuple[int, str, bool]]:
        rows = self.categories.select("cat_ord", "name", "reverse").orderBy("cat_ord").collect()
        return [(r["cat_ord"], r["name"], bool(r["reverse"])) for r in rows]

    def slot(self, name: str) -> tuple[int, str, bool]:
        """The first category of a name, in any case."""
        for c in self.names():
            if c[1].upper() == name.upper():
                return c
        raise KeyError(name)

    def of(self, name: str) -> DataFrame:
        return self.entries.filter(F.col("cat_ord") == self.slot(name)[0])

    # versions

    def edit(self, label: str, categories: DataFrame | None = None, rows: DataFrame | None = None) -> Database:
        self.done = [*self.done, self.now][-MOST_VERSIONS:]
        self.undone = []
        rows = self.entries if rows is None else rows.select(self.entries.columns)
        self.now = Version(self.categories if categories is None else categories, rows, label)
        return self

    def undo(self) -> Database:
        if self.done:
            self.undone.append(self.now)
            self.now = self.done.pop()
        return self

    def redo(self) -> Database:
        if self.undone:
            self.done.append(self.now)
            self.now = self.undone.pop()
        return self

    # helpers

    def _others(self, *ords: int) -> DataFrame:
        return self.entries.filter(~F.col("cat_ord").isin(*ords)) if ords else self.entries

    def _with(self, cats: list[tuple[int, str, bool]]) -> DataFrame:
        rows = [(self.name, self.kind, o, n, r) for o, n, r in cats]
        return self.spark.createDataFrame(rows, CATEGORIES)

    def unique_name(self, base: str) -> str:
        return unique_name([n for _, n, _ in self.names()], base)

    def _placed(self, rows: DataFrame, ord_: int, name: str) -> DataFrame:
        return diff.in_slot(rows, self.name, ord_, name).select(self.entries.columns)

    def _added(self, rows: DataFrame, name: str, reverse: bool, label: str) -> Database:
        cats = self.names()
        at = max((o for o, *_ in cats), default=-1) + 1
        return self.edit(label, self._with([*cats, (at, name, reverse)]), self.entries.unionByName(self._placed(entries.renumbered(rows, keys=["cat_ord"]), at, name)))

    def _replaced(self, name: str, rows: DataFrame, label: str, reverse: bool | None = None) -> Database:
        at, own, old = self.slot(name)
        cats = [(o, n, (old if reverse is None else reverse) if o == at else r) for o, n, r in self.names()]
        return self.edit(label, self._with(cats), self._others(at).unionByName(self._placed(rows, at, own)))

    # queries

    def filter(self, query: str, type_: int | None = None, fam: int | None = None) -> DataFrame:
        return filters.apply(self.entries, query, self.kind, type_, fam)

    def stats(self) -> DataFrame:
        return entries.stats(self.entries, self.kind)

    def compare(self, other: Database, mode: str = "exact") -> DataFrame:
        if other is self or other.kind != self.kind:
            raise ValueError("compare two different files of one kind")
        return diff.file_diff(self.entries, self.categories, other.entries, other.categories, self.kind, mode)

    def category_diff(self, other: Database, name: str, mode: str = "exact") -> DataFrame:
        """Entries by side; where a file lacks the category, all of the other's are on one side."""
        a, b = self._of_or_none(name), other._of_or_none(name)
        if a is None or b is None:
            side, rows = ("onlyB", b) if a is None else ("onlyA", a)
            return rows.withColumn("side", F.lit(side))
        return diff.coverage_entries(a, b) if mode == "coverage" and self.kind == "geoip" else diff.exact_entries(a, b, self.kind)

    def _of_or_none(self, name: str) -> DataFrame | None:
        try:
            return self.of(name)
        except KeyError:
            return None

    # edits of entries

    def append(self, name: str, chunk: DataFrame, optimize: bool = False) -> Database:
        """Entries behind the category's own; its reverse stays."""
        at, own, _ = self.slot(name)
        rows = entries.concat([self.of(name), diff.in_slot(chunk, self.name, at, own)], self.name, at, own)
        if optimize:
            rows = fold.optimize(rows, self.kind, fold_rules=False)
        return self._replaced(name, rows, f"add to {own}")

    def delete(self, index: DataFrame) -> Database:
        """Entries by (cat_ord, ord)."""
        return self.edit("delete entries", rows=entries.remove(self.entries, index))

    def transfer(self, index: DataFrame, to: str, move: bool = False) -> Database:
        """Copy or move entries by (cat_ord, ord) to the end of a category, which is made if it isn't there."""
        chosen = self.entries.join(index.select("cat_ord", "ord"), ["cat_ord", "ord"], "left_semi").select(self.entries.columns)
        cats = self.names()
        found = next((c for c in cats if c[1].upper() == to.upper()), None)
        at, own, _ = found or (max((o for o, *_ in cats), default=-1) + 1, to, False)
        rest = entries.remove(self.entries, index) if move else self.entries
        target = entries.concat([rest.filter(F.col("cat_ord") == at), chosen], self.name, at, own).select(self.entries.columns)
        made = cats if found else [*cats, (at, own, False)]
        return self.edit(f"{'move' if move else 'copy'} to {own}", self._with(made), rest.filter(F.col("cat_ord") != at).unionByName(target))

    # edits of categories

    def new_category(self, base: str, chunk: DataFrame, reverse: bool = False) -> Database:
        name = self.unique_name(base)
        return self._added(diff.in_slot(chunk, self.name, 0, name), name, reverse, f"new {name}")

    def rename(self, name: str, to: str) -> Database:
        at = self.slot(name)[0]
        cats = [(o, to if o == at else n, r) for o, n, r in self.names()]
        return self.edit(f"rename {name}", self._with(cats), self.entries.withColumn("cat", F.when(F.col("cat_ord") == at, to).otherwise(F.col("cat"))))

    def duplicate(self, name: str) -> Database:
        _, own, reverse = self.slot(name)
        return self._added(self.of(name), self.unique_name(own), reverse, f"duplicate {own}")

    def clear(self, name: str) -> Database:
        return self.edit(f"clear {name}", rows=self._others(self.slot(name)[0]))

    def delete_categories(self, names: list[str]) -> Database:
        gone = [self.slot(n)[0] for n in names]
        return self.edit("delete categories", self._with([c for c in self.names() if c[0] not in gone]), self._others(*gone))

    def sort(self, name: str, how: str = "value") -> Database:
        return self._replaced(name, entries.sort(self.of(name), self.kind, how), f"sort {name}")

    def optimize(self, names: list[str] | None = None, **how) -> Database:
        """Optimise some categories, or all, in one plan and one version."""
        chosen = [self.slot(n)[0] for n in names] if names else [o for o, *_ in self.names()]
        part = self.entries.filter(F.col("cat_ord").isin(chosen))
        return self.edit("optimize", rows=self._others(*chosen).unionByName(fold.optimize(part, self.kind, **how).select(self.entries.columns)))

    def merge(self, names: list[str], to: str, **how) -> Database:
        """Concatenate and optimise categories; the result takes the first one's place.  Mixed reverse is refused."""
        chosen = [self.slot(n) for n in names]
        ords = [o for o, *_ in chosen]
        filled = {r["cat_ord"] for r in self.entries.filter(F.col("cat_ord").isin(ords)).select("cat_ord").distinct().collect()}
        some = [c for c in chosen if c[0] in filled]
        if self.kind == "geoip" and len({r for _, _, r in some}) > 1:
            raise Clash("the categories disagree on reverse")
        at, reverse = ords[0], (some or chosen)[0][2]
        rows = entries.concat([self.entries.filter(F.col("cat_ord") == o) for o in ords], self.name, at, to)
        rows = fold.optimize(rows, self.kind, **how)
        cats = [(o, to, reverse) if o == at else (o, n, r) for o, n, r in self.names() if o == at or o not in ords]
        return self.edit(f"merge into {to}", self._with(cats), self._others(*ords).unionByName(self._placed(rows, at, to)))

    def copy_to(self, name: str, other: Database) -> Database:
        """Into another file of the kind: behind a category of the name, or as a new one.  Mixed reverse is refused."""
        if other.kind != self.kind:
            raise ValueError("files of different kinds")
        _, own, reverse = self.slot(name)
        there = other._of_or_none(name)
        if there is None:
            return other._added(diff.in_slot(self.of(name), other.name, 0, own), own, reverse, f"copy {own}")
        if self.kind == "geoip" and other.slot(name)[2] != reverse and not there.isEmpty():
            raise Clash("the categories disagree on reverse")
        return other.append(name, self.of(name))

    def apply_diff(self, other: Database, name: str, what: str = "both", mode: str = "exact") -> Database:
        """Make this file's category hold what the other's does: add, remove or both; a missing category is copied."""
        there = other.of(name)
        if self._of_or_none(name) is None:
            return other.copy_to(name, self)
        at, own, _ = self.slot(name)
        return self._replaced(name, diff.apply_diff(self.of(name), there, self.kind, what, mode, self.name, at, own), f"apply {what} to {own}")

    def from_diff(self, other: Database, name: str, side: str = "both", mode: str = "exact") -> Database:
        """A new category NAME-DIFF of the entries on one side, or on both."""
        sides = {"both": ["onlyA", "onlyB"], "a": ["onlyA"], "b": ["onlyB"]}[side]
        rows = self.category_diff(other, name, mode).filter(F.col("side").isin(sides))
        if "ord" not in rows.columns:
            rows = entries.renumbered(rows.withColumn("cat_ord", F.lit(0)), "side", "fam", "ip", "pfx", keys=["cat_ord"])
        own = self.slot(name)[1] if self._of_or_none(name) is not None else name
        return self.new_category(f"{own}-DIFF", rows.drop("side"))

    # numbers of the file

    def counts(self) -> tuple[int, int]:
        """(entries, entries that are not routable)"""
        row = entries.counts(self.entries, self.kind).agg(F.sum("entries").alias("n"), F.sum("bad").alias("bad")).first()
        return row["n"] or 0, row["bad"] or 0

    # writing

    def _chosen(self, names: list[str] | None) -> tuple[DataFrame, DataFrame]:
        if not names:
            return self.categories, self.entries
        chosen = [self.slot(n)[0] for n in names]
        return self.categories.filter(F.col("cat_ord").isin(chosen)), self.entries.filter(F.col("cat_ord").isin(chosen))

    def file_name(self, names: list[str] | None = None) -> str:
        """The name that an exported file has: `.dat` is added where it is missing, a choice of categories is a subset."""
        base = self.name[:-4] if self.name.lower().endswith(".dat") else self.name
        return f"subset-{base}.dat" if names else self.name if base != self.name else f"{base}.dat"

    def export_dat(self, path: str, names: list[str] | None = None) -> None:
        cats, rows = self._chosen(names)
        if cats.isEmpty():
            raise ValueError(f"{self.name} holds no category to write")
        routedat.write_dat(rows, cats, self.kind, path)

    def export_into(self, folder: str, names: list[str] | None = None) -> str:
        """export_dat() under the file's own name; gives the path."""
        path = f"{folder.rstrip('/')}/{self.file_name(names)}"
        self.export_dat(path, names)
        return path

    def to_bytes(self, folder: str) -> bytes:
        """The whole file's bytes, written under `folder` first; a file without categories is refused."""
        return routedat.load_bytes(self.export_into(folder))

    def export_text(self, path: str, name: str | None = None) -> None:
        text.write_text(self.of(name) if name else self.entries, self.kind, path, headed=name is None)

    def export_text_into(self, folder: str, name: str | None = None) -> str:
        """export_text() under the category's file name, or the file's with `.txt` for its ending; gives the path."""
        path = f"{folder.rstrip('/')}/{text.file_name(name) if name else self.name.rpartition('.')[0] or self.name}"
        path = path if path.endswith(".txt") else f"{path}.txt"
        self.export_text(path, name)
        return path

    def export_diff(self, other: Database, name: str, path: str, mode: str = "exact", side: str = "both") -> None:
        """A category's differences as text: a title, only this file's lines with `-`, then only the other's with `+`."""
        rows = self.category_diff(other, name, mode)
        kept = {"both": ["onlyA", "onlyB"], "a": ["onlyA"], "b": ["onlyB"]}[side]
        text.write_diff(rows.filter(F.col("side").isin(kept)), self.kind, path, text.diff_title(name, self.name, other.name, mode))


@dataclass
class Session:
    """Several files at once, one of them active; a file that is loaded under a name replaces the one that had it."""

    spark: SparkSession
    files: list[Database] = field(default_factory=list)
    at: int = -1

    @property
    def active(self) -> Database | None:
        return self.files[self.at] if 0 <= self.at < len(self.files) else None

    def file(self, name: str) -> Database:
        for db in self.files:
            if db.name == name:
                return db
        raise KeyError(name)

    def add(self, db: Database, replace: bool = False) -> Database:
        """A file behind the others, which becomes active; with replace, files of its name go first."""
        if replace:
            self.files = [f for f in self.files if f.name != db.name]
        self.files.append(db)
        self.at = len(self.files) - 1
        return db

    def new(self, name: str, kind: str) -> Database:
        return self.add(Database.empty(self.spark, name, kind))

    def switch(self, name: str) -> Database:
        self.at = self.files.index(self.file(name))
        return self.files[self.at]

    def close(self, name: str, discard: bool = False) -> None:
        """Close a file; one with edits since it was loaded is refused unless they are to be discarded."""
        db, was = self.file(name), self.active
        if db.done and not discard:
            raise ValueError(f"{name} has unsaved edits")
        self.files = [f for f in self.files if f is not db]
        self.at = next((i for i, f in enumerate(self.files) if f is was), len(self.files) - 1)

    def load(self, path: str, kind: str | None = None) -> Database:
        return self.add(Database.load(self.spark, path, kind), replace=True)

    def load_many(self, paths: list[str]) -> list[Database]:
        """Files of either form: binary ones in order, then all texts together, which may include from each other and from the
        active file.  The kind of a file is found out by its ending or its first bytes."""
        texts, out = {}, []
        for path in paths:
            name, raw = path.rstrip("/").rpartition("/")[2], routedat.Window(path)
            if text.sniff_bytes(name, raw):
                texts[name] = routedat.load_bytes(path).decode("utf-8", "replace")
            else:
                out.append(self.add(Database.load(self.spark, path)))
        for db in import_texts(self.spark, texts, self.active) if texts else []:
            out.append(db if any(db is f for f in self.files) else self.add(db))
        return out


def unique_name(names: list[str], base: str) -> str:
    taken = {n.upper() for n in names}
    if base.upper() not in taken:
        return base
    n = 2
    while f"{base}-{n}".upper() in taken:
        n += 1
    return f"{base}-{n}"


def _leads_to(known: dict[str, tuple[str, str]]) -> dict[str, frozenset]:
    """Names that a text includes, or that those include, and so on."""
    direct = {k: text.mentioned(body).keys() & known.keys() for k, (_, body) in known.items()}
    out = {}
    for k in known:
        seen, todo = set(), [k]
        while todo:
            todo += [x for x in direct[todo.pop()] if x not in seen and not seen.add(x)]
        out[k] = frozenset(seen)
    return out


def parse_text(
    spark: SparkSession, body: str, kind: str, db: Database | None = None, own: str | None = None, known: dict | None = None,
    open_: frozenset = frozenset(), read: dict | None = None,
):
    """(entries with ord, errors, includes) of a text.  Included names are looked up among `known` texts first (name ->
    (kind, body)), then in db; a name that is being read already is a line error.  `read` keeps what was
    read, by name and by those open names that it leads to, so a text that many include is read once."""
    read = {"": _leads_to(known or {})} if read is None else read
    rows = text.lines(spark.createDataFrame([(body,)], "body string"), [], F.col("body"))
    parsed = text.parse_rules(rows, []) if kind == "geosite" else text.parse_blocks(rows, [])
    asked = text.mentioned(body)
    cats, parts, loops = [], [], {}
    for i, key in enumerate(sorted(asked)):
        if known and key in known and known[key][0] == kind:
            if key in open_:
                loops[key] = f"include of {asked[key]} within itself, by way of others"
                continue
            place = (key, open_ & read[""][key])
            if place not in read:
                read[place] = parse_text(spark, known[key][1], kind, db, None, known, open_ | {key}, read)[0]
            got = read[place]
            cats.append((i, key, False))
        elif db is not None and db.kind == kind and (got := db._of_or_none(key)) is not None:
            if own and own.upper() == key:
                loops[key] = "include of the category that is being read"
                continue
            _, name, reverse = db.slot(key)
            cats.append((i, name, reverse))
        else:
            continue
        parts.append(diff.in_slot(got, "", i, key))
    if loops:
        fault = F.lit(None).cast("string")
        for key, msg in loops.items():
            fault = F.when(F.upper("include") == key, F.lit(msg)).otherwise(fault)
        parsed = parsed.withColumn("error", F.coalesce("error", fault)).withColumn("include", F.when(F.col("error").isNull(), F.col("include")))
    categories = spark.createDataFrame(cats, "cat_ord int, name string, reverse boolean")
    schema = GEOIP if kind == "geoip" else GEOSITE
    source = spark.createDataFrame([], schema)
    for p in parts:
        source = source.unionByName(p, allowMissingColumns=True)
    return text.expand_includes(parsed, source, categories, kind, [])


def import_texts(spark: SparkSession, texts: dict[str, str], active: Database | None = None) -> list[Database]:
    """Texts by file name, together: kinds are found out (the first known one, else the active file's, else geosite, stands for
    unknown ones), names are base names in upper case, includes go across the batch.  Texts of the active file's kind become
    categories of it, others files of their own."""
    kinds = {n: text.sniff_text(b) for n, b in texts.items()}
    guess = next((k for k in kinds.values() if k), active.kind if active else "geosite")
    known = {n.rpartition(".")[0].upper() if "." in n else n.upper(): (kinds[n] or guess, b) for n, b in texts.items()}
    out, read = [], {"": _leads_to(known)}
    for key, (kind, body) in known.items():
        rows, _, _ = parse_text(spark, body, kind, active, None, known, frozenset({key}), read)
        db = active if active is not None and active.kind == kind else Database.empty(spark, key.lower(), kind)
        out.append(db.new_category(key, rows))
    return out


JOBS = ("parse", "write", "optimize", "sort", "merge", "append", "stats", "fileDiff", "catDiff")


def run(job: str, db: Database | None = None, **p):
    """The nine verbs by name."""
    if job == "parse":
        return Database.load(p["spark"], p["path"], p.get("kind"))
    verbs = {
        "write": lambda: db.export_dat(p["path"], p.get("names")), "optimize": lambda: db.optimize(p.get("names"), **p.get("how", {})),
        "sort": lambda: db.sort(p["name"], p.get("how", "value")), "merge": lambda: db.merge(p["names"], p["to"], **p.get("how", {})),
        "append": lambda: db.append(p["name"], p["chunk"], p.get("optimize", False)), "stats": lambda: db.stats(),
        "fileDiff": lambda: db.compare(p["other"], p.get("mode", "exact")),
        "catDiff": lambda: db.category_diff(p["other"], p["name"], p.get("mode", "exact")),
    }
    if job not in verbs:
        raise ValueError(f"unknown job: {job}")
    return verbs[job]()


def percent_saved(before: int, after: int) -> str:
    return f"{(before - after) * 100 / before:.1f}%" if before else "0%"


def number_text(n: float) -> str:
    """A count with a comma between thousands."""
    return f"{round(n):,}"


def bytes_text(n: int) -> str:
    return f"{n} B" if n < 1 << 10 else f"{n / (1 << 10):.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.2f} MB"


def snapshot(db: Database) -> Database:
    """An independent handle on the same version."""
    return replace(db, done=[], undone=[])
