"""Operator 5, n-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Documents are sets of 64-bit hashes of word shingles.  Sets fall into size bands whose ends differ by the threshold, so linked sets
lie in one band or in neighbours; every set is signed for its own band and the next.  In a band with largest size u,
two linked sets differ in k = floor(2u(1-t)/(1+t)) elements at most.  The feature domain is dealt by hash to n1 groups of
n2 partitions with n1 = ceil((k+1)/(k2+1)): some group then has at most k2 partitions in which the two sets
differ, so they agree on some n2-k2 of its n2 partitions.  A signature is a hash of the set's elements in
such a subset of partitions; all subsets of all groups are enumerated.

signatures=None is that scheme whole: every group's signatures, those of empty projections too, so no linked pair can be missed.
It costs signatures in proportion to a set's size, and sets that lack a partition meet under its empty projection.

A number of signatures departs from it twice, both for cost.  Signatures of empty projections are left out, and of a set with many
groups only those of the first groups are made, `signatures` in all; a set with few groups is signed under several independent domain
partitions until it has as many.  As domains are dealt by hash, a linked pair shares none of them with a probability of
about (1 - t**4)**signatures: 3e-11 at similarity 0.75 exactly and 64 signatures, and less for closer pairs; besides that
the join is exact.  Every candidate is checked with its whole sets.

Frequent shingles.  A passage in very many documents would bring them together under every signature that it fills by
itself.  Shingles are dealt by hash to 2**21 cells, and all documents are counted that hold a shingle of a cell, so that a cell's count is
never less than a shingle's.  Shingles of cells with `frequent` documents or more of every `per` (and with four times the mean, where long
texts fill all cells) are
left out of signatures: two sets that agree on a partition agree on it without them too.  Sets that hold many of them (two fifths) are signed with them as
well, so copies of a frequent text still meet.  Partitions that hold frequent shingles alone give no signature then, so sets just
under two fifths miss each other more often: simulated with this signer at similarity 0.75 (a set within another, in neighbouring
bands, 16 signatures, carried on to 64), 6e-12 instead of 3e-14 for sets of 2,065 shingles, which the figure above still covers.

No pair explosion: copies (equal sets) are one node; a signature's sets are first checked against their smallest
one only, and components formed; then only sets of one signature in *different* components are checked against
each other, which an exact join has to do.  Before either, a bound prunes: shingles that no other candidate holds can't be shared, so
a set with many of its own can link with nothing, and most pairs can't link however much they share otherwise.
Sets travel only for nodes that this leaves.  Signatures of up to `group` such sets give pairs, at most group / 2 a row.  The sets of
larger ones are dealt to blocks of bounded size, sets of one large signature together, and two blocks meet once however many signatures
they share: the task of a block pair counts common shingles through an inverted list and gives back a spanning forest of the links
that it finds, at most a row a set, never the pairs.

Null and empty texts, and texts without words, have no shingles and link with nothing.  Texts shorter than a shingle are
one shingle of all their words.  Rows that share an id are separate documents; null ids don't count in the smallest id
unless a component has no other.  Empty
tables give empty results.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, dropped, heaps_collected, idle_memory, key_bitmap, maybe_flag, maybe_in, released, small_batches, text_or_empty, written

MANY_FREQUENT = 0.4
#: Sets that a task remembers, so as not to give the same one twice; later ones are told apart after the shuffle.
REMEMBERED = 100_000
U64 = np.uint64
SIG_BITS = 26
#: Cells that shingles are counted by, and how many a row of counts has: 16 KB.
CELLS, CELL_PAGE = 1 << 21, 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self.factors = mix(np.arange(1, words + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes.  bytes.lower() and bytes.split() know A-Z and the six ASCII spaces only."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, dtype=U64)
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=U64, count=len(found))
        n = len(w) - self.words + 1
        if n < 1:
            return mix(np.atleast_1d((w * self.factors[: len(w)]).sum(dtype=U64) + U64(len(w))))
        h = w[:n] * self.factors[0]
        for j in range(1, self.words):
            h += w[j : j + n] * self.factors[j]
        return np.unique(mix(h))


class PartEnum:
    def __init__(self, threshold_percent: int, signatures: int | None, n2: int, k2: int):
        self.t, self.signatures, self.n2, self.k2 = threshold_percent, signatures, n2, k2
        self.subsets = [np.array(c) for c in combinations(range(n2), n2 - k2)]
        self.tops = [0]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * 100 // self.t))
        return int(np.searchsorted(self.tops, size))

    def sign(self, s: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
        """Signatures of a set; sets that can only link with equal ones need none.  frequent: which cells' shingles to leave out."""
        if frequent is None:
            return self._sign(s, len(s))
        often = frequent[cells_of(s)]
        share = np.count_nonzero(often) / max(1, len(s))
        rare = self._sign(s[~often], len(s)) if share else self._sign(s, len(s))
        return np.concatenate([rare, ~self._sign(s, len(s))]) if share >= MANY_FREQUENT else rare

    def _sign(self, s: np.ndarray, size: int) -> np.ndarray:
        out = []
        own = self.band(size)
        self.band(self.tops[own] + 1)
        for band in (own, own + 1):
            top = self.tops[band]
            k = 2 * top * (100 - self.t) // (100 + self.t)
            if not k:
                continue
            n1 = -(-(k + 1) // (self.k2 + 1))
            want = n1 if self.signatures is None else -(-self.signatures // len(self.subsets))
            for seed in range(max(1, -(-want // n1))):
                place = mix(s ^ U64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
                part = place % U64(n1 * self.n2)
                used = min(n1, want) * self.n2
                if used < n1 * self.n2:
                    inside = part < U64(used)
                    part, place = part[inside], place[inside]
                part, weight = part.astype(np.int64), mix(place + U64(band))
                sums, counts = np.zeros(used, dtype=U64), np.bincount(part, minlength=used)
                np.add.at(sums, part, weight)
                sums, counts = sums.reshape(-1, self.n2), counts.reshape(-1, self.n2)
                for i, c in enumerate(self.subsets):
                    total = sums[:, c].sum(axis=1, dtype=U64) if len(c) > 1 else sums[:, c[0]]
                    if self.signatures is None:  # empty projections too, each its own by band, group and subset
                        where = np.arange(len(total), dtype=U64) * U64(len(self.subsets)) + U64(i + 1)
                        out.append(total + mix(where + (U64(band + 1) << U64(40))))
                        continue
                    some = counts[:, c].any(axis=1) if len(c) > 1 else counts[:, c[0]] > 0
                    out.append(total[some])
        return np.unique(mix(np.concatenate(out))) if out else np.zeros(0, dtype=U64)


@lru_cache(maxsize=4)
def shingler(words: int) -> Shingler:
    return Shingler(words)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def cells_of(s: np.ndarray) -> np.ndarray:
    return s & U64(CELLS - 1)


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Of every cell, how many of all documents hold a shingle of it; 8 MB, whatever the data."""

    def pages(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for page, part in enumerate(counts.reshape(-1, CELL_PAGE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["page", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, counts = shingler(words), np.zeros(CELLS, dtype="<u4")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[cells_of(sh.shingles(text))] += 1
        yield from pages(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CELLS // CELL_PAGE, CELL_PAGE), dtype="<u4")
        for batch in batches:
            for page, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[page] += np.frombuffer(part.as_buffer(), dtype="<u4")
        yield from pages(sums)

    with small_batches(docs.sparkSession):
        found = docs.select("text").mapInArrow(count, "page int, counts binary").repartition("page").mapInArrow(add, "page int, counts binary").collect()
    out = np.zeros((CELLS // CELL_PAGE, CELL_PAGE), dtype=np.int64)
    for r in found:
        out[r["page"]] = np.frombuffer(r["counts"], dtype="<u4")
    return out.reshape(-1)


def frequent_cells(docs: DataFrame, words: int, frequent: int, per: int) -> np.ndarray:
    """Which cells have at least `frequent` documents, and as many of every `per`; no fewer than four times the mean."""
    counts = shingle_counts(docs, words)
    return counts >= max(1.0, frequent * max(1.0, docs.count() / per), 4 * counts.mean())


def signed_sets(docs: DataFrame, words: int, percent: int, signatures: int | None, n2: int, k2: int, often: np.ndarray | None) -> DataFrame:
    """Per document: doc_id, th (hash of the text), n, node (hash of the set), sigs.

    A set that the task has signed already gets no second list of signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(often)  # a byte a cell

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idle_memory()
        sh, pe, done = shingler(words), PartEnum(percent, signatures, n2, k2), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                sizes, nodes, lists = [], [], []
                for text in part.column(2).to_pylist():
                    s = sh.shingles(text)
                    node = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
                    sizes.append(len(s))
                    nodes.append(node)
                    lists.append(pe.sign(s, shared.value) if len(s) > 1 and node not in done else np.zeros(0, dtype=U64))
                    if len(done) < REMEMBERED:
                        done.add(node)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_as_long(np.concatenate(lists))))
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(_as_long(np.array(nodes, dtype=U64))), sigs]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "node", "sigs"])
        del done
        idle_memory()

    return docs.mapInArrow(make, "doc_id long, th long, n long, node long, sigs array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """Distinct (node, s) of some documents, s the set's hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, done = shingler(words), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                nodes, lists = [], []
                for text in batch.slice(i, 1024).column(0).to_pylist():
                    s = sh.shingles(text)
                    node = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
                    if node not in done:
                        if len(done) < REMEMBERED:
                            done.add(node)
                        nodes.append(node)
                        lists.append(s)
                if nodes:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_as_long(np.concatenate(lists))))
                    yield pa.RecordBatch.from_arrays([pa.array(_as_long(np.array(nodes, dtype=U64))), arrays], names=["node", "s"])
        del done
        idle_memory()

    return docs.mapInArrow(make, "node long, s array<long>")


def node_sets(nodes: DataFrame, docs: DataFrame, signed: DataFrame, words: int) -> DataFrame:
    """(node, s) of some nodes, from one text of each; the texts are found by a bitmap of their hashes, bounded in size."""
    texts = written(signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")), "jaccard-texts")
    some = maybe_in(docs, "th", key_bitmap(texts, "th")).select("text")
    with small_batches(docs.sparkSession):
        return written(sets_of(some, words).join(texts.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")


def able(sets: DataFrame, percent: int) -> DataFrame:
    """(node, r) of the nodes that may link with any other: r of their shingles may lie in another of the sets, which bounds every
    intersection.  Shingles of one set alone are told by a bitmap of those of more, so r is never too small."""
    rows = sets.select("node", F.explode("s").alias("h"))
    more = rows.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("h")
    more = written(more, "jaccard-shingles")
    counted = maybe_in(rows, "h", key_bitmap(more, "h", SIG_BITS), SIG_BITS).groupBy("node").agg(F.count(F.lit(1)).alias("r"))
    n = F.size("s")
    return counted.join(sets.select("node", n.alias("__n")), "node").filter(100 * F.col("r") >= percent * F.col("__n")).select("node", "r")


def may_link(x: str, y: str, percent: int):
    """Is the similarity high enough if the sets share as many shingles as they possibly can?"""
    most = F.least(f"{x}r", f"{y}r")
    return 100 * most >= percent * (F.col(f"{x}n") + F.col(f"{y}n") - most)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of nodes, those whose whole sets are similar enough."""
    pairs = written(pairs, "jaccard-pairs")
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    links = written(both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "jaccard-links")
    dropped(pairs)
    released(links.sparkSession)
    return links


def common_counts(a: list[np.ndarray], b: list[np.ndarray], step: int = 1 << 19) -> np.ndarray:
    """(sets of a, sets of b): how many hashes they share, by b's inverted list, `step` meetings at a time."""
    out = np.zeros(len(a) * len(b), dtype=np.int64)
    ha, oa = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    hb, ob = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    order = np.argsort(hb, kind="stable")
    hb, ob = hb[order], ob[order]
    lo = np.searchsorted(hb, ha, "left")
    times = np.searchsorted(hb, ha, "right") - lo
    some = times > 0
    lo, times, oa = lo[some], times[some], oa[some]
    ends = np.cumsum(times)
    at = 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        reps = times[at:to]
        within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out += np.bincount(np.repeat(oa[at:to], reps) * len(b) + ob[np.repeat(lo[at:to], reps) + within], minlength=len(out))
        at = to
    return out.reshape(len(a), len(b))


def forest(nodes_a, comps_a, a: list[np.ndarray], nodes_b, comps_b, b: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets of a and b that join different components, no more than it takes to join them."""
    if not a or not b:
        return []
    counts = common_counts(a, b)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    linked = (100 * counts >= percent * (sizes - counts)) & (np.asarray(comps_a)[:, None] != np.asarray(comps_b)[None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(int(comps_a[i])), find(int(comps_b[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(nodes_a[i]), int(nodes_b[j])))
    return out


def hot_blocks(rest: DataFrame, group: int, block: int, elements: int) -> DataFrame:
    """(node, c, block) of the nodes of a signature with more than `group` in rest (sig, node, n, r, c, g): a node goes with others of
    its largest signature."""
    home = F.max(F.struct("g", "sig"))["sig"]
    nodes = rest.filter(F.col("g") > group).groupBy("node", "n", "c").agg(home.alias("home"))
    share = nodes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / elements)).alias("parts"))
    salt = F.pmod(F.xxhash64("node", F.lit(9)), F.greatest("parts", F.lit(1)))
    return nodes.join(share, "home").select("node", "c", F.xxhash64("home", salt).alias("block"))


def block_links(marked: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of blocks (placed: node, c, block) that share a signature of marked (sig, node, block), block
    against block."""
    lists = marked.filter("block is not null").groupBy("sig").agg(F.collect_set("block").alias("blocks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists_seen, seen = set(), set()
        for batch in batches:
            new = []
            for blocks in batch.column(0).to_pylist():
                own = tuple(sorted(blocks))
                if own in lists_seen:
                    continue
                lists_seen.add(own) if len(lists_seen) < REMEMBERED else None
                for k, x in enumerate(own):
                    for y in own[k:]:
                        if (x, y) not in seen:
                            seen.add((x, y)) if len(seen) < REMEMBERED else None
                            new.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in new], pa.int64()) for i in (0, 1)], names=["x", "y"])

    pairs = written(lists.select("blocks").mapInArrow(meet, "x long, y long").distinct(), "jaccard-block-pairs")
    members = placed.join(sets.select("node", "s"), "node")
    left = pairs.join(members, pairs["x"] == members["block"]).select("x", "y", F.lit(0).alias("side"), "node", "c", "s")
    right = pairs.filter("x <> y").join(members, F.col("y") == members["block"]).select("x", "y", F.lit(1).alias("side"), "node", "c", "s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for side in (0, 1):
            own = pdf[pdf["side"] == side]
            parts.append((own["node"].tolist(), own["c"].tolist(), [np.asarray(x, dtype=np.int64) for x in own["s"]]))
        one, two = parts if (pdf["side"] == 1).any() else (parts[0], parts[0])
        return pd.DataFrame(forest(*one, *two, percent), columns=["a", "b"], dtype="int64")

    return left.unionByName(right).groupBy("x", "y").applyInPandas(compare, "a long, b long")


def linked_sets(
    df: DataFrame, id_col: str, text_col: str, words: int = 5, percent: int = 75, signatures: int | None = 64, n2: int = 2, k2: int = 1,
    per: int = 8192, frequent: int = 6, group: int = 32, block: int = 512, elements: int = 1 << 18,
) -> tuple[DataFrame, DataFrame]:
    """(signed, labels): a row a document with its set's node, and the component of every node that has a link."""

    def collected() -> None:  # signatures and shingles by the million leave as much garbage as the heap holds, and steps would add theirs up
        released(df.sparkSession)
        heaps_collected(df.sparkSession)

    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    often = frequent_cells(docs, words, frequent, per) if signatures is not None else None
    with small_batches(df.sparkSession):
        signed = written(signed_sets(docs, words, percent, signatures, n2, k2, often), "jaccard-signed")
    rows = signed.select(F.explode("sigs").alias("sig"), "node", F.col("n").cast("int").alias("n"))
    # most signatures are of one set only: their hashes alone are shuffled, and the rows of the others found by a bitmap
    twice = written(rows.select("sig").groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("sig"), "jaccard-twice")
    collected()
    maybe = written(maybe_in(rows, "sig", key_bitmap(twice, "sig", SIG_BITS), SIG_BITS), "jaccard-shared")
    dropped(twice)
    several = maybe.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("sig")
    shared = written(maybe.join(several, "sig", "left_semi"), "jaccard-several")
    dropped(maybe)
    collected()
    sets = node_sets(shared.select("node").distinct(), docs, signed, words)
    released(df.sparkSession)
    can = written(able(sets, percent), "jaccard-able")
    sets, whole = written(sets.join(can.select("node"), "node", "left_semi"), "jaccard-sets"), sets
    shared, before = written(shared.join(can, "node"), "jaccard-led"), shared
    dropped(whole, before)
    collected()
    lead = F.min(F.struct("node", "n", "r"))
    leads = shared.groupBy("sig").agg(lead.alias("l"), F.max("node").alias("z")).filter("l.node <> z")
    leads = leads.select("sig", F.col("l.node").alias("a"), F.col("l.n").alias("an"), F.col("l.r").alias("ar"))
    first = shared.withColumnsRenamed({"n": "bn", "r": "br"}).join(leads, "sig").filter("a <> node").filter(may_link("a", "b", percent))
    first = first.select("a", F.col("node").alias("b")).distinct()
    links = verified(first, sets, percent)
    labels = written(components(links), "jaccard-labels")
    # sets of one signature that are still apart
    known = shared.join(labels, "node", "left").select("sig", "node", "n", "r", F.coalesce("component", "node").alias("c"))
    known = written(known.distinct(), "jaccard-known")
    dropped(shared)
    apart = known.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("g")).filter("lo <> hi").select("sig", "g")
    rest = written(known.join(apart, "sig"), "jaccard-apart")
    dropped(known)
    # nodes of a large signature go to blocks; of all others, a signature has `group` at most
    placed = written(hot_blocks(rest, group, block, elements), "jaccard-blocks")
    marked = written(rest.join(placed.select("node", "block"), "node", "left"), "jaccard-marked")
    dropped(rest)
    x = marked.select("sig", *(F.col(c).alias(f"x{c}") for c in ("node", "n", "r", "c", "block")))
    y = marked.select("sig", *(F.col(c).alias(f"y{c}") for c in ("node", "n", "r", "c", "block")))
    # a row without a block meets group / 2 others on average at most
    either = F.col("xblock").isNull() | F.col("yblock").isNull()
    second = x.join(y, (x["sig"] == y["sig"]) & (F.col("xc") < F.col("yc")) & either & may_link("x", "y", percent))
    second = second.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()
    more = verified(second, sets, percent)
    if not placed.isEmpty():
        more = more.unionByName(written(block_links(marked, placed, sets, percent), "jaccard-block-links"))
    if not more.isEmpty():
        labels = written(components(links.unionByName(more)), "jaccard-labels")
    dropped(marked, placed, sets)
    return signed, labels


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return _results(*linked_sets(df, id_col, text_col, **how))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df's rows, but of each component only the one with the smallest (id, text hash), null ids first; of rows equal in both, the
    one whose other columns come first as JSON.  Rows without shingles all stay.  Texts of rows that surely stay (by a bitmap of
    bounded size) aren't shuffled."""
    signed, labels = linked_sets(df, id_col, text_col, **how)
    rows = signed.filter("n > 0").select("doc_id", "th", "node")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.count(F.lit(1)).alias("__w"))
    nodes = written(nodes.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")), "jaccard-nodes")
    comps = nodes.groupBy("c").agg(F.min("least").alias("rep"), F.count(F.lit(1)).alias("__nodes"))
    reps = attach(nodes.select("node", "__w", "c"), comps, ["c"], "__nodes", nodes.count()).select("node", "__w", "rep")
    judged = attach(rows, reps, ["node"], "__w", rows.count())
    judged = judged.groupBy("doc_id", "th", "rep").agg(F.count(F.lit(1)).alias("__n"))
    stays = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))
    special = judged.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), stays.alias("__stays"), "__n").filter("not __stays or __n > 1")
    special = written(special, "jaccard-special")
    keyed = df.withColumn("__k1", F.col(id_col).cast("long")).withColumn("__k2", F.xxhash64(text_or_empty(text_col)))
    flagged = maybe_flag(keyed.withColumn("__h", F.xxhash64("__k1", "__k2")), "__h", key_bitmap(special.select(F.xxhash64("__id", "__th").alias("__h")), "__h"))
    own = [F.col(f"`{c}`") for c in df.columns]
    sure = flagged.filter("not __maybe").select(*own)
    asked = flagged.filter("__maybe").join(special, F.col("__k1").eqNullSafe(F.col("__id")) & (F.col("__k2") == F.col("__th")), "left")
    single = asked.filter("__n is null").select(*own)
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)))
    repeated = asked.filter("__stays and __n > 1").groupBy("__k1", "__k2").agg(F.min_by(F.struct(*own), F.coalesce(others, F.lit(""))).alias("__row"))
    repeated = repeated.select("__row.*")
    return sure.unionByName(single).unionByName(repeated)


def _results(signed: DataFrame, labels: DataFrame) -> DataFrame:
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "node")
    total = rows.count()
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("__id"), F.count(F.lit(1)).alias("__w"))
    nodes = nodes.join(labels, "node", "left").select("node", "__id", "__w", F.coalesce("component", "node").alias("c"))
    nodes = written(nodes, "jaccard-nodes")
    comps = nodes.groupBy("c").agg(F.min("__id").alias("component_id"), F.count(F.lit(1)).alias("__nodes"))
    by_node = attach(nodes, comps, ["c"], "__nodes", nodes.count()).select("node", "__w", "component_id")
    out = attach(rows, by_node, ["node"], "__w", total)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
