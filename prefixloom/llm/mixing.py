"""Operator 9, mixing sources to target weights by temperature.

Shares p of the sources' tokens (words) become weights proportional to p**t.  The exponent t is bisected to meet a target:
the entropy of the weights (in bits), or a limit on how often the most repeated source is used, given the budget.
Without a budget, the budget is the largest for which no source is used less than once, so a mixture drops
nothing: the source with the least repetition is used exactly once.

A source with r = weight * budget / tokens repetitions is used in floor(r) whole passes and one partial pass.  A source is dealt by
hash of id to blocks of about `block_tokens` tokens; every pass has its own seeded permutation of the blocks, and
within a block of its documents.  The partial pass takes whole blocks in its order while they fit the rest of the budget, and of
the next block documents while their running sum fits, so a source's tokens miss their target by less than a document.

Texts are read once, for their tokens.  Only one row a source and one number a step reach the driver; more than `most_sources`
sources are an error, and so is a target that no exponent meets.  Running sums are taken over blocks of a source and
over the documents of one block, never over a source.

Null sources are a source of their own.  Null and empty texts have no tokens; they come along in every pass of their
block.  Repeated rows are separate documents.  A source without tokens is used once.  An empty table gives an
empty result.  Columns of the given table come through unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written


def tokens_of(text_col: str = "text") -> Column:
    """Words between ASCII white space."""
    spaced = F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")
    inner = F.trim(spaced)
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.length(inner) - F.length(F.translate(inner, " ", "")) + 1).cast("long")


def weights(tokens: list[int], t: float) -> list[float]:
    total = sum(tokens)
    raw = [(x / total) ** t if x else 0.0 for x in tokens]
    return [x / sum(raw) for x in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log2(x) for x in w if x > 0)


def repetitions(tokens: list[int], t: float, budget: float | None) -> list[float]:
    """Uses of each source; without a budget, scaled so that the least used source is used once."""
    w = weights(tokens, t)
    per = [x / n if n else 0.0 for x, n in zip(w, tokens, strict=True)]
    scale = budget if budget is not None else 1 / min(x for x in per if x)
    return [x * scale for x in per]


def bisect(tokens: list[int], target_entropy: float | None, max_repeats: float | None, budget: float | None, steps: int = 60) -> float:
    """The smallest exponent, from 0 (equal weights) by way of 1 (as they are), that keeps the entropy at the target or below and the
    repetitions at the limit or below.  The entropy falls as the exponent rises, beyond 1 too; repetitions are least at 1.  If
    no exponent will do, no mixture meets the target, which is an error."""

    def met(t: float) -> bool:
        if target_entropy is not None and entropy(weights(tokens, t)) > target_entropy:
            return False
        return max_repeats is None or max(repetitions(tokens, t, budget)) <= max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if met(low):
        return low
    while not met(high):
        low, high = high, 2 * high
        if target_entropy is None or high > 1024:
            raise ValueError(f"no mixture meets the target: entropy {target_entropy}, repeats {max_repeats}, budget {budget}")
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if met(mid) else (mid, high)
    return high


def source_key(source_col: str = "source") -> Column:
    """Sources as (is null, name), so that null is a source of its own and joins as any other."""
    return F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))


def mixture(
    df: DataFrame, text_col: str, source_col: str, target_entropy: float | None, max_repeats: float | None, budget: float | None, block_tokens: int,
    most_sources: int = 1 << 16,
) -> DataFrame:
    """A row a source: s, tokens, weight, repetitions, exponent, blocks, whole (passes), rest (tokens of the partial pass)."""
    counted = df.select(source_key(source_col).alias("s"), tokens_of(text_col).alias("n"))
    return _mixture(counted, target_entropy, max_repeats, budget, block_tokens, most_sources)


def _mixture(counted: DataFrame, target_entropy, max_repeats, budget, block_tokens: int, most_sources: int) -> DataFrame:
    """mixture() of rows (s, n)."""
    found = counted.groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    tokens = [r["n"] for r in found]
    t, w, reps = 1.0, [0.0] * len(tokens), [1.0] * len(tokens)
    if any(tokens):
        t = bisect(tokens, target_entropy, max_repeats, budget)
        w, reps = weights(tokens, t), repetitions(tokens, t, budget)
    rows = []
    for r, weight, rep in zip(found, w, reps, strict=True):
        rep = 1.0 if not r["n"] else float(round(rep)) if abs(rep - round(rep)) < 1e-9 else rep
        whole = math.floor(rep)
        rows.append(((r["s"]["none"], r["s"]["name"]), r["n"], weight, rep, t, max(1, -(-r["n"] // block_tokens)), whole, int((rep - whole) * r["n"])))
    schema = "s struct<none:boolean,name:string>, tokens long, weight double, repetitions double, exponent double, blocks long, whole int, rest long"
    return counted.sparkSession.createDataFrame(rows, schema)


def _uses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None,
    max_repeats: float | None = 1.5, budget: float | None = None, block_tokens: int = 2_000_000, seed: int = 17, most_sources: int = 1 << 16,
) -> DataFrame:
    """A row for every use: the document's row as __row, and USE_COLUMNS."""
    counted = df.select(
        source_key(source_col).alias("s"), F.col(id_col).cast("string").alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__th"),
        tokens_of(text_col).alias("n"),
    )
    counted = written(counted, "mix-counted")  # the one pass that counts tokens
    plan = _mixture(counted, target_entropy, max_repeats, budget, block_tokens, most_sources)  # a row a source, most_sources at most
    small = F.broadcast(plan.select("s", "blocks", "whole", "rest"))
    seeded = lambda *c: F.xxhash64(*c, F.lit(seed))
    th = F.xxhash64(text_or_empty(text_col))
    block = F.pmod(seeded(F.col("__id"), F.col("__th")), F.col("blocks")).alias("mix_block")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    rows = df.select(row, source_key(source_col).alias("s"), th.alias("__th"), F.col(id_col).cast("string").alias("__id"))
    dealt = rows.join(small, "s").select("__row", "s", "__th", "__id", block)
    narrow = counted.join(small, "s").select("s", "__th", "__id", "n", "rest", "whole", block)
    narrow = written(narrow.groupBy("s", "mix_block", "__id", "__th", "rest", "whole").agg(F.sum("n").alias("n")), "mix-documents")
    # every pass permutes the source's blocks; the partial pass ends where its tokens are used up
    blocks = narrow.groupBy("s", "mix_block", "rest", "whole").agg(F.sum("n").alias("bt"))
    last = F.col("whole") - F.when(F.col("rest") > 0, F.lit(0)).otherwise(F.lit(1))
    passes = blocks.filter(last >= 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy("s", "mix_pass").orderBy(seeded("s.name", "mix_pass", "mix_block"), "mix_block")
    passes = passes.withColumn("mix_rank", F.row_number().over(order))
    before = F.coalesce(F.sum("bt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partial = F.col("mix_pass") == F.col("whole")
    passes = passes.withColumn("left", F.when(partial, F.col("rest") - before)).filter("left is null or left > 0")
    schedule = passes.select("s", "mix_block", "mix_pass", "mix_rank", F.when(F.col("bt") > F.col("left"), F.col("left")).alias("left"))
    schedule = written(schedule, "mix-schedule")
    # at most one block a source is cut: documents of it, in the pass's order, while their running sum fits
    position = seeded("__id", "__th", "mix_pass")
    inside = Window.partitionBy("s", "mix_block").orderBy(position, "__id", "__th").rowsBetween(Window.unboundedPreceding, 0)
    cut = narrow.join(schedule.filter("left is not null"), ["s", "mix_block"]).withColumn("run", F.sum("n").over(inside))
    # running sums only grow, so what fits is all up to one document: a row a source, however many documents, and no text is shuffled
    place = F.struct(position.alias("p"), F.col("__id").alias("i"), F.col("__th").alias("t"))
    ends = cut.filter("run <= left").groupBy("s", "mix_block", "mix_pass").agg(F.max(place).alias("__end"))
    ends = written(ends, "mix-ends")
    # blocks times passes, and blocks hold block_tokens each; Spark broadcasts them as long as they are small
    uses = dealt.join(schedule, ["s", "mix_block"]).withColumn("mix_position", position)
    whole = uses.filter("left is null")
    part = uses.filter("left is not null").join(F.broadcast(ends), ["s", "mix_block", "mix_pass"]).filter(place <= F.col("__end")).drop("__end")
    return whole.unionByName(part).select("__row", *USE_COLUMNS)


USE_COLUMNS = ("mix_pass", "mix_block", "mix_rank", "mix_position")


def mix(df: DataFrame, **how) -> DataFrame:
    """df's columns and, a row for every use, mix_pass, mix_block, mix_rank (the block's place in the pass) and
    mix_position (the document's in the block, a hash to order by); columns of df with such names give way.
    Rows equal in id, text and source are used alike."""
    kept = [F.col(f"__row.`{c}`").alias(c) for c in df.columns if c.lower() not in USE_COLUMNS]
    return _uses(df, **how).select(*kept, *USE_COLUMNS)


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """df's own columns, a row for every use."""
    return _uses(df, **how).select("__row.*")
