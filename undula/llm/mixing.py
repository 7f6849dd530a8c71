"""Mixing sources to target weights by temperature.

Weights are the sources' token shares raised to an exponent between 1 (as they are)
and 0 (all alike). The exponent is bisected, many places a pass, so that the weights
meet a target entropy, or are as even as a limit on repetition allows. They are
realised by permutations of blocks: each pass over a source visits its blocks in an
order of its own; whole passes take every document, and the last one stops where the
source's token budget ends, inside one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm import scratch

#: Blocks a source at least, and the mean rows of a block beyond which there are more: a window over
#: blocks, and one over a block's rows, fit a task.
BLOCKS = 4096
BLOCK_ROWS = 1 << 20
#: The plan has a row a source; up to so many it is broadcast, beyond it is joined.
FEW_SOURCES = 10_000
_PLACES = 32


@dataclass(frozen=True)
class Temperature:
    """exponent, tokens of the mix, and what they lead to."""

    exponent: float
    budget: float
    total: float
    scale: float  # sum of share ** exponent
    entropy: float
    most_passes: float


def tokens_of(text: Column) -> Column:
    """Words of a text: runs of anything but blanks and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def temperature(totals: DataFrame, max_passes: float | None = None, entropy: float | None = None, budget: float | None = None) -> Temperature:
    """Bisect the exponent over (source, tokens) rows; sources without tokens don't count.

    ``entropy`` (nats): the exponent that meets it, or the nearest between 0 and 1.
    ``max_passes``: the smallest exponent at which no source is passed over more often.
    ``budget``: tokens of the mix; without it, so many that each source is passed over
    once at least. Each pass evaluates 32 exponents in one aggregation, so the
    sources are never collected.
    """
    if (max_passes is None) == (entropy is None):
        raise ValueError("give either max_passes or entropy")
    if max_passes is not None and budget is None and max_passes < 1:
        raise ValueError("max_passes is at least 1 where every source is passed over once")
    positive = totals.where("tokens > 0")
    base = positive.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not base["all"]:
        return Temperature(1.0, 0.0, 0.0, 1.0, 0.0, 1.0)
    total, high, low = float(base["all"]), base["most"] / base["all"], base["least"] / base["all"]

    def at(exponents: list[float]) -> list[Temperature]:
        share = F.col("tokens") / F.lit(total)
        sums = [x for i, e in enumerate(exponents) for x in (F.sum(F.pow(share, F.lit(e))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(e)) * F.log(share)).alias(f"l{i}"))]
        row = positive.agg(*sums).first()
        out = []
        for i, e in enumerate(exponents):
            z = row[f"z{i}"]
            tokens = total * z * high ** (1 - e) if budget is None else float(budget)
            out.append(Temperature(e, tokens, total, z, math.log(z) - e * row[f"l{i}"] / z, tokens / total * low ** (e - 1) / z))
        return out

    def even_enough(t: Temperature) -> bool:  # holds from some exponent on
        return t.entropy <= entropy + 1e-12 if entropy is not None else t.most_passes <= max_passes + 1e-12

    lo, hi = 0.0, 1.0
    first = at([0.0, 1.0])
    if even_enough(first[0]):
        return first[0]
    best = first[1]
    while hi - lo > 1e-9 and even_enough(best):
        places = [lo + (hi - lo) * i / _PLACES for i in range(1, _PLACES)]
        found = [t for t in at(places) if even_enough(t)]
        if found:
            best, hi = found[0], found[0].exponent
            lo = max(lo, hi - (places[1] - places[0]))
        else:
            lo = places[-1]
    return best


def _order(*parts: Column | str) -> Column:
    """60 bits of an MD5: a place in a permutation that depends on nothing but ``parts``."""
    text = F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _block(key: Column, blocks: int) -> Column:
    return (_order(F.lit("block"), key) % blocks).cast("int")


def plan(rows: DataFrame, totals: DataFrame, t: Temperature) -> DataFrame:
    """(key, source, weight, budget, passes, last_block, last_row) for each source.

    ``rows``: source, tokens, block, id; ``totals``: source, tokens. In the last, partial
    pass a document is taken if (order of its block, its own order) comes before
    (last_block, last_row) or equals it; both are null where there is no partial pass.
    """
    share = F.col("tokens") / F.lit(t.total or 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(t.exponent)) / F.lit(t.scale)).otherwise(0.0)
    quota = F.col("weight") * F.lit(t.budget)
    exact = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(1.0)
    near = F.when(F.abs(exact - F.round(exact)) < 1e-6, F.round(exact)).otherwise(F.floor(exact))  # rounding noise isn't a pass
    sources = totals.withColumn("weight", weight).withColumn("budget", quota).withColumn("passes", near.cast("long"))
    sources = sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("tokens")))
    sources = sources.withColumn("rest", F.when(F.col("rest") > 1e-6 * F.col("tokens"), F.col("rest")).otherwise(0.0)).withColumn("key", F.coalesce("source", F.lit("\0null")))
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).withColumn("key", F.coalesce("source", F.lit("\0null")))
    blocks = blocks.drop("source").join(sources.where("rest > 0").select("key", "rest", "passes"), "key").withColumn("order", _order("key", "passes", "block"))
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("key").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the block in which the budget ends: the last one that begins before its end
    ends = blocks.withColumn("before", before).where("before < rest").groupBy("key").agg(F.max(F.struct("order", "block", "before", "rest", "passes")).alias("x")).select("key", "x.*")
    inner = rows.withColumn("key", F.coalesce("source", F.lit("\0null"))).join(ends, ["key", "block"])
    inner = inner.groupBy("key", "order", "before", "rest", "passes", "id").agg(F.sum("tokens").alias("tokens")).withColumn("own", _order("id", "passes"))  # rows of an id share their fate
    held = F.coalesce(F.sum("tokens").over(W.partitionBy("key").orderBy("own", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = inner.withColumn("held", held).where(F.col("before") + F.col("held") < F.col("rest")).groupBy("key").agg(F.max("order").alias("last_block"), F.max("own").alias("last_row"))
    return sources.join(last, "key", "left").select("key", "source", "weight", "budget", "passes", "last_block", "last_row")


def mix(docs: DataFrame, max_passes: float | None = 2.0, entropy: float | None = None, budget: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as often as the weights say, with columns _weight, _tokens, _pass, _position.

    ``_pass`` counts a document's copies from 0. Sorted by ``_position`` (0 to 1), any
    prefix of the mix holds the sources in their target weights. A null source is a
    source; one without any token is passed over once; documents without tokens (null
    and empty texts) go with whole passes, and with a partial one where their order
    falls. Rows that repeat an id share their fate. An empty table gives no rows. The
    four columns come last, in this order; where ``docs`` has a column of that name,
    underscores are put before it.
    """
    added = scratch.fresh(docs, "_weight", "_tokens", "_pass", "_position")
    own_weight, own_tokens, own_pass, own_position = added
    rows = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), tokens_of(F.col(text)).alias("tokens"))
    rows = scratch.table(rows, "mixing")
    totals = scratch.table(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    blocks = BLOCKS << max(0, math.ceil(math.log2(max(1, n) / (BLOCKS * BLOCK_ROWS))))
    t = temperature(totals, max_passes, entropy, budget)
    sources = scratch.table(plan(rows.withColumn("block", _block(F.col("id"), blocks)), totals.select("source", "tokens"), t), "weights")
    names = ("key", "weight", "passes", "last_block", "last_row")
    inner = dict(zip((*names, "block"), scratch.fresh(docs, *(f"__{c}" for c in (*names, "block"))), strict=True))
    at = {c: F.col(x) for c, x in inner.items()}
    small = sources.select(*(F.col(c).alias(inner[c]) for c in names))
    if small.count() <= FEW_SOURCES:
        small = F.broadcast(small)
    out = docs.withColumn(inner["block"], _block(F.col(key), blocks)).join(small, F.coalesce(F.col(source).cast("string"), F.lit("\0null")) == at["key"])
    block_order, own = _order(at["key"], at["passes"], at["block"]), _order(F.col(key), at["passes"])
    partial = (block_order < at["last_block"]) | ((block_order == at["last_block"]) & (own <= at["last_row"]))
    times = at["passes"] + F.when(at["last_block"].isNotNull(), partial.cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn(own_pass, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))))
    # a place in the order of this pass, from the block's and the row's order
    place = _order(at["key"], F.col(own_pass), at["block"]) / F.lit(2.0**60) * F.lit(1 - 2.0**-20) + _order(F.col(key), F.col(own_pass)) / F.lit(2.0**60) * F.lit(2.0**-20)
    passes = F.greatest(at["passes"] + F.when(at["last_block"].isNull(), 0.0).otherwise(at["last_block"] / F.lit(2.0**60)), F.lit(1e-9))
    return out.select(*docs.columns, at["weight"].alias(own_weight), tokens_of(F.col(text)).alias(own_tokens), own_pass, F.least(F.lit(1.0), (F.col(own_pass) + place) / passes).alias(own_position))
