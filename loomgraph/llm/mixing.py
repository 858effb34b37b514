"""Mixing sources to target weights by temperature (operator 3).

Shares of tokens p become weights in proportion to p ** a with a from 0 (all alike) to 1 (as they are).  The
exponent is bisected to the one whose weights have the target entropy (as a part of the most that so many
sources allow) or, where that would repeat some source more often than the limit, the least that keeps it.
Shares that are as flat as the target already stay as they are: the mixture flattens and never sharpens.
The weights then are budgets of tokens for each source.  Documents are dealt into blocks by a
hash; a budget is whole rounds over all blocks and then a random order of blocks, cut in the
block that would exceed it, where documents are taken in random order while they fit.

Every pass of the bisection is one aggregation over the sources' totals, for the 31 exponents that five halvings
may ask for; two numbers for each come to the driver.  A source has as many blocks as 1/32 of the square root of
its tokens: 10**13 tokens are some 10**5 blocks of 10**8 tokens, so both the blocks that one task orders
and the documents of the block that is cut stay few, and a source that has most rows is spread over its blocks.

Defined results: a null source is a source of its own; a null or empty text has no tokens and goes
along with its block; repeated rows are documents each (ties in the order stand together); a single
source keeps its share of 1 at exponent 1; a budget over the repetition limit leaves exponent 1 and is not met; an
empty table gives an empty mixture; further columns of the documents pass through ``mixture``, and those that
bear a name of its output are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._shared import written

#: Rows of a table that is sent to all tasks: some 10 MB.
SENT_ROWS = 100_000
#: Halvings of [0, 1], and how many of them one pass over the sources serves.
HALVINGS, PER_PASS = 50, 5
#: An entropy counts as over the target from here on: sums of another order differ by less.
SLACK = 1e-9


@dataclass(frozen=True)
class Target:
    """``entropy``: of the weights, as a part of log(number of sources), or None for no target.

    ``repeats``: most rounds over any source.  ``budget``: tokens as a multiple of the corpus, or
    None for the least with which no source has less than one whole round.
    """

    entropy: float | None = 0.999
    repeats: float = 4.0
    budget: float | None = 1.0
    seed: str = "mix"


@dataclass(frozen=True)
class Mix:
    """What was chosen: weights are (tokens / total) ** exponent / mass, of ``size`` times the corpus's tokens.

    ``entropy``: of the weights, as a part of the most; ``natural``: that of the shares themselves.
    ``worst``: rounds over the source that is repeated most.  ``met``: entropy and limit are both kept.
    """

    exponent: float
    mass: float
    total: float
    size: float
    entropy: float
    natural: float
    worst: float
    met: bool


def words(text: str = "text") -> Column:
    """Tokens as white-space words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def draw(*parts) -> Column:
    """A random number below 2**32, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def solve(totals: DataFrame, target: Target) -> Mix | None:
    """The exponent for the totals (tokens; a row a source), or None without tokens."""
    have = totals.filter("tokens > 0")
    total, n, most, least = have.agg(F.sum(F.col("tokens").cast("double")), F.count("*"), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return None
    share = F.col("tokens") / F.lit(float(total))
    high, low = most / total, least / total

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """Of p ** a and of p ** a * ln p, for each exponent."""
        powers = [F.pow(share, F.lit(a)) for a in exponents]
        got = have.agg(*[F.sum(x) for x in powers], *[F.sum(x * F.ln(share)) for x in powers]).first()
        return list(zip(got[: len(exponents)], got[len(exponents) :]))

    def facts(a: float, z: float, t: float) -> tuple[float, float, float]:
        """Entropy, size and most rounds: those of the smallest source, as a is at most 1."""
        size = z * high ** (1 - a) if target.budget is None else target.budget
        return math.log(z) - a * t / z, size, low ** (a - 1) / z * size

    most_entropy = math.log(n)
    wanted = math.inf if target.entropy is None else target.entropy * most_entropy + SLACK

    def too_small(a: float, z: float, t: float) -> bool:
        entropy, _, worst = facts(a, z, t)
        return worst > target.repeats or (entropy > wanted if target.entropy is not None else True)

    lo, hi = 0.0, 1.0
    if n > 1:
        for _ in range(HALVINGS // PER_PASS):
            cuts = 1 << PER_PASS
            tried = [lo + (hi - lo) * i / cuts for i in range(1, cuts)]
            found = dict(zip(tried, sums(tried)))
            i, j = 0, cuts
            while j - i > 1:
                at = (i + j) // 2
                i, j = (at, j) if too_small(tried[at - 1], *found[tried[at - 1]]) else (i, at)
            lo, hi = lo + (hi - lo) * i / cuts, lo + (hi - lo) * j / cuts
    (z, t), (z1, t1) = sums([hi, 1.0])
    entropy, size, worst = facts(hi, z, t)
    natural = facts(1.0, z1, t1)[0]
    part = lambda x: x / most_entropy if n > 1 else 1.0
    met = worst <= target.repeats * (1 + SLACK) and (target.entropy is None or entropy >= target.entropy * most_entropy - SLACK)
    return Mix(hi, z, float(total), size, part(entropy), part(natural), worst, met)


def weights(totals: DataFrame, target: Target) -> DataFrame:
    """source, tokens, exponent, weight, budget and met from source, tokens (one row a source)."""
    mix = solve(totals, target) or Mix(1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0, True)
    weight = F.pow(F.col("tokens") / F.lit(mix.total), F.lit(mix.exponent)) / F.lit(mix.mass)
    budget = F.floor(F.round(weight * F.lit(mix.size * mix.total), 3)).cast("long")
    return totals.filter("tokens > 0").select("source", "tokens", F.lit(mix.exponent).alias("exponent"), weight.alias("weight"), budget.alias("budget"), F.lit(mix.met).alias("met"))


def block_count(tokens: str = "tokens") -> Column:
    return F.greatest(F.lit(16), F.ceil(F.sqrt(F.col(tokens).cast("double")) / 32)).cast("int")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """For all tasks if it is small, else joined by shuffle (a written table, so that hot keys can be split)."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def mixture(docs: DataFrame, target: Target = Target(), tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with ``round`` (from 0),
    ``place`` (of the block within the round), ``n_tokens``, ``exponent`` and ``weight``.

    In the order of (round + (place + 0.5) / blocks) / the source's budget in rounds, sources
    alternate at their weights; writers may sort by it.
    """
    added = ["round", "place", "n_tokens", "exponent", "weight"]
    keep = [c for c in docs.columns if c not in added]
    t = F.lit(target.seed)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = {
        "_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "_tokens": words() if tokens is None else tokens,
        "_place": draw(t, F.lit("block"), key),
        "_turn": F.struct(draw(t, F.lit("turn"), key).alias("turn"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")),
    }
    lean = written(docs.select(*[c.alias(n) for n, c in own.items()]), "lean")
    totals = lean.groupBy("_source").agg(F.sum("_tokens").alias("tokens")).withColumn("_blocks", block_count())
    totals = written(totals.withColumnRenamed("_source", "source"), "totals")
    sources = totals.select(F.col("source").alias("_source"), "_blocks")
    of = _sent(sources, totals.count())
    dealt = lambda df: df.join(of, "_source").withColumn("_block", F.pmod("_place", F.col("_blocks")).cast("int"))
    blocks = written(dealt(lean).groupBy(F.col("_source").alias("source"), F.col("_block").alias("block")).agg(F.sum("_tokens").alias("block_tokens")), "blocks")
    order = Window.partitionBy("source").orderBy("at", "block")
    plan = (
        blocks.join(weights(totals, target), "source", "left")
        .withColumn("whole", F.coalesce(F.floor(F.col("budget") / F.col("tokens")), F.lit(1)).cast("int"))
        .withColumn("rest", F.coalesce(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0)))
        .withColumn("at", draw(t, F.lit("order"), F.col("source"), F.col("block")))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("upto", F.sum("block_tokens").over(order))
        .withColumn("part", F.when((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0), F.lit("all")).when(F.col("upto") - F.col("block_tokens") < F.col("rest"), F.lit("some")).otherwise(F.lit("none")))
        .withColumn("room", F.when(F.col("part") == "some", F.col("rest") - F.col("upto") + F.col("block_tokens")))
    )
    plan = written(plan.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "whole", "part", "room", "place", "exponent", "weight"), "plan")
    rows = plan.count()
    # only the block that is cut needs an order of its documents: those up to the last that fits
    cut = dealt(lean).join(_sent(plan.filter("part = 'some'").select("_source", "_block", "room"), rows), ["_source", "_block"])
    within = Window.partitionBy("_source", "_block").orderBy("_turn.turn", "_turn.doc")
    last = cut.withColumn("upto", F.sum("_tokens").over(within)).filter("upto <= room").groupBy("_source", "_block").agg(F.max("_turn").alias("last"))
    plan = written(plan.join(last, ["_source", "_block"], "left").drop("room"), "plan")
    found = docs.select(*keep, *[c.alias(n) for n, c in own.items()])
    found = dealt(found).join(_sent(plan, rows), ["_source", "_block"]).withColumnRenamed("_tokens", "n_tokens")
    times = F.col("whole") + F.when((F.col("part") == "all") | F.coalesce(F.col("_turn") <= F.col("last"), F.lit(False)), 1).otherwise(0)
    return found.withColumn("round", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>")))).select(*keep, *added)
