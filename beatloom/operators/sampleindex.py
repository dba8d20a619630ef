"""Index of sampled signals: blocks of samples, found by time.

A block holds ``BLOCK`` consecutive samples of a recording as arrays, plus a few to
each side. Its head is the time of its first own sample. Points meet the heads (one
row per block), the head says which block has the sample before a point, and a
binary search inside the block's times finds it. So samples are shuffled once, by
block, and points never meet samples as rows.

Blocks count samples, not time: pauses and changes of rate make no block larger.
Samples are numbered without gaps in the order of their times (``idx``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions.arrays import let
from beatloom.params import SERIES, Series
from beatloom.plans.ordered import running
from beatloom.session import materialise

BLOCK = 512


@dataclass(frozen=True)
class SampleIndex:
    """``blocks``: key, ``_block``, number of the first sample held (``_first``),
    times (``_t``) and an array per value; ``heads``: key, ``_block``, ``_from``."""

    blocks: DataFrame
    heads: DataFrame
    values: tuple[str, ...]
    reach: int
    s: Series


def sample_index(
    samples: DataFrame, values: Sequence[str], reach: int = 1, s: Series = SERIES, idx: str = "sample_idx", store: bool = False
) -> SampleIndex:
    """Blocks with ``reach`` samples (at least one) to each side.

    ``store`` writes both tables once, for several uses; otherwise they are part of
    the plan of the one use. Samples without number or time are left out; an empty
    table gives an empty index.
    """
    reach = max(1, reach)
    i = F.col("_i")
    d = samples.select(*s.key, F.col(idx).alias("_i"), F.col(s.ts).alias("_at"), *[F.col(v).alias(f"_v_{v}") for v in values])
    d = d.filter(i.isNotNull() & F.col("_at").isNotNull())
    near = F.sequence(F.floor((i - reach) / BLOCK), F.floor((i + reach) / BLOCK))
    held = d.withColumn("_block", F.explode(near)).groupBy(*s.key, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_i", "_at", *[f"_v_{v}" for v in values]))).alias("_a")
    )
    # heads come out of the blocks, so one shuffle of the samples serves both
    own = F.filter("_a", lambda x: F.floor(x["_i"] / BLOCK) == F.col("_block"))
    heads = held.select(*s.key, "_block", F.get(own, 0)["_at"].alias("_from")).filter(F.col("_from").isNotNull())
    blocks = held.select(
        *s.key, "_block", F.col("_a._i")[0].alias("_first"), F.col("_a._at").alias("_t"), *[F.col(f"_a._v_{v}").alias(f"_v_{v}") for v in values]
    )
    if store:
        blocks, heads = materialise(blocks), materialise(heads)
    return SampleIndex(blocks, heads, tuple(values), reach, s)


def count_upto(times: Column, t: Column, longest: int) -> Column:
    """How many of the ascending ``times`` are at most ``t``: a binary search in
    steps of powers of two."""
    steps = F.array(*[F.lit(1 << k) for k in range(longest.bit_length() - 1, -1, -1)])
    fits = lambda n: (n <= F.size(times)) & (F.get(times, n - 1) <= t)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def locate(points: DataFrame, index: SampleIndex, s: Series = SERIES, tie: str = "later") -> DataFrame:
    """``points`` with their block's columns and ``_at``, the place of the nearest
    sample in the block's arrays; ``tie`` says which of two equally near samples.

    Points without time, or of a recording without samples, get nulls.
    """
    key = list(s.key)
    p = points.select(*key, F.col(s.ts), F.struct(*points.columns).alias("_p"), F.lit(1).alias("_kind"))
    h = index.heads.select(*key, F.col("_from").alias(s.ts), F.col("_block").alias("_b"), F.lit(0).alias("_kind"))
    found = running(
        p.unionByName(h, allowMissingColumns=True),
        {"_last": ("last", F.col("_b")), "_next": ("next", F.col("_b"))},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts, "_kind"),
    ).filter(F.col("_kind") == 1)
    found = found.select("_p.*", F.coalesce("_last", "_next").alias("_block"))
    t = F.col(s.ts)
    n = count_upto(F.col("_t"), t, BLOCK + 2 * index.reach)

    def nearer(n: Column) -> Column:
        before, after = t - F.get("_t", n - 1), F.get("_t", n) - t
        take = after <= before if tie == "later" else after < before
        return F.when((n > 0) & ~F.coalesce(take, F.lit(False)), n - 1).otherwise(n)

    return found.join(index.blocks, [*key, "_block"], "left").withColumn("_at", let(n, nearer))


def nearest_sample(points: DataFrame, index: SampleIndex, s: Series = SERIES, tie: str = "later", name: str = "nearest") -> DataFrame:
    """``name``: struct(t, i, values) of the nearest sample, at any distance."""
    d = locate(points, index, s, tie)
    at = F.col("_at")
    found = F.struct(
        F.get("_t", at).alias("t"), (F.col("_first") + at).alias("i"), *[F.get(f"_v_{v}", at).alias(v) for v in index.values]
    )
    return d.select(*points.columns, F.when(F.col("_first").isNotNull(), found).alias(name))
