"""Anchored windows kept up to date as intervals arrive.

The windows are those of the batch metrics: they start at the anchor, the first
interval seen of a recording, and all timeframes of a day nest in its 24 h window.
Four tables stand under one path: intervals and metrics by recording and day,
anchors and the coverage ledger by batch. A micro-batch

* drops rows inside time that is covered already (late rows; ``reset`` forgets
  coverage from a time on, so that rows can be sent again),
* merges its other rows into the days they belong to,
* recomputes the windows of those days from the stored intervals, nothing else,
* and records the time it realised as covered, last.

A batch that is repeated finds its rows stored, or covered, and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.operators import hrv, intervals, rollup
from beatloom.operators.rollup import Frames, States
from beatloom.params import Series
from beatloom.plans.ordered import spread
from beatloom.session import materialise
from beatloom.sources.tables import merge_into

DAY = "day"


class AnchoredWindows:
    """Use ``write`` as the function of ``foreachBatch``; batches have the key
    columns, a time in ms and ``rr_ms``.

    ``measure`` turns the states of some days into one row per window. Timeframes
    must divide ``day_ms``. Rows without key, time or interval are left out; of rows
    of one recording and time one stays.
    """

    def __init__(self, spark: SparkSession, path: str, measure: Callable[[States], DataFrame] = hrv.moments, frames: Frames = hrv.ALL_FRAMES,
                 key_type: str = "long", day_ms: int = 86_400_000, s: Series = hrv.RR):
        if any(day_ms % ms for ms, _ in frames.values()):
            raise ValueError("timeframes must divide the day")
        self.spark, self.path, self.measure, self.frames, self.day_ms, self.s = spark, path, measure, dict(frames), day_ms, s
        key = ", ".join(f"{k} {key_type}" for k in s.key)
        self.schemas = {
            "intervals": StructType.fromDDL(f"{s.ts} long, rr_ms double, {key}, {DAY} long"),
            "anchors": StructType.fromDDL(f"{key}, anchor_ms long, batch long"),
            "coverage": StructType.fromDDL(f"{key}, start_ms long, end_ms long, batch long"),
        }
        for name in ("intervals", "anchors", "coverage"):
            self._empty(name)

    def _empty(self, name: str) -> None:
        none = self.spark.createDataFrame([], self.schemas[name]).write.mode("ignore")
        # without rows a partitioned table has no file that could hide its partitions
        by = [*self.s.key, DAY] if name in ("intervals", "metrics") else []
        none.partitionBy(*by).parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def anchors(self, before: int | None = None) -> DataFrame:
        """The anchor of each recording, as the first batch that knew it saw it."""
        d = self.table("anchors")
        d = d if before is None else d.filter(F.col("batch") < before)
        return d.groupBy(*self.s.key).agg(F.min_by("anchor_ms", "batch").alias("anchor_ms"))

    def covered(self, before: int | None = None) -> DataFrame:
        """Merged coverage. A negative length forgets: see ``reset``."""
        d = self.table("coverage")
        d = d if before is None else d.filter(F.col("batch") < before)
        cut = d.filter("end_ms IS NULL").groupBy(*self.s.key).agg(F.max_by("start_ms", "batch").alias("_cut"), F.max("batch").alias("_at"))
        # coverage of batches up to the reset ends before it
        d = d.filter("end_ms IS NOT NULL").join(cut, list(self.s.key), "left")
        end = F.when(F.col("batch") <= F.col("_at"), F.least("end_ms", F.col("_cut") - 1)).otherwise(F.col("end_ms"))
        d = d.withColumn("end_ms", end).filter("start_ms <= end_ms")
        return intervals.merge(d.select(*self.s.key, "start_ms", "end_ms"), 1, self.s)

    def reset(self, cutoffs: DataFrame, batch_id: int) -> None:
        """Forget coverage from each key's ``cutoff_ms`` on, as of the batches up to
        ``batch_id``; rows from there on are taken again and win over stored ones."""
        d = cutoffs.select(*self.s.key, F.col("cutoff_ms").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(batch_id).cast("long").alias("batch"))
        d.write.mode("append").parquet(f"{self.path}/coverage")

    def _unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows outside covered time. Coverage is cut at borders of days, one array for
        each key and day: a table small beside the rows, which meet it unshuffled."""
        key, ts = list(self.s.key), F.col(self.s.ts)
        slot = lambda c: F.floor(F.col(c) / self.day_ms).cast("long")
        cov = self.covered(batch_id).withColumn("_slot", F.explode(F.sequence(slot("start_ms"), slot("end_ms"))))
        cov = cov.groupBy(*key, "_slot").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("_cov"))
        d = rows.withColumn("_slot", slot(self.s.ts)).join(rollup.per_key(cov), [*key, "_slot"], "left")
        old = F.exists("_cov", lambda c: ts.between(c["start_ms"], c["end_ms"]))
        return d.filter(~F.coalesce(old, F.lit(False))).select(*rows.columns)

    def _merged(self, new: DataFrame) -> DataFrame:
        """Stored and new intervals of the days that ``new`` touches, the new ones
        winning, numbered in order. Written aside, since the table is read.

        A day is dealt to one task once: for equal times, the numbers and its one file.
        Numbers are dense inside a day, where windows and their neighbours stay; those
        of another day begin at another multiple of ``day_ms``.
        """
        s, by = self.s, [*self.s.key, DAY]
        days = rollup.per_key(new.select(*by).distinct())
        stored = self.table("intervals").join(days, by, "left_semi")
        both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        one = spread(both, *by).groupBy(*by, s.ts).agg(F.max_by("rr_ms", "_new").alias("rr_ms"))
        at = F.row_number().over(Window.partitionBy(*by).orderBy(s.ts)) - 1
        return materialise(one.withColumn(s.idx, F.col(DAY) * self.day_ms + at))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        s, key = self.s, list(self.s.key)
        rows = batch.select(*key, s.ts, F.col("rr_ms").cast("double").alias("rr_ms")).dropna()
        new = materialise(self._unseen(rows, batch_id))
        if new.isEmpty():
            return
        first = rollup.anchors(new, s).join(self.anchors(batch_id), key, "left_anti")
        self._put("anchors", first, batch_id)
        anchor = rollup.per_key(self.anchors())
        day = F.floor((F.col(s.ts) - F.col("anchor_ms")) / self.day_ms).cast("long")
        names = [f.name for f in self.schemas["intervals"]]
        rr = self._merged(new.join(anchor, key).withColumn(DAY, day).select(*names))
        rr.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key, DAY).parquet(f"{self.path}/intervals")
        out = self.measure(States(rr.drop(DAY), anchor, self.frames, s))
        out = out.join(anchor, key)
        start = F.floor((F.col("window_start_ms") - F.col("anchor_ms")) / self.day_ms).cast("long")
        out = out.withColumn(DAY, start).drop("anchor_ms")
        out = materialise(out.select(*[c for c in out.columns if c not in (*key, DAY)], *key, DAY))
        if "metrics" not in self.schemas:
            self.schemas["metrics"] = out.schema
            self._empty("metrics")
        merge_into(f"{self.path}/metrics", out, [*key, "timeframe", "window_start_ms"], [*key, DAY], out.schema)
        self._put("coverage", new.groupBy(*key).agg(F.min(s.ts).alias("start_ms"), F.max(s.ts).alias("end_ms")), batch_id)

    def _put(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Rows of one batch; those of an earlier try are equal, so readers that see
        both are not misled."""
        materialise(rows.withColumn("batch", F.lit(batch_id).cast("long"))).write.mode("append").parquet(f"{self.path}/{name}")

    def metrics(self) -> DataFrame:
        """All windows so far (none before the first row)."""
        if "metrics" not in self.schemas:
            return self.spark.read.parquet(f"{self.path}/metrics").drop(DAY)
        return self.table("metrics").drop(DAY)
