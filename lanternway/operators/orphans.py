"""References to records that do not exist, deleted by then, or loaded later.

Parents and references are range-partitioned together by key in one exchange. In each range the
parents become sorted arrays; reference batches stream past and are probed by vectorised binary
search. Only misses leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.runtime import hot_keys, salt_of, salts_of

MISSING, LATE, DELETED = 1, 2, 3


class ParentRange:
    """Sorted arrays of one key range: what was known of each parent from which moment on."""

    def __init__(self, key: np.ndarray, ts: np.ndarray, version: np.ndarray, visible: np.ndarray):
        order = np.lexsort((version, ts, key))
        self.key, self.ts = key[order], ts[order]
        # Highest version so far decides; of equal versions one that is visible. Both in one number.
        state = version[order].astype(np.int64) * 2 + visible[order]
        if len(state):
            start = np.r_[True, self.key[1:] != self.key[:-1]]
            group = np.cumsum(start) - 1
            base = state.min()
            span = int(state.max() - base) + 1
            state = np.maximum.accumulate(state - base + group * span) - group * span + base
        self.visible = (state & 1).astype(bool)

    def probe(self, key: np.ndarray, ts: np.ndarray) -> np.ndarray:
        """0 for a parent there and visible at ts, else MISSING, LATE or DELETED."""
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out = np.where(lo == hi, MISSING, 0).astype(np.int8)
        a, b = lo.copy(), hi.copy()  # first position in [lo, hi) whose ts is greater
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = np.minimum((a + b) // 2, max(len(self.ts) - 1, 0))
            up = open_ & (self.ts[mid] <= ts)
            a = np.where(up, mid + 1, a)
            b = np.where(open_ & ~up, mid, b)
        there = lo < hi
        out[there & (a == lo)] = LATE
        known = there & (a > lo)
        dead = np.zeros(len(key), bool)
        dead[known] = ~self.visible[a[known] - 1]
        out[dead] = DELETED
        return out


def _probe_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents: list[tuple] = []
    known: ParentRange | None = None
    for batch in batches:
        kind, key, ts, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        is_parent = kind == 0
        if is_parent.any():
            parents.append((key[is_parent], ts[is_parent], a[is_parent], b[is_parent]))
        ref = ~is_parent
        if not ref.any():
            continue
        if known is None:  # parents are sorted first
            cols = [np.concatenate(c) for c in zip(*parents)] if parents else [np.empty(0, np.int64)] * 4
            known, parents = ParentRange(*cols), []
        key, ts, a, b, kind = key[ref], ts[ref], a[ref], b[ref], kind[ref]
        reason = known.probe(key, ts)
        miss = reason > 0
        if miss.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (kind[miss].astype(np.int32), key[miss], ts[miss], a[miss], reason[miss].astype(np.int32))],
                names=["kind", "key", "ts", "record_id", "reason"],
            )


#: Stands for "never loaded": later than any moment asked for.
NEVER = 2**62


def find_orphans(parents: DataFrame, references: list[tuple[str, DataFrame]], partitions: int | None = None) -> DataFrame:
    """Every reference without a live parent at the moment its row was loaded.

    parents: key BIGINT, version INT, visible BOOLEAN, loaded_at TIMESTAMP. references: pairs of a
    table's name and its rows (record_id BIGINT, key BIGINT, loaded_at TIMESTAMP). Result: distinct
    (ref_table, period, record_id, key, reason).

    Null keys are no references and null parent keys no parents. A parent row without load time
    counts as never loaded, one without visibility as visible, one without version as the lowest.
    A reference without load time is judged as loaded after everything and has a null period.
    Empty inputs give no rows of their own; further columns are ignored; repeated rows count once.
    A key that holds a large share of the references is spread over salted copies of its parent.
    """
    spark = parents.sparkSession
    micros = lambda c, absent: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(absent))
    known = (
        parents.where("key is not null")
        .select(
            "key",
            F.coalesce(F.col("version").cast("long"), F.lit(-(2**31))).alias("a"),
            F.coalesce(F.col("visible"), F.lit(True)).cast("long").alias("b"),
            micros("loaded_at", NEVER).alias("ts"),
        )
        .groupBy("key", "a", "b")  # a parent's repeated rows collapse before they travel
        .agg(F.min("ts").alias("ts"))
    )
    refs = None
    for i, (_, df) in enumerate(references):
        part = df.where("key is not null").select(
            F.lit(i + 1).alias("kind"), "key", micros("loaded_at", NEVER - 1).alias("ts"), F.col("record_id").cast("long").alias("a"),
            F.lit(0).cast("long").alias("b"),
        )
        refs = part if refs is None else refs.unionByName(part)
    hot = hot_keys(refs, "key")
    refs = refs.withColumn("salt", salt_of(F.col("key"), hot, F.struct("a", "ts")))
    known = known.select(F.lit(0).alias("kind"), "key", "ts", "a", "b", F.explode(salts_of(F.col("key"), hot)).alias("salt"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = known.unionByName(refs).repartitionByRange(n, "key", "salt").sortWithinPartitions("kind").select("kind", "key", "ts", "a", "b")
    misses = both.mapInArrow(_probe_partition, "kind int, key long, ts long, record_id long, reason int")
    names = F.element_at(F.array(*[F.lit(name) for name, _ in references]), F.col("kind"))
    reasons = F.element_at(F.array(F.lit("missing"), F.lit("late"), F.lit("deleted")), F.col("reason"))
    return misses.select(
        names.alias("ref_table"), _month(F.col("ts")).alias("period"), "record_id", "key", reasons.alias("reason")
    ).distinct()


def _month(ts: Column) -> Column:
    return F.when(ts < NEVER - 1, F.date_format(F.timestamp_micros(ts), "yyyy-MM"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Misses per table, period and reason: rows, records and absent keys concerned."""
    return orphans.groupBy("ref_table", "period", "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("key").alias("n_keys")
    )
