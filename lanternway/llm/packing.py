"""Filling fixed-capacity containers with whole items: best-two-fit over the histogram of sizes.

Only how many items there are of each size decides which sizes go together, so the packing runs on the
histogram, which has at most capacity + 1 rows however many documents there are. It yields patterns (sizes
that fill one bin) and how often each is used; items then find their bin by their rank among those of equal
size. No task ever holds the documents of a container.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.llm.tokens import DEFAULT_TOKENIZER, with_token_counts
from lanternway.runtime import Scratch

#: Items of one size that one window task ranks; larger groups are salted.
RANKED_AT_ONCE = 100_000


class SizeIndex:
    """How many items of each size are left, with the largest size up to a limit found in a tree of bits, 64 sizes a word."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).tolist()
        self.left[0] = 0
        self.levels: list[list[int]] = []
        bits = [s for s, n in enumerate(self.left) if n > 0]
        width = len(self.left)
        while True:
            words = [0] * (width // 64 + 1)
            for s in bits:
                words[s >> 6] |= 1 << (s & 63)
            self.levels.append(words)
            if len(words) == 1:
                break
            bits, width = [k for k, w in enumerate(words) if w], len(words)

    def take(self, size: int, n: int = 1) -> None:
        self.left[size] -= n
        if self.left[size]:
            return
        for words in self.levels:
            words[size >> 6] &= ~(1 << (size & 63))
            size >>= 6
            if words[size]:
                return

    def give(self, size: int, n: int = 1) -> None:
        self.left[size] += n
        for words in self.levels:
            words[size >> 6] |= 1 << (size & 63)
            size >>= 6

    def largest(self, limit: int) -> int:
        """The largest size up to ``limit`` that is left, 0 if there is none."""
        at = limit + 1
        for k, words in enumerate(self.levels):
            here = words[at >> 6] & ((1 << (at & 63)) - 1) if at >> 6 < len(words) else 0
            if here:
                at = (at >> 6 << 6) + here.bit_length() - 1
                for below in reversed(self.levels[:k]):
                    at = (at << 6) + below[at].bit_length() - 1
                return at
            at >>= 6
        return 0


def best_pair(index: SizeIndex, room: int, more_than: int) -> tuple[int, int]:
    """Two items left that together fill ``room`` best, by more than ``more_than``; of equal ones with the larger first item. (0, 0) if there are none.

    First items come from the largest down; once twice the first is no more than the best sum, no later pair beats it.
    """
    best, pair = more_than, (0, 0)
    a = index.largest(room - 1) if room > 1 else 0
    while a and 2 * a > best and best < room:
        b = index.largest(min(a, room - a))
        if b == a and index.left[a] < 2:
            b = index.largest(a - 1) if a > 1 else 0
        if b and a + b > best:
            best, pair = a + b, (a, b)
        a = index.largest(a - 1) if a > 1 else 0
    return pair


def best_two_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> items of it in a bin) with the number of bins of each.

    counts[s]: items of size s, sizes 1 .. capacity = len(counts) - 1. A bin starts with the largest
    item left and is filled greedily with the largest that fits; then its smallest item gives way to two
    unpacked ones that fill the widened gap more tightly, as long as that gains. As long as there are as many
    items of each size as were tried together, the next bin would be filled just so, and the pattern is repeated.
    """
    capacity = len(counts) - 1
    index = SizeIndex(counts)
    out = []
    while index.largest(capacity):
        held: dict[int, int] = {}
        tried: dict[int, int] = {}
        gap = capacity

        def put(s: int) -> None:
            nonlocal gap
            index.take(s)
            gap -= s
            held[s] = held.get(s, 0) + 1
            tried[s] = max(tried.get(s, 0), held[s])

        while gap and (s := index.largest(gap)):
            put(s)
        while gap and sum(held.values()) > 1:
            small = min(held)
            pair = best_pair(index, gap + small, small)
            if pair == (0, 0):
                break
            index.give(small)
            gap += small
            held[small] -= 1
            if not held[small]:
                del held[small]
            for s in pair:
                put(s)
        more = max(0, min((index.left[s] - tried[s]) // held.get(s, 0) + 1 if s in held else (1 << 62 if index.left[s] >= tried[s] else 0) for s in tried))
        if more:
            for s, m in held.items():
                index.take(s, more * m)
        out.append((dict(sorted(held.items(), reverse=True)), 1 + more))
    return out


def _slots(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each size the runs of ranks a pattern takes: rank r >= first goes to bin + (r - first) // per_bin."""
    counts = np.zeros(int(pdf["capacity"].iloc[0]) + 1, np.int64)
    np.add.at(counts, pdf["size"].to_numpy(), pdf["n"].to_numpy())
    rows, used, bins = [], np.zeros(len(counts), np.int64), 0
    for pattern, n in best_two_fit(counts):
        for s, m in pattern.items():
            rows.append((s, used[s], bins, m))
            used[s] += n * m
        bins += n
    if counts[0]:
        rows.append((0, 0, 0, 0))
    rows.append((-1, 0, max(bins, 1), 0))  # how many bins there are
    out = pd.DataFrame(rows, columns=["size", "first", "bin", "per_bin"])
    return out.assign(which=pdf["which"].iloc[0])[["which", "size", "first", "bin", "per_bin"]]


def pack_items(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Bins of each container for all items.

    sizes: doc_id BIGINT unique, n_tokens BIGINT. containers: container STRING, capacity_tokens INT; a small
    table, its rows are read to the driver. An item larger than the capacity is split into full pieces
    and a rest, any other stays whole. Empty items go anywhere; null sizes count as empty; a container
    without a positive capacity holds nothing and gives no rows, of two rows for a container the larger
    counts. Result: container, bin_id, doc_id, part_no, part_tokens.
    """
    spark = sizes.sparkSession
    kinds = containers.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("int").alias("capacity")).orderBy("container").collect()
    schema = "container string, bin_id long, doc_id long, part_no int, part_tokens int"
    if not kinds:
        return spark.createDataFrame([], schema)
    scratch = Scratch(spark, "packing")
    listed = F.from_json(F.lit(json.dumps([{"which": i, "container": r[0], "capacity": r[1]} for i, r in enumerate(kinds)])), "array<struct<which:int,container:string,capacity:int>>")
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    rest = F.when(n > F.col("capacity"), n % F.col("capacity")).otherwise(n)
    full = F.when(n > F.col("capacity"), F.floor(n / F.col("capacity"))).otherwise(0).cast("int")
    whole = sizes.select("doc_id", "n_tokens", F.explode(listed).alias("k")).select("doc_id", "n_tokens", "k.which", "k.capacity")
    parts = whole.select(
        "which", "capacity", "doc_id",
        F.concat(F.array_repeat(F.col("capacity"), full), F.when((rest > 0) | (n == 0), F.array(rest.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))).alias("parts"),
    )
    items = parts.select("which", "capacity", "doc_id", F.posexplode("parts").alias("part_no", "size"))
    histogram = scratch.keep(items.groupBy("which", "capacity", "size").agg(F.count(F.lit(1)).alias("n")))
    slots = histogram.groupBy("which").applyInPandas(_slots, "which int, size int, first long, bin long, per_bin int").toPandas()
    # Bounded by the capacities, not by the documents: (patterns a size) x (sizes a bin).
    places = spark.sparkContext.broadcast(SlotTable(slots))

    salts = histogram.where(F.col("n") > RANKED_AT_ONCE).select("which", "size", F.ceil(F.col("n") / RANKED_AT_ONCE).cast("int").alias("salts"))
    crowded = salts.limit(1).count() > 0
    salted = items.drop("capacity")
    if crowded:
        salted = salted.join(F.broadcast(salts), ["which", "size"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    else:
        salted = salted.withColumn("salt", F.lit(0))
    rank = F.row_number().over(W.partitionBy("which", "size", "salt").orderBy("doc_id", "part_no")) - 1
    ranked = salted.withColumn("rank", rank.cast("long"))
    if crowded:
        per_salt = salted.join(F.broadcast(salts), ["which", "size"], "left_semi").groupBy("which", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
        before = F.coalesce(F.sum("m").over(W.partitionBy("which", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(per_salt.withColumn("before", before).drop("m"), ["which", "size", "salt"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, size, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places.value.bins(which, size, r)), batch.column(1), batch.column(2), batch.column(3)], names=["which", "bin_id", "doc_id", "part_no", "part_tokens"])

    placed = ranked.select("which", "doc_id", "part_no", "size", "rank").mapInArrow(place, "which int, bin_id long, doc_id long, part_no int, part_tokens int")
    return placed.select(F.element_at(listed, F.col("which") + 1)["container"].alias("container"), "bin_id", "doc_id", "part_no", "part_tokens")


class SlotTable:
    """For items of one container and size, by rank, the bin they go to."""

    def __init__(self, slots: pd.DataFrame):
        counts = slots[slots["size"] == -1]
        self.n_bins = np.zeros(int(slots["which"].max() if len(slots) else 0) + 1, np.int64)
        self.n_bins[counts["which"].to_numpy()] = counts["bin"].to_numpy()
        rows = slots[slots["size"] >= 0].sort_values(["which", "size", "first"])
        self.first, self.bin, self.per = (rows[c].to_numpy(np.int64) for c in ("first", "bin", "per_bin"))
        # a size has at most 31 bits
        code = rows["which"].to_numpy(np.int64) << 31 | rows["size"].to_numpy(np.int64)
        self.code, self.begin = np.unique(code, return_index=True)
        self.end = np.r_[self.begin[1:], len(code)]

    def bins(self, which: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        group = np.searchsorted(self.code, which << 31 | size)
        low, high = self.begin[group], self.end[group]  # the last run that begins at the rank or before it
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            up = self.first[middle] <= rank
            low, high = np.where(open_ & up, middle, low), np.where(open_ & ~up, middle, high)
        per = self.per[low]
        # Empty items take no room: they are dealt out over all bins.
        return np.where(per > 0, self.bin[low] + (rank - self.first[low]) // np.maximum(per, 1), rank % self.n_bins[which])


def pack_documents(docs: DataFrame, containers: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """pack_items over whole texts, sized by the tokenizer; each text is read and encoded once."""
    sized = Scratch(docs.sparkSession, "sized").keep(with_token_counts(docs.select("doc_id", "text"), path=tokenizer))
    return pack_items(sized, containers)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Bins, tokens and the share of room used, per container."""
    caps = containers.where("container is not null").groupBy("container").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    bins = packed.groupBy("container", "bin_id").agg(F.sum("part_tokens").alias("t"))
    per = bins.groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return per.join(caps, "container").select("container", "capacity_tokens", "n_bins", "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"))
