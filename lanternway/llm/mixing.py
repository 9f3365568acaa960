"""Mixing sources to target weights: weighted sampling without replacement by exponential keys.

Each document draws an exponential variate divided by its quality weight (Efraimidis and Spirakis);
the smaller, the earlier it is taken. A source first gives whole epochs, then the documents with the smallest
keys up to the rest of its token budget. Where that prefix ends is found by narrowing: the sums of equal slices of a
range of keys (a bounded table) say which slice holds the boundary, and that slice is the next range, until it holds
so few documents that one task can sort them, whatever the weights and the size of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.llm.tokens import DEFAULT_TOKENIZER, with_token_counts
from lanternway.runtime import Scratch

#: Slices a range of keys is cut into, and documents of one source that one task sorts.
SLICES, BORDER = 1024, 200_000
LEAST_WEIGHT = 0.01


def plan_budgets(available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: budget, whole epochs and the rest in tokens.

    Without total_tokens the mixture is as large as it can be with every source that has any documents
    reaching its share within its repeats. The tables have a row a source.
    """
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max(F.greatest("max_repeats", F.lit(0))).cast("long").alias("max_repeats")
    )
    a = t.join(available, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0).cast("long"))).withColumn("largest_tokens", F.coalesce("largest_tokens", F.lit(0).cast("long")))
    # Whole-token caps avoid a last fraction; one window over a row a target.
    cap = F.when(F.col("available_tokens") * F.col("max_repeats") > 0, F.col("available_tokens") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(cap).over(W.partitionBy(F.lit(1))), F.lit(0.0))
    budget = F.least(F.floor(F.col("target_share") * total), F.col("available_tokens") * F.col("max_repeats"))
    out = a.withColumn("wanted_tokens", F.floor(F.col("target_share") * total)).withColumn("budget_tokens", budget)
    epochs = F.when(F.col("available_tokens") > 0, F.floor(F.col("budget_tokens") / F.greatest("available_tokens", F.lit(1)))).otherwise(0)
    return out.withColumn("epochs", epochs.cast("int")).withColumn("rest_tokens", F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens"))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of a mixture.

    sized: doc_id, source, n_tokens, weight; written before, as it is read more than once. targets: source,
    target_share, max_repeats. documents: doc_id, source, n_tokens, uses >= 1 and at most max_repeats.
    shares: a row for each target with what it has, should give and gives. Documents of no source or of
    one without target are not used; null and empty texts have no tokens and are used in whole epochs
    only; a source without documents or with share 0 gives nothing; the fractional part ends with the
    document that brings the sum nearest to the budget. Equal keys go by doc_id.
    A null weight, or one under LEAST_WEIGHT, counts as that.
    """
    spark = sized.sparkSession
    available = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.max("n_tokens").alias("largest_tokens"))
    scratch = Scratch(spark, "mix")
    plan = scratch.keep(plan_budgets(available, targets, total_tokens))
    few = plan.count() <= 10_000
    small = lambda df: F.broadcast(df) if few else df
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(u) / F.greatest(F.coalesce("weight", F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    keyed = sized.join(small(plan.select("source", "epochs", "rest_tokens")), "source").withColumn("key", key)
    border = _border(keyed.where("rest_tokens > 0 and n_tokens > 0").select("source", "key", "n_tokens", "rest_tokens"), scratch, small)
    located = keyed.join(small(border), "source", "left")
    takes = (F.col("rest_tokens") > 0) & (F.col("n_tokens") > 0)
    within = F.coalesce((F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")), F.lit(False))
    sure = located.where(~(takes & within)).withColumn("extra", F.when(takes & F.coalesce(F.col("key") < F.col("low"), F.lit(True)), 1).otherwise(0))
    w = W.partitionBy("source").orderBy("key", "doc_id")
    cum = F.col("before") + F.sum("n_tokens").over(w)
    border = located.where(takes & within).withColumn("extra", (cum - F.col("n_tokens") / 2 <= F.col("rest_tokens")).cast("int"))
    uses = (F.col("epochs") + F.col("extra")).cast("int")
    chosen = sure.unionByName(border).select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")
    given = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"), F.max("uses").alias("most_uses"))
    zero = F.lit(0).cast("long")
    all_used = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))  # a row a source
    shares = (
        plan.join(given, "source", "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", zero))
        .select(
            "source", "target_share", "max_repeats", "available_tokens", "largest_tokens", "wanted_tokens", "used_tokens",
            F.coalesce("used_documents", zero).alias("used_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.round(F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(0.0), 6).alias("reached_share"),
            F.greatest(zero, F.col("wanted_tokens") - F.col("used_tokens")).alias("short_tokens"),
        )
    )
    return chosen, shares


def _border(takers: DataFrame, scratch: Scratch, small) -> DataFrame:
    """Per source the range of keys [low, high) in which its rest of tokens is reached, with the tokens before it: source, low, high, before.

    takers: source, key, n_tokens, rest_tokens. A source that never reaches its rest has no row. Each round reads the table once and writes a row a source.
    """
    whole = takers.groupBy("source").agg(F.max("key").alias("most"), F.count(F.lit(1)).alias("n"))
    ranges = scratch.keep(whole.select("source", F.lit(0.0).alias("low"), (F.col("most") * (1 + 1e-9) + 1e-300).alias("high"), F.lit(0).cast("long").alias("before"), "n", F.lit(False).alias("found")))
    while True:
        wide = (F.col("high") - F.col("low")) / SLICES
        cut = takers.join(small(ranges.where(~F.col("found") | (F.col("n") > BORDER)).select("source", "low", "high", "before")), "source").where("key >= low and key < high")
        k = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor((F.col("key") - F.col("low")) / wide))).cast("int")
        sums = cut.withColumn("k", k).groupBy("source", "k").agg(
            F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"),
            F.first("rest_tokens").alias("rest"), F.first("before").alias("before"), F.first("high").alias("end"),
        )
        w = W.partitionBy("source").orderBy("k")
        sums = sums.withColumn("upto", F.col("before") + F.sum("t").over(w)).withColumn("next", F.coalesce(F.lead("first").over(w), "end"))
        hit = sums.where("upto >= rest and upto - t < rest")
        # The slice is bounded by keys that occur, so no rounding can put a document on the wrong side.
        narrowed = hit.select("source", F.col("first").alias("low"), F.col("next").alias("high"), (F.col("upto") - F.col("t")).alias("before"), F.when(F.col("first") < F.col("last"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("n"), F.lit(True).alias("found"))
        done = ranges.where(F.col("found") & (F.col("n") <= BORDER))
        ranges = scratch.keep(done.unionByName(narrowed))
        if ranges.where(F.col("n") > BORDER).isEmpty():
            return ranges.select("source", "low", "high", "before")


def mix_documents(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """mix over whole texts, by the documents' column ``weight`` or, without one, all alike; only documents of target sources are encoded."""
    wanted = targets.where("source is not null and target_share > 0").select("source").distinct()
    rows = docs.join(wanted, "source", "left_semi").select("doc_id", "source", (F.col("weight") if "weight" in docs.columns else F.lit(1.0)).cast("double").alias("weight"), "text")
    sized = Scratch(docs.sparkSession, "mixsized").keep(with_token_counts(rows, path=tokenizer))
    return mix(sized, targets, total_tokens, seed)
