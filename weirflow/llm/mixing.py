"""Mixing sources to target shares of tokens.

The mixture is as large as the scarcest source allows: every source's budget is its share of it, and no document is used more than its source's max_repeats.
Whole passes over a source come first. What its budget then lacks is a subset-sum problem over the counts of documents per exact token length:
lengths are drawn in proportion, and the last stretch is filled by bounded-knapsack dynamic programming over the lengths left. Documents of a length are
interchangeable for the sum, so which of them serve is decided by a seeded hash.

Defined cases: documents without tokens (null, empty) and those of null sources or sources without a target are not in the mixture. A target without
any tokens gets none, and the mixture is sized by the others. max_repeats below 1 counts as 0, null as 1; negative and null shares as 0. With repeated rows of a target the first by max_repeats holds.
The sizes of the problem that one task sees are distinct lengths and hash buckets, never documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 17
#: Hash buckets within a length; ties in the last needed bucket are settled by the full hash and id.
BUCKETS = 256
#: Tokens of a budget that are left to the dynamic programme.
STRETCH = 16_384


def fit(budget: int, lengths: dict[int, int], stretch: int = STRETCH) -> dict[int, int]:
    """How many documents of each length to take (at most lengths[l] of length l), so that their sum comes as near below or at budget as the lengths allow."""
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    if budget <= 0 or not total:
        return {}
    reserve = min(budget, max(stretch, 2 * min(lengths)))
    take = {n: c * (budget - reserve) // total for n, c in lengths.items()}
    left = budget - sum(n * c for n, c in take.items())
    for n in sorted(lengths, reverse=True):  # what rounding down left over, longest first, down to the last stretch
        more = min(lengths[n] - take[n], max(0, (left - stretch) // n))
        take[n] += more
        left -= more * n
    # Reachable sums as the bits of one integer, per layer; a layer is a bundle of 1, 2, 4, ... documents of one length.
    limit = left
    mask = (1 << limit + 1) - 1
    layers: list[tuple[int, int]] = []
    states = [1]
    for n in sorted(lengths, reverse=True):
        rest, bundle = min(lengths[n] - take[n], limit // n), 1
        while rest > 0:
            k = min(bundle, rest)
            now = (states[-1] | states[-1] << n * k) & mask
            rest -= k
            bundle *= 2
            if now != states[-1]:
                layers.append((n, k))
                states.append(now)
        if states[-1] >> limit & 1:
            break
    at = states[-1].bit_length() - 1
    for i in range(len(layers) - 1, -1, -1):
        n, k = layers[i]
        if not states[i] >> at & 1:
            take[n] += k
            at -= n * k
    return {n: c for n, c in take.items() if c}


def _targets(targets: DataFrame) -> DataFrame:
    """source, cap, share: one row per source (the first by max_repeats, then by share), with the defined values for nulls and negatives."""
    cap, share = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    return targets.groupBy("source").agg(F.min(F.struct(cap.alias("cap"), share.alias("share"))).alias("t")).select("source", "t.*")


def sized(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents that may be in the mixture: doc_id, source, n_tokens, share, cap, rank, bucket. docs: doc_id, source, n_tokens."""
    t = _targets(targets).filter("cap > 0 and share > 0")
    return docs.select("doc_id", "source", "n_tokens").filter("n_tokens > 0").join(t, "source").withColumn("rank", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("rank", F.lit(BUCKETS)).cast("int"))


def plan(parts: DataFrame, size: int | None = None) -> DataFrame:
    """Per source and length: source, n_tokens, passes (uses of every document), extra (documents used once more)."""
    counts = parts.groupBy("source", "n_tokens", "share", "cap").agg(F.count("*").alias("docs"))
    totals = counts.groupBy("source", "share", "cap").agg(F.sum(F.col("n_tokens").cast("long") * F.col("docs")).alias("tokens"))
    mixture = totals.agg(F.min(F.col("tokens") * F.col("cap") / (F.col("share"))).alias("largest"), F.sum("share").alias("shares"))
    sized_to = F.col("largest") if size is None else F.least(F.col("largest"), F.lit(float(size)) / F.col("shares"))
    budgets = totals.crossJoin(F.broadcast(mixture)).select("source", "cap", "tokens", F.floor(F.col("share") * sized_to + 1e-6).cast("long").alias("budget"))  # mixture is one row
    hist = counts.select("source", "n_tokens", "docs").join(budgets, "source")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        budget, tokens, cap = (int(group[c].iloc[0]) for c in ("budget", "tokens", "cap"))
        passes = min(cap, budget // tokens)
        extra = fit(budget - passes * tokens, dict(zip(group.n_tokens.astype(int), group.docs.astype(int), strict=True))) if passes < cap else {}
        return pd.DataFrame({"source": group.source, "n_tokens": group.n_tokens, "passes": passes, "extra": [extra.get(int(n), 0) for n in group.n_tokens]})

    return hist.groupBy("source").applyInPandas(draw, "source string, n_tokens int, passes int, extra long")


def mixed(docs: DataFrame, targets: DataFrame, size: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: doc_id, source, n_tokens, copies (1 and more)."""
    parts = sized(docs, targets, seed)
    counts = parts.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.join(plan(parts, size), ["source", "n_tokens"]).withColumn("sofar", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = quota.select("source", "n_tokens", "bucket", "passes", F.least(F.greatest(F.col("extra") - F.col("sofar"), F.lit(0)), F.col("n")).alias("quota"), "n")
    x = parts.join(quota, ["source", "n_tokens", "bucket"])
    sure = x.filter((F.col("quota") == 0) | (F.col("quota") == F.col("n"))).withColumn("more", (F.col("quota") > 0).cast("int"))
    within = Window.partitionBy("source", "n_tokens", "bucket").orderBy("rank", "doc_id")
    split = x.filter((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).withColumn("more", (F.row_number().over(within) <= F.col("quota")).cast("int"))
    return sure.unionByName(split).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("more")).cast("int").alias("copies")).filter("copies > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: source, target_share, documents, tokens, actual_share, most_copies; targets without documents with zeros."""
    per = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    t = _targets(targets).select("source", F.col("share").alias("target_share"))
    joined = t.join(per, "source", "left").crossJoin(F.broadcast(whole))  # whole is one row
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", z("documents"), z("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), z("most_copies"))
