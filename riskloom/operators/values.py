"""Variants of a score compared by what they are worth: ranking by count and by value, and detection and cost under an insult cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch
from .metrics import average_precision, threshold_under_cap
from .resample import draw_aps, draw_sums

#: What is compared: average precision, the same with rows weighed by amount, and the share of fraud's value caught at a variant's own threshold.
MEASURES = ("count", "value", "vdr")


def compare_values(df: DataFrame, key: str, scores: dict[str, str], base: str, draws: int = 400, cap: float = 0.01, y: str = "y", amount: str = "amount_inr") -> DataFrame:
    """One row a variant and measure: its value, and its change from ``base`` with a 95 % interval, plain and Bonferroni-corrected.

    ``scores``: the score column of each variant, all on the same rows. Beside each stand the variant's cheapest threshold
    under the cap, its recall, insult rate and total cost there, and how much more than the base's that costs. Rankings make
    one family of comparisons, under both weightings; detection rates make another, at thresholds held fixed in all
    draws. A null score, label or amount counts as 0. A table without rows gives none.
    """
    s = Scratch(df.sparkSession, "values")
    names = [base, *(n for n in scores if n != base)]
    columns = [f"s{i}" for i in range(len(names))]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    rows = s.table(df.select(F.col(key).alias("id"), zero(y).cast("int").alias("y"), zero(amount).alias("amount_inr"), *[zero(scores[n]).alias(c) for n, c in zip(names, columns)]), "rows")
    caps = [threshold_under_cap(rows, cap, s=c).first() for c in columns]  # one row a variant
    if caps[0] is None:
        caps = []
    points = df.sparkSession.createDataFrame(
        [(i, names[i], r.threshold, r.recall, r.insult_rate, r.total_cost_inr, r.total_cost_inr - caps[0].total_cost_inr) for i, r in enumerate(caps)],
        "m int, name string, cap_threshold double, cap_recall double, cap_insult_rate double, cap_total_inr double, cap_more_inr double")
    caught = [F.when(F.col(c) >= r.threshold, F.col("amount_inr")) for c, r in zip(columns, caps)]
    ranked = rows.select("y", "amount_inr", F.posexplode(F.array(*columns)).alias("m", "s"))
    held = rows.where("y = 1").agg(F.array(*[F.coalesce(F.try_divide(F.sum(c), F.sum("amount_inr")), F.lit(0.0)) for c in caught]).cast("array<double>").alias("x"))
    seen = average_precision(ranked, by=("m",)).select("m", F.lit("count").alias("measure"), F.col("ap").alias("observed")).union(
        average_precision(ranked, weight="amount_inr", by=("m",)).select("m", F.lit("value"), "ap")).union(held.select(F.posexplode("x").alias("m", "x")).select("m", F.lit("vdr"), "x"))

    def changes(measure: str, values: list) -> list:
        """Differences from the first, by draw."""
        of = [F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0.0)) for v in values]
        return [F.posexplode(F.array(*[v - of[0] for v in of])).alias("m", "delta"), F.lit(measure).alias("measure")]

    of = [F.max(F.when(F.col("m") == i, F.col("ap"))).alias(c) for i, c in enumerate(columns)]
    # both weightings in one pass, as hashes cost most; written, as each is read
    ranks = s.table(draw_aps(rows, "id", draws, columns, weight=[None, "amount_inr"]).groupBy("_g", "b").agg(*of), "ranks")

    def intervals(deltas: DataFrame, comparisons: int) -> DataFrame:
        tail = 0.025 / max(1, comparisons)
        at = lambda q: F.round(F.percentile("delta", q), 6)
        return deltas.where("m > 0").groupBy("m", "measure").agg(
            F.round(F.avg("delta"), 6).alias("delta"), at(0.025).alias("low"), at(0.975).alias("high"), at(tail).alias("corrected_low"), at(1 - tail).alias("corrected_high"))

    others = len(names) - 1
    sums = draw_sums(rows.where("y = 1"), "id", draws, {"all": F.col("amount_inr"), **{f"c{i}": c for i, c in enumerate(caught)}}).where("n > 0")
    found = intervals(ranks.where("_g = 0").select(*changes("count", columns)).union(ranks.where("_g = 1").select(*changes("value", columns))), 2 * others)
    if caps:
        found = found.union(intervals(sums.select(*changes("vdr", [F.try_divide(f"c{i}", "all") for i in range(len(caps))])), others))
    # all of these have one row a variant and measure
    return seen.join(points, "m").join(found, ["m", "measure"], "left").select(
        "name", "measure", F.round("observed", 6).alias("observed"), "cap_threshold", "cap_recall", "cap_insult_rate", "cap_total_inr", F.round("cap_more_inr", 2).alias("cap_more_inr"),
        "delta", "low", "high", "corrected_low", "corrected_high", ((F.col("corrected_low") > 0) | (F.col("corrected_high") < 0)).alias("significant"))
