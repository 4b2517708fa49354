"""Metrics of scored rows: label y (0/1), score s, amount; all tie-correct.

Rows are counted by distinct score once; running sums, quantiles, curves and costs come
from that table, in ranges of scores, so no task sees all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fixed
from ..scratch import Scratch
from .ranges import quantiles, quantiles_of, running

#: Reporting constants. Fixed values.
USD_TO_INR, MARGIN, CHARGEBACK = 88.0, 0.12, 1200.0
WEIGHT_FLOOR, PROPORTION_FLOOR = 1e-6, 1e-6


def inr(amount: Column) -> Column:
    return amount * USD_TO_INR


def average_precision(df: DataFrame, y: str = "y", s: str = "s", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over distinct scores, highest first, of the recall gained times the precision there; null without positives."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if weight is not None:
        w = F.when(F.assert_true(F.col(weight) >= 0, "weights may not be negative").isNull(), w)
    r = running(df.where(F.col(y).isNotNull() & F.col(s).isNotNull()), s, {"tp": F.sum(w * F.col(y)), "all": F.sum(w)}, by)
    per = r.groupBy(*by) if by else r
    return per.agg(F.try_divide(F.sum(F.col("tp") * F.try_divide("cum_tp", "cum_all")), F.sum("tp")).alias("ap"))


def roc_auc(df: DataFrame, y: str = "y", s: str = "s", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Chance that a positive outscores a negative, ties a half; null unless both are there."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    r = running(df.where(F.col(y).isNotNull() & F.col(s).isNotNull()), s, {"pos": F.sum(w * F.col(y)), "neg": F.sum(w * (1.0 - F.col(y)))}, by)
    per = r.groupBy(*by) if by else r
    return per.agg(F.try_divide(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def curve_of(table: DataFrame) -> DataFrame:
    """As pr_curve(), of a table by score."""
    total = table.agg(F.sum("tp").alias("p"))
    points = table.crossJoin(F.broadcast(total)).select(  # one row
        F.col("s").alias("threshold"), F.round(F.col("cum_tp") / F.col("cum_n"), 6).alias("precision"), F.round(F.try_divide("cum_tp", "p"), 6).alias("recall"))
    return points.union(table.sparkSession.range(1).select(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)))


def pr_curve(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """precision and recall at each distinct threshold, and the end point (1, 0) without one."""
    return curve_of(running(df.withColumn("_s", F.col(s).cast("double")), "_s", {"tp": F.sum(F.col(y).cast("double")), "n": F.sum(F.lit(1.0))}).withColumnRenamed("_s", "s"))


COSTS = {
    "tp": lambda y, a: F.sum(y), "n": lambda y, a: F.count("*"), "amt_pos": lambda y, a: F.sum(F.when(y == 1, a).otherwise(0.0)),
    "amt_neg": lambda y, a: F.sum(F.when(y == 0, a).otherwise(0.0)),
}


def by_score(df: DataFrame, y: str = "y", s: str = "s", amount: str = "amount_inr") -> DataFrame:
    """The rows by distinct score, with counts, amounts and running totals from the highest on; a table in shared storage."""
    sums = {c: f(F.col(y).cast("double"), F.col(amount)) for c, f in COSTS.items()}
    rows = df.where(F.col(s).isNotNull() & F.col(y).isNotNull()).withColumn("_s", F.col(s).cast("double"))
    return Scratch(df.sparkSession, "scores").table(running(rows, "_s", sums).withColumnRenamed("_s", "s"), "by_score")


def at_thresholds(df: DataFrame, thresholds: list[float], y: str = "y", s: str = "s", amount: str = "amount_inr") -> DataFrame:
    """Confusion counts and costs at each threshold (inclusive), all in one pass over the rows."""
    return costs(df, thresholds, s, {c: f(F.col(y), F.col(amount)) for c, f in COSTS.items()})


def costs(df: DataFrame, thresholds: list[float], s: str = "s", sums: dict[str, Column] | None = None) -> DataFrame:
    """As at_thresholds(), of rows or (without ``sums``) of their table by score.

    Rows are counted by how many thresholds they reach; the sums over those at or above
    each threshold come from that table of len(thresholds) + 1 rows.
    """
    sums = sums or {c: F.sum(c) for c in COSTS}
    ts = sorted(set(thresholds))
    spark = df.sparkSession
    reach = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ts]), lambda t: t <= F.col(s)))
    per = df.groupBy(reach.alias("k")).agg(*[f.alias(c) for c, f in sums.items()])
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "k int, threshold double")
    total = per.agg(*[F.sum(c).alias(f"all_{c}") for c in COSTS])
    up = grid.alias("g").join(F.broadcast(per.withColumnRenamed("k", "r")), F.col("r") >= F.col("k"), "left")  # small by small
    up = up.groupBy("k", "threshold").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COSTS]).crossJoin(total)
    whole = lambda c: c.cast("long")
    tp, fp = F.col("tp"), F.col("n") - F.col("tp")
    fn, tn = F.col("all_tp") - tp, F.col("all_n") - F.col("all_tp") - fp
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    caught, missed = F.col("amt_pos"), F.col("all_amt_pos") - F.col("amt_pos") + fn * CHARGEBACK
    insult = F.col("amt_neg") * MARGIN
    return up.select(
        "threshold", whole(tp).alias("tp"), whole(fp).alias("fp"), whole(fn).alias("fn"), whole(tn).alias("tn"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"),
        zero(fp, fp + tn).alias("insult_rate"), F.round(caught, 2).alias("caught_inr"), F.round(missed, 2).alias("missed_inr"),
        F.round(insult, 2).alias("insult_cost_inr"), F.round(missed + insult, 2).alias("total_cost_inr"))


def linspace(a: float, b: float, n: int) -> list[float]:
    return [a + (b - a) * i / (n - 1) for i in range(n)]


#: Levels of the score quantiles that are tried as thresholds: by cost, under a cap, in a sweep. Fixed values.
BY_COST, UNDER_CAP, SWEEP = (0.5, 0.9999, 200), (0.5, 0.99999, 200), (0.85, 0.99995, 150)


def candidates(table: DataFrame, a: float, b: float, n: int, extra: tuple[float, ...] = ()) -> list[float]:
    """Distinct score quantiles at n even levels, exact, of a table by score."""
    return sorted({*quantiles_of(table, "s", linspace(a, b, n), weight="n"), *map(float, extra)})


def cheapest(costs: DataFrame) -> DataFrame:
    """The cheapest threshold; of equals the lowest."""
    return costs.orderBy("total_cost_inr", "threshold").limit(1)


def cheapest_under(costs: DataFrame, cap: float) -> DataFrame:
    """The cheapest threshold whose insult rate is within the cap; if none, the one with the least insult rate."""
    over = F.col("insult_rate") > cap
    return costs.orderBy(over, F.when(over, F.col("insult_rate")).otherwise(F.col("total_cost_inr")), "threshold").limit(1)


def threshold_by_cost(df: DataFrame, **cols) -> DataFrame:
    table = by_score(df, **cols)
    return cheapest(costs(table, candidates(table, *BY_COST)))


def threshold_under_cap(df: DataFrame, cap: float = 0.01, **cols) -> DataFrame:
    table = by_score(df, **cols)
    return cheapest_under(costs(table, candidates(table, *UNDER_CAP)), cap)


def threshold_sweep(df: DataFrame, extra: tuple[float, ...] = (), **cols) -> DataFrame:
    table = by_score(df, **cols)
    return costs(table, candidates(table, *SWEEP, extra=extra))


def evaluate(name: str, df: DataFrame, y: str = "y", s: str = "s", amount: str = "amount_inr", cap: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, points, curve) of one pass over the rows: the summary row, both operating points in full, and the PR curve.

    points: point ('cost' or 'cap') and the columns of at_thresholds(). A table without rows gives none.
    """
    table = by_score(df, y, s, amount)
    a, b = candidates(table, *BY_COST), candidates(table, *UNDER_CAP)
    every = Scratch(df.sparkSession, "points").table(costs(table, sorted({*a, *b})), "costs")  # at most 400 rows
    pick = lambda ts: every.where(F.col("threshold").isin(ts))
    points = cheapest(pick(a)).select(F.lit("cost").alias("point"), "*").union(cheapest_under(pick(b), cap).select(F.lit("cap"), "*"))
    neg = F.col("n") - F.col("tp")
    whole = table.agg(
        F.sum("n").alias("rows"), F.try_divide(F.sum("tp"), F.sum("n")).alias("prevalence"), F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")).alias("ap"),
        F.try_divide(F.sum(neg * (F.col("cum_tp") - F.col("tp") / 2)), F.sum("tp") * F.sum(neg)).alias("auc"))
    at = lambda p, c: points.where(F.col("point") == p).select(*[F.col(x).alias(f"{p}_{y}") for x, y in c])
    both = (("threshold", "threshold"), ("total_cost_inr", "total_inr"))
    report = whole.crossJoin(at("cost", both)).crossJoin(at("cap", both)).select(  # one row each
        F.lit(name).alias("name"), F.col("rows").cast("long").alias("rows"), F.round("prevalence", 6).alias("prevalence"), F.round("ap", 6).alias("auc_pr"),
        F.round(F.try_divide("ap", "prevalence"), 4).alias("lift"), F.round("auc", 6).alias("auc_roc"), "cost_threshold", "cost_total_inr", "cap_threshold", "cap_total_inr")
    return report, points, curve_of(table)


def evaluation_report(name: str, df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """One row: prevalence, AUC-PR, lift over it, AUC-ROC and both operating points."""
    return evaluate(name, df, y, s)[0]


def report_line(report: DataFrame) -> DataFrame:
    """name and a line of text about an evaluation_report row."""
    return report.select("name", F.concat("name", F.lit(": AUC-PR "), fixed(F.col("auc_pr"), 4), F.lit(" ("), fixed(F.col("lift"), 1), F.lit("x prevalence), AUC-ROC "), fixed(F.col("auc_roc"), 4)).alias("line"))


def point_lines(points: DataFrame) -> DataFrame:
    """point and a line of text about each operating point."""
    x = lambda c, places: fixed(F.col(c), places)
    n = lambda c: F.col(c).cast("string")
    return points.select("point", F.concat(
        F.col("point"), F.lit(" at "), x("threshold", 4), F.lit(": precision "), x("precision", 4), F.lit(", recall "), x("recall", 4), F.lit(", "), n("tp"), F.lit(" caught and "), n("fn"), F.lit(" missed, "),
        n("fp"), F.lit(" legitimate declined ("), fixed(F.col("insult_rate") * 100, 3), F.lit("%), Rs "), x("missed_inr", 2), F.lit(" missed, Rs "), x("insult_cost_inr", 2), F.lit(" insult cost, Rs "), x("total_cost_inr", 2), F.lit(" in all")).alias("line"))


def summary_lines(report: DataFrame, points: DataFrame) -> DataFrame:
    """(place, line): the report's line and those of its operating points, in order."""
    return report_line(report).select(F.lit(0).alias("place"), "line").union(point_lines(points).select(F.when(F.col("point") == "cost", 1).otherwise(2), "line"))


def brier(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col(s) - F.col(y), 2)), 6).alias("brier"))


def edges_of(df: DataFrame, column: str, bins: int, strategy: str = "quantile") -> list[float]:
    """bins + 1 edges: interpolated quantiles, or even steps from 0 to 1."""
    levels = [i / bins for i in range(bins + 1)]
    return levels if strategy == "uniform" else quantiles_of(df, column, levels)


def place_of(x: Column, edges: list[float], strict: bool) -> Column:
    """How many edges lie below x, or at or below it."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: (e < x) if strict else (e <= x)))


def calibration_bins(df: DataFrame, y: str = "y", s: str = "s", bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """bin, n, mean score and observed rate; a row is in the bin of as many inner edges as lie strictly below its score."""
    rows = df.where(F.col(s).isNotNull())
    at = place_of(F.col(s), edges_of(rows, s, bins, strategy)[1:-1], strict=True)
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(s).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed_rate"))


def calibration_report(name: str, df: DataFrame, y: str = "y", s: str = "s", bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """One row: Brier score, expected calibration error, worst bin and number of bins."""
    per = calibration_bins(df, y, s, bins, strategy).withColumn("gap", F.abs(F.col("mean_score") - F.col("observed_rate")))
    return brier(df, y, s).crossJoin(per.agg(  # one row by one row
        F.round(F.try_divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")), 6).alias("ece"), F.round(F.max("gap"), 6).alias("worst_bin"), F.count("*").alias("bins"))).select(
        F.lit(name).alias("name"), "brier", "ece", "worst_bin", "bins")


def value_concentration(df: DataFrame, inside: Column, y: str = "y", amount: str = "amount_inr") -> DataFrame:
    """Share of fraud by count and by value inside a mask, with mean and median amounts in and out."""
    fraud = df.where(F.col(y) == 1).withColumn("_in", F.coalesce(inside, F.lit(False)))
    a = F.col(amount)
    m, o = F.when(F.col("_in"), a), F.when(~F.col("_in"), a)
    zero = lambda x, t: F.round(F.coalesce(F.try_divide(x, t), F.lit(0.0)), 6)
    count, value = F.count_if("_in"), F.coalesce(F.sum(m), F.lit(0.0))
    medians = quantiles(fraud, amount, [0.5], ("_in",))
    median = lambda side: F.round(F.lit(medians.get((side,), [None])[0]).cast("double"), 2)
    return fraud.agg(
        F.count("*").alias("fraud_rows"), zero(count, F.count("*")).alias("count_share"), zero(value, F.sum(a)).alias("value_share"),
        F.round(F.avg(m), 2).alias("mean_in"), F.round(F.avg(o), 2).alias("mean_out"), median(True).alias("median_in"), median(False).alias("median_out"),
        F.round(F.try_divide(F.try_divide(value, F.sum(a)), F.try_divide(count, F.count("*"))), 4).alias("enrichment"))


def value_detection_rate(df: DataFrame, threshold: float, y: str = "y", s: str = "s", amount: str = "amount_inr") -> DataFrame:
    caught = F.sum(F.when((F.col(y) == 1) & (F.col(s) >= threshold), F.col(amount)).otherwise(0.0))
    total = F.sum(F.when(F.col(y) == 1, F.col(amount)).otherwise(0.0))
    return df.agg(F.round(F.coalesce(F.try_divide(caught, total), F.lit(0.0)), 6).alias("vdr"))


def cost_weights(df: DataFrame, y: str = "y", usd: str = "amount", normalise: bool = True) -> DataFrame:
    """Adds ``weight``: what an error on the row costs in rupees, at least a floor, over the mean (a scalar from one pass)."""
    a = inr(F.col(usd))
    w = F.greatest(F.when(F.col(y) == 1, a + CHARGEBACK).otherwise(a * MARGIN), F.lit(WEIGHT_FLOOR))
    if not normalise:
        return df.withColumn("weight", w)
    mean = df.agg(F.avg(w)).first()[0] or 1.0
    return df.withColumn("weight", w / F.lit(mean))


def effective_sample_size(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Squared sum over sum of squares; 0 without positive weight."""
    w = F.col(weight)
    return df.agg(F.round(F.when(F.sum(w) > 0, F.pow(F.sum(w), 2) / F.sum(w * w)).otherwise(0.0), 4).alias("ess"))


def weight_summary(df: DataFrame, y: str = "y", weight: str = "weight") -> DataFrame:
    w, pos = F.col(weight), F.col(y) == 1
    ess = F.when(F.sum(w) > 0, F.pow(F.sum(w), 2) / F.sum(w * w)).otherwise(0.0)
    return df.agg(
        F.round(F.avg(w), 6).alias("mean"), F.round(ess, 4).alias("ess"), F.round(ess / F.count("*"), 6).alias("ess_share"),
        F.round(F.avg(F.when(pos, w)), 6).alias("mean_fraud"), F.round(F.avg(F.when(~pos, w)), 6).alias("mean_legit"),
        F.round(F.try_divide(F.avg(F.when(pos, w)), F.avg(F.when(~pos, w))), 4).alias("asymmetry"), F.round(F.min(w), 6).alias("least"), F.round(F.max(w), 6).alias("greatest"))


def stacked(df: DataFrame, columns: list[str], *keep: str | Column) -> DataFrame:
    """(feature, x) for each row and column, finite values only."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(rows).alias("f")).select(*[k if isinstance(k, str) else "side" for k in keep], "f.feature", "f.x").where(
        "x is not null and not isnan(x) and abs(x) <> double('infinity')")


def psi_table(reference: DataFrame, other: DataFrame, columns: list[str], side: Column | None = None, bins: int = 10) -> DataFrame:
    """(feature, side, psi) of every column over the reference's distinct quantile edges, ends open, for each side of ``other``.

    One pass over each table, whatever the number of columns and sides: values are counted
    by feature, side and value, and edges and bins come from those counts. null if the
    reference or a side has no value, 0 for a constant.
    """
    spark = reference.sparkSession
    s = Scratch(spark, "psi")
    side = (F.lit(0) if side is None else side).cast("int").alias("side")
    ref = s.table(stacked(reference, columns).groupBy("feature", "x").agg(F.count("*").alias("n")), "reference")
    cmp = s.table(stacked(other.where(side.isNotNull()), columns, side).groupBy("side", "feature", "x").agg(F.count("*").alias("n")), "other")
    sides = [r["side"] for r in other.select(side).where("side is not null").distinct().collect()]  # one a window
    edges = quantiles(ref, "x", [i / bins for i in range(bins + 1)], ("feature",), "n")
    grid = [(c, [float(e) for e in sorted(set(edges.get((c,), [])))]) for c in columns]
    known = F.broadcast(spark.createDataFrame([(c, e[1:-1], max(1, len(e) - 1)) for c, e in grid], "feature string, inner array<double>, bins int"))  # one row a column
    at = F.size(F.filter("inner", lambda e: e <= F.col("x"))).alias("bin")
    p = ref.join(known, "feature").groupBy("feature", at).agg(F.sum("n").alias("p"))
    q = cmp.join(known, "feature").groupBy("feature", "side", at).agg(F.sum("n").alias("q"))
    every = known.select("feature", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "bins")
    every = every.select("*", F.explode(F.array(*[F.lit(x) for x in sides]).cast("array<int>")).alias("side"))
    per = every.join(p, ["feature", "bin"], "left").join(q, ["feature", "side", "bin"], "left").na.fill(0, ["p", "q"])
    total = per.groupBy("feature", "side").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    share = lambda n, t: F.greatest(F.try_divide(n, t), F.lit(PROPORTION_FLOOR))
    constant = [c for c, e in grid if len(e) == 1]
    one = F.sum((share("q", "tq") - share("p", "tp")) * F.ln(share("q", "tq") / share("p", "tp")))
    return per.join(total, ["feature", "side"]).groupBy("feature", "side").agg(
        F.round(F.when((F.max("tp") > 0) & (F.max("tq") > 0), F.when(F.col("feature").isin(constant), F.lit(0.0)).otherwise(one)), 6).alias("psi"))


def psi(reference: DataFrame, other: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index of one column; one row, null if a side is empty."""
    found = psi_table(reference, other, [column], bins=bins)
    return reference.sparkSession.range(1).join(found, F.lit(True), "left").select("psi")  # one row by one row


def worst_psi(table: DataFrame) -> DataFrame:
    """(feature, psi) of the greatest PSI; of equals the feature first by name, and without any PSI the first of all."""
    return table.orderBy(F.desc_nulls_last("psi"), "feature").limit(1).select("feature", "psi")


def psi_verdict(psi: Column) -> Column:
    return F.when(psi.isNull(), "undefined").when(psi < 0.10, "stable").when(psi < 0.25, "moderate shift").otherwise("significant shift")


def window_edges(df: DataFrame, t: str, n: int) -> list[float]:
    """n equal spans of time from the first to one past the last."""
    r = df.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    return [] if r["a"] is None else [r["a"] + i * (r["b"] + 1 - r["a"]) / n for i in range(n + 1)]


def windowed(df: DataFrame, t: str, n: int) -> tuple[DataFrame, list[float]]:
    """Rows with their window [a, b) of equal time as ``window``, and the edges."""
    edges = window_edges(df, t, n)
    return df.withColumn("window", place_of(F.col(t), edges[1:-1], strict=False)), edges


def drift_windows(df: DataFrame, t: str = "TransactionDT", n: int = 6, y: str = "y", s: str = "s") -> DataFrame:
    """Per equal window of time [a, b) with rows and fraud: rows, fraud, AUC-PR, AUC-ROC, Brier."""
    rows = windowed(df, t, n)[0]
    base = rows.groupBy("window").agg(F.count("*").alias("rows"), F.sum(y).alias("fraud"), F.round(F.avg(F.pow(F.col(s) - F.col(y), 2)), 6).alias("brier")).where("fraud > 0")
    ap = average_precision(rows, y, s, by=("window",)).select("window", F.round("ap", 6).alias("auc_pr"))
    auc = roc_auc(rows, y, s, by=("window",)).select("window", F.round("auc", 6).alias("auc_roc"))
    return base.join(ap, "window").join(auc, "window")


def window_ece(rows: DataFrame, y: str = "y", s: str = "s", bins: int = 10) -> DataFrame:
    """(window, ece): expected calibration error over each window's own quantile bins."""
    edges = quantiles(rows, s, [i / bins for i in range(1, bins)], ("window",))
    known = F.broadcast(rows.sparkSession.createDataFrame([(w, e) for (w,), e in edges.items()], "window int, inner array<double>"))  # one row a window
    per = rows.join(known, "window").groupBy("window", F.size(F.filter("inner", lambda e: e < F.col(s))).alias("bin")).agg(
        F.count("*").alias("n"), F.abs(F.avg(s) - F.avg(F.col(y).cast("double"))).alias("gap"))
    return per.groupBy("window").agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 6).alias("ece"))


def drift_report(df: DataFrame, reference: DataFrame, features: list[str], key: str = "id", t: str = "TransactionDT", n: int = 6, y: str = "y", s: str = "s", draws: int = 200) -> DataFrame:
    """drift_windows() with days, prevalence, calibration error, 95 % intervals of both metrics and the feature of greatest PSI.

    ``reference``: the rows that PSI compares each window with. Intervals are of the
    Poisson bootstrap by ``key``; draws of one class alone are skipped.
    """
    from .resample import draw_metrics, intervals_of

    rows, edges = windowed(df, t, n)
    rows = Scratch(df.sparkSession, "drift").table(rows.select(key, "window", F.col(y).alias("y"), F.col(s).alias("s"), *[c for c in features if c not in (key, y, s)]), "rows")
    at = F.array(*[F.lit(float(e) / 86400) for e in edges])
    base = rows.groupBy("window").agg(F.count("*").alias("rows"), F.sum("y").alias("fraud"), F.round(F.avg(F.col("y").cast("double")), 6).alias("prevalence"),
                                      F.round(F.avg(F.pow(F.col("s") - F.col("y"), 2)), 6).alias("brier")).where("fraud > 0")
    base = base.withColumns({"start_day": F.round(F.get(at, F.col("window")), 4), "end_day": F.round(F.get(at, F.col("window") + 1), 4)})
    ap = average_precision(rows, by=("window",)).select("window", F.round("ap", 6).alias("auc_pr"))
    auc = roc_auc(rows, by=("window",)).select("window", F.round("auc", 6).alias("auc_roc"))
    found = intervals_of(draw_metrics(rows, key, draws, ["s"], by=("window",)), ("window",))
    intervals = found.select("window", F.col("ap_low").alias("auc_pr_low"), F.col("ap_high").alias("auc_pr_high"), F.col("auc_low").alias("auc_roc_low"), F.col("auc_high").alias("auc_roc_high"))
    worst = psi_table(reference, rows, features, F.col("window")).where("psi is not null").groupBy(F.col("side").alias("window")).agg(
        F.min_by(F.struct("feature", "psi"), F.struct(-F.col("psi"), F.col("feature"))).alias("w")).select("window", F.col("w.feature").alias("worst_feature"), F.col("w.psi").alias("worst_psi"))
    out = base
    for more in (window_ece(rows), ap, auc, intervals, worst):
        out = out.join(more, "window", "left")
    return out


def trend(windows: DataFrame, metric: str) -> DataFrame:
    """first, last and whether the intervals of ``metric`` (its _low and _high) of the first and the last window are disjoint."""
    ci = F.struct(F.col(f"{metric}_low").alias("low"), F.col(f"{metric}_high").alias("high"))
    ends = windows.agg(F.count("*").alias("n"), F.min("window").alias("first"), F.max("window").alias("last"), F.min_by(ci, "window").alias("a"), F.max_by(ci, "window").alias("b"))
    apart = (F.col("a.low") > F.col("b.high")) | (F.col("b.low") > F.col("a.high"))
    return ends.select("first", "last", F.coalesce((F.col("n") >= 2) & apart, F.lit(False)).alias("distinguishable"))


def metric(df: DataFrame, f: Callable[[Column, Column], Column], name: str = "metric", by: tuple[str, ...] = (), y: str = "y", s: str = "s") -> DataFrame:
    """A pluggable metric: ``f`` takes the columns of labels and scores and returns an aggregate of them, by groups or of all rows.

    Any aggregate of Spark's will do, also one of several; they are combined before the
    shuffle. Metrics of an order, such as areas, have operators of their own.
    """
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(f(F.col(y), F.col(s)).cast("double").alias(name))


def metric_by_score(df: DataFrame, f: Callable[[Column, Column, Column, Column], Column], name: str = "metric", by: tuple[str, ...] = (), y: str = "y", s: str = "s") -> DataFrame:
    """A pluggable metric of the order of scores: ``f`` takes, for each distinct score from the highest on, its positives, its rows and both running totals, and returns an aggregate over scores."""
    at = running(df.where(F.col(y).isNotNull() & F.col(s).isNotNull()), s, {"tp": F.sum(F.col(y).cast("double")), "n": F.sum(F.lit(1.0))}, by)
    grouped = at.groupBy(*by) if by else at
    return grouped.agg(f(*[F.col(c) for c in ("tp", "n", "cum_tp", "cum_n")]).cast("double").alias(name))
