"""Splits in time, time columns and summaries of transaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import quantiles_of

ID, TARGET, TIME = "TransactionID", "isFraud", "TransactionDT"
#: Columns that are never model inputs. Fixed values.
NOT_FEATURES = (ID, TARGET, TIME, "g_component", "uid", "tx_day")


def add_time_features(df: DataFrame, t: str = TIME) -> DataFrame:
    """tx_hour, tx_dayofweek and tx_day of seconds from an unknown origin; floors, so times before it work too."""
    hours, days = F.floor(F.col(t) / 3600), F.floor(F.col(t) / 86400)
    return df.withColumns({"tx_hour": F.pmod(hours, F.lit(24)), "tx_dayofweek": F.pmod(days, F.lit(7)), "tx_day": days})


def feature_columns(df: DataFrame, extra_excluded: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and c not in extra_excluded]


def cutoff(df: DataFrame, quantile: float = 0.8, t: str = TIME) -> float:
    """The exact, linearly interpolated quantile of the times: one number."""
    if not 0 < quantile < 1:
        raise ValueError("the quantile lies between 0 and 1")
    found = quantiles_of(df, t, [quantile])
    if not found:
        raise ValueError("no times to split")
    return found[0]


def temporal_split(df: DataFrame, quantile: float = 0.8, t: str = TIME) -> tuple[DataFrame, DataFrame]:
    """(before, from) the cutoff; both must have rows."""
    at = cutoff(df, quantile, t)
    train, test = df.where(F.col(t) < at), df.where(F.col(t) >= at)
    if train.isEmpty() or test.isEmpty():
        raise ValueError("a side of the split is empty")
    return train, test


def split_summary(df: DataFrame, quantile: float = 0.8, t: str = TIME, target: str = TARGET) -> DataFrame:
    """One row about both sides, in one pass after the cutoff."""
    at = cutoff(df, quantile, t)
    early = F.col(t) < at

    def span(side: Column) -> Column:
        return F.round((F.max(F.when(side, F.col(t))) - F.min(F.when(side, F.col(t)))) / 86400, 4)

    return df.agg(
        F.count_if(early).alias("train_rows"), F.count_if(~early).alias("test_rows"),
        F.round(F.count_if(~early) / F.count("*"), 6).alias("test_fraction"), F.lit(float(at)).alias("boundary"),
        F.round(F.avg(F.when(early, F.col(target))), 6).alias("train_rate"), F.round(F.avg(F.when(~early, F.col(target))), 6).alias("test_rate"),
        span(early).alias("train_span_days"), span(~early).alias("test_span_days"))


def dataset_summary(df: DataFrame, t: str = TIME, target: str = TARGET) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.sum(target).alias("fraud_count"),
        F.round(F.avg(target), 6).alias("fraud_rate"), F.round((F.max(t) - F.min(t)) / 86400, 4).alias("span_days"))


def integrity_check(df: DataFrame, rows: int, rate: float, within: float = 0.001, target: str = TARGET) -> DataFrame:
    """n_rows, fraud_rate and whether both are as expected; ``assert_integrity`` raises on it."""
    return df.agg(F.count("*").alias("n_rows"), F.round(F.avg(target), 6).alias("fraud_rate")).withColumn(
        "ok", (F.col("n_rows") == rows) & (F.abs(F.col("fraud_rate") - rate) <= within))


def assert_integrity(df: DataFrame, rows: int, rate: float, within: float = 0.001) -> DataFrame:
    found = integrity_check(df, rows, rate, within).first()
    if not found["ok"]:
        raise AssertionError(f"expected {rows} rows at a rate of {rate}, found {found['n_rows']} at {found['fraud_rate']}")
    return df
