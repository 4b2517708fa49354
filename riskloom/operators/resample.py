"""Resampling and permutation tests, reproducible in any engine.

Row weights are Poisson(1) and orders are random through md5 of the row's id and the
draw's number, so a draw needs no state and no shuffle of rows. This is the Poisson
bootstrap, not a multinomial draw of indexes; ``exact_bootstrap`` does that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import hashes
from ..scratch import Scratch

#: First eight hex digits below which the weight is 0, 1, 2, ... (cumulative Poisson(1)). Fixed values.
POISSON = ("5e2d58d8", "bc5ab1b1", "eb715e1d", "fb239797", "ff1025f5", "ffd90f3b", "fffa8b71")


def poisson(key: Column, draw: Column) -> Column:
    h = F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), draw.cast("string"))), 1, 8)

    def weight(x: Column) -> Column:
        w = F.when(x < POISSON[0], 0)
        for k, below in enumerate(POISSON[1:], 1):
            w = w.when(x < below, k)
        return w.otherwise(7)

    # through an array of one, so that the hash is made once and not for every bound
    return F.get(F.transform(F.array(h), weight), F.lit(0))


BELOW = [np.uint32(int(x, 16)) for x in POISSON]


def weights(keys: list, draws: range):
    """(place of the draw, places of the keys, weights) as poisson() gives them to keys as text, in blocks."""
    known = np.array([i for i, k in enumerate(keys) if k is not None], np.int64)
    for j, at, h in hashes([keys[i].encode() for i in known], [f":{b}".encode() for b in draws]):
        w = np.zeros(len(h), np.uint8)
        for x in BELOW:
            w += h >= x
        yield j, known[at], w
    if len(known) < len(keys):
        lost = np.setdiff1d(np.arange(len(keys)), known)
        for j in range(len(draws)):
            yield j, lost, np.full(len(lost), 7, np.uint8)  # a null hash is below no bound


#: Rows that are weighed at once, rows of a range of scores, and draws of it that are held at once.
HELD, RANGE, AT_ONCE = 65536, 65536, 25
#: Rows whose weights are made or read at once.
BLOCK = 8192


def in_blocks(batches, rows: int = HELD):
    """Batches put together to blocks of about that many rows."""
    held, many = [], 0
    for pdf in batches:
        held.append(pdf)
        many += len(pdf)
        if many >= rows:
            yield pd.concat(held, ignore_index=True)
            held, many = [], 0
    if many:
        yield pd.concat(held, ignore_index=True)


def draw_sums(df: DataFrame, key: str, draws: int, columns: dict[str, Column]) -> DataFrame:
    """(b, n, sums): in each Poisson draw the number of rows and the sum of each column, nulls as 0.

    A task weighs its rows by blocks under all draws and gives one row a draw.
    """
    names = list(columns)
    rows = df.select(F.col(key).cast("string").alias("_k"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in columns.items()])

    def run(batches):
        total = np.zeros((draws, 1 + len(names)))
        for pdf in in_blocks(batches):
            values = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
            for j, at, w in weights(pdf["_k"].tolist(), range(1, draws + 1)):
                total[j] += w @ values[at]
        yield pd.DataFrame({"b": np.arange(1, draws + 1), "n": total[:, 0]} | {c: total[:, i + 1] for i, c in enumerate(names)})

    made = rows.mapInPandas(run, ", ".join(["b int", "n double", *(f"`{c}` double" for c in names)]))
    return made.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def with_weights(df: DataFrame, key: str, draws: int) -> DataFrame:
    """The rows with ``w``: their weights in all Poisson draws, half a byte each. The hashes cost most by far, so each is made once."""
    rows = df.withColumn("_k", F.col(key).cast("string"))

    def run(batches):
        for pdf in in_blocks(batches, BLOCK):
            w = np.zeros((len(pdf), draws + draws % 2), np.uint8)
            for j, at, own in weights(pdf["_k"].tolist(), range(1, draws + 1)):
                w[at, j] = own
            halves = w[:, ::2] | w[:, 1::2] << 4
            yield pdf.drop(columns="_k").assign(w=[x.tobytes() for x in halves])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, w binary")


def unpacked(w: pd.Series, draws: int) -> np.ndarray:
    """(row, draw): the weights again."""
    halves = np.frombuffer(b"".join(w), np.uint8).reshape(len(w), -1)
    return np.stack([halves & 15, halves >> 4], axis=2).reshape(len(w), -1)[:, :draws]


#: Scores, all groups' together, up to which a task adds its rows up by score: it holds two numbers for each in every draw, and so many must save on carrying weights.
CLASSES = 8192


def class_sums(rows: DataFrame, codes: list[str], weighs: list[str], draws: int, classes: int) -> DataFrame:
    """(_g, c, b, tp, n): of each class, in each Poisson draw, the positives and the rows, both by the _g-th of the weighs.

    ``rows``: k, y, the weighs and the ``codes``, which tell the classes a row is in (null: none). A task weighs its rows by blocks and gives one row a class.
    """

    def add(batches):
        total = np.zeros((classes, 2 * len(weighs), draws))
        for pdf in in_blocks(batches):
            w = np.zeros((draws, len(pdf)), np.uint8)
            for j, at, own in weights(pdf["k"].tolist(), range(1, draws + 1)):
                w[j, at] = own
            w = np.ascontiguousarray(w.T)
            y = pdf["y"].to_numpy(float)
            values = np.stack([x for v in weighs for x in (pdf[v].to_numpy(float) * y, pdf[v].to_numpy(float))])
            for code in codes:
                c = pdf[code].to_numpy(float)
                order = np.flatnonzero(~np.isnan(c))
                order = order[np.argsort(c[order], kind="stable")]
                own = c[order].astype(np.int64)
                ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(own) else []
                low = 0
                for high in ends:
                    at = order[low:high]
                    total[own[low]] += values[:, at] @ w[at].astype(float)
                    low = high
        for g in range(len(weighs)):
            yield pd.DataFrame({"_g": g, "c": np.arange(classes), "sums": [x.tobytes() for x in total[:, 2 * g:2 * g + 2]]})

    def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
        told = [(g, c, sum(np.frombuffer(x) for x in own).reshape(2, draws)) for (g, c), own in pdf.groupby(["_g", "c"])["sums"]]
        return pd.concat([pd.DataFrame({"_g": g, "c": c, "b": np.arange(1, draws + 1), "tp": x[0], "n": x[1]}) for g, c, x in told])

    made = rows.select("k", "y", *weighs, *codes).mapInPandas(add, "_g int, c int, sums binary")
    return made.groupBy("_g", F.floor(F.col("c") / 64).alias("some")).applyInPandas(all_of, "_g int, c int, b int, tp double, n double")


def draw_metrics(df: DataFrame, key: str, draws: int, scores: list[str], y: str = "y", weight: str | list[str | None] | None = None, by: tuple[str, ...] = (), size: int = RANGE, classes: int = CLASSES) -> DataFrame:
    """(by, m, b, ap, auc): both metrics of the m-th of the scores in each Poisson draw, for every group; null where the draw does not tell.

    ``weight``: what a row counts for besides, any number from 0 on; rows without one are left
    out. Of a list, each is taken in turn and told as ``_g``, its place, and hashes are made once for all.
    No row is made for a row and a draw. Where scores are few, tasks add their rows up by
    score. Else rows take their weights in all draws along as half a byte each and are dealt by
    ranges of scores, and the ranges' totals in each draw give each range its start.
    """
    names = [f"x{m}" for m in range(len(scores))]
    x = lambda c: F.when(F.isnan(F.col(c).cast("double")), F.lit(float("inf"))).otherwise(F.col(c).cast("double"))  # noqa: E731  # NaN is the highest
    several = isinstance(weight, list)
    weighs = [f"v{i}" for i in range(len(weight) if several else 1)]

    def v(c: str | None) -> Column:
        if c is None:
            return F.lit(1.0)
        told = F.when(F.assert_true(F.coalesce(F.col(c) >= 0, F.lit(True)), "weights may not be negative").isNull(), F.col(c).cast("double"))
        return F.coalesce(told, F.lit(0.0)) if several else told

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(y).cast("double").alias("y"), *[v(c).alias(n) for c, n in zip(weight if several else [weight], weighs)], *by, *[x(c).alias(n) for c, n in zip(scores, names)])
    rows = rows.where("y is not null").where(" and ".join(f"{n} is not null" for n in weighs))
    s = Scratch(df.sparkSession, "draws")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [*by, "m"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(n).alias("x")) for m, n in enumerate(names)])).alias("o")
    seen = s.table(rows.select(*by, each).select(*by, "o.m", "o.x").where("x is not null").groupBy(*group, "x").agg(F.count("*").alias("rows")), "seen")
    found, many = seen.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # spread, as a small table comes in one part
    rows = rows.repartition(tasks, "k")
    told = (["_g"] if several else []) + group
    if found <= classes and 32 * found * tasks * len(weighs) <= many:
        known = s.table(seen.select(*group, "x", (F.row_number().over(Window.orderBy(*group, "x")) - 1).alias("c")), "classes")  # at most ``classes`` rows
        coded = rows
        for m, n in enumerate(names):
            own = known.where(F.col("m") == m).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("x").alias("_x"), F.col("c").alias(f"_c{m}"))
            on = F.col(n) == F.col("_x")
            for c in by:
                on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
            coded = coded.join(F.broadcast(own), on, "left").drop("_x", *[f"_{c}" for c in by])
        per = class_sums(coded, [f"_c{m}" for m in range(len(names))], weighs, draws, found).join(F.broadcast(known), "c")
        above = Window.partitionBy("_g", *group, "b").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
        per = per.select("_g", *group, "b", "tp", "n", F.sum("tp").over(above).alias("ctp"), F.sum("n").over(above).alias("cn"))
        gain, area = F.sum(F.coalesce(F.col("tp") * F.try_divide("ctp", "cn"), F.lit(0.0))), F.sum((F.col("n") - F.col("tp")) * (F.col("ctp") - F.col("tp") / 2))
        return per.groupBy(*dict.fromkeys([*told, "_g"]), "b").agg(F.try_divide(gain, F.sum("tp")).alias("ap"), F.try_divide(area, F.sum("tp") * (F.sum("n") - F.sum("tp"))).alias("auc")).select(*told, "b", "ap", "auc")
    rows = s.table(with_weights(rows, "k", draws), "rows")
    long = rows.select("y", *weighs, "w", *by, each).select("y", *weighs, "w", *by, "o.m", "o.x").where("x is not null")
    ranges = max(tasks, many // size + 1)
    # weights too, so that rows of one score can lie in several ranges
    long = s.table(long.repartitionByRange(ranges, *by, "m", F.desc("x"), F.xxhash64("w", "y")).withColumn("part", F.spark_partition_id()), "ranges")
    kinds = ", ".join(f"`{c}` {long.schema[c].dataType.simpleString()}" for c in group)

    def named(keys: tuple, **made) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(group, keys)) | made)

    def groups(pdf: pd.DataFrame) -> list[tuple[tuple, pd.DataFrame]]:
        """By group; a null one, which pandas reads as NaN, is None again."""
        return [(tuple(None if x != x else x for x in keys), own) for keys, own in pdf.groupby(group, dropna=False)]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for keys, own in groups(pdf):
            hits = own["y"].to_numpy()
            values = np.column_stack([x for v in weighs for x in (own[v].to_numpy() * hits, own[v].to_numpy())])
            sums = np.zeros((values.shape[1], draws))
            for low in range(0, len(own), BLOCK):
                sums += values[low:low + BLOCK].T @ unpacked(own["w"].iloc[low:low + BLOCK], draws).astype(float)
            out += [named(keys, part=int(pdf["part"].iloc[0]), _g=g, b=np.arange(1, draws + 1), tp=sums[2 * g], n=sums[2 * g + 1]) for g in range(len(weighs))]
        return pd.concat(out)

    totals = long.groupBy("part").applyInPandas(total, f"{kinds}, part int, _g int, b int, tp double, n double")
    before = Window.partitionBy("_g", *group, "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select("part", "_g", *group, "b", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("tp", "n")])

    def gains(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        first = {(g, keys): own.sort_values("b") for g, at in start.groupby("_g") for keys, own in groups(at)}
        out = []
        for keys, own in groups(pdf):
            own = own.sort_values("x", ascending=False, kind="stable")
            scores, w = own["x"].to_numpy(), unpacked(own["w"], draws)
            new = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
            values = scores[new]
            # the first and the last score may go on in other ranges
            ends, inner = sorted({0, len(values) - 1}), slice(1, max(1, len(values) - 1))
            b = np.arange(1, draws + 1)
            for g, v in enumerate(own[c].to_numpy() for c in weighs):
                hits, start = v * own["y"].to_numpy(), first[g, keys]
                sums, edges = {c: np.zeros(draws) for c in ("tp", "n", "gain", "area")}, {i: {c: np.zeros(draws) for c in ("ctp", "cn", "tp", "n")} for i in ends}
                for low in range(0, draws, AT_ONCE):
                    some = slice(low, min(low + AT_ONCE, draws))
                    drawn = w[:, some].astype(float)
                    tp, n = np.add.reduceat(drawn * hits[:, None], new, axis=0), np.add.reduceat(drawn * v[:, None], new, axis=0)
                    ctp = start["tp"].to_numpy()[some] + np.cumsum(tp, axis=0)
                    cn = start["n"].to_numpy()[some] + np.cumsum(n, axis=0)
                    gain, area = tp * np.divide(ctp, cn, out=np.zeros_like(cn), where=cn > 0), (n - tp) * (ctp - tp / 2)
                    for c, z in (("tp", tp), ("n", n), ("gain", gain), ("area", area)):
                        sums[c][some] = z[inner].sum(axis=0)
                    for i, at in edges.items():
                        for c, z in (("ctp", ctp), ("cn", cn), ("tp", tp), ("n", n)):
                            at[c][some] = z[i]
                out.append(named(keys, _g=g, b=b, x=np.nan, ctp=0.0, cn=0.0, **sums))
                out += [named(keys, _g=g, b=b, x=values[i], gain=0.0, area=0.0, **at) for i, at in edges.items()]
        return pd.concat(out)

    schema = f"{kinds}, _g int, b int, x double, ctp double, cn double, tp double, n double, gain double, area double"
    per = long.groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(gains, schema)
    per = per.groupBy("_g", *group, "b", "x").agg(F.max("ctp").alias("ctp"), F.max("cn").alias("cn"), *[F.sum(c).alias(c) for c in ("tp", "n", "gain", "area")])
    edge = F.col("x").isNotNull()
    gain = F.sum(F.when(edge, F.coalesce(F.col("tp") * F.try_divide("ctp", "cn"), F.lit(0.0))).otherwise(F.col("gain")))
    area = F.sum(F.when(edge, (F.col("n") - F.col("tp")) * (F.col("ctp") - F.col("tp") / 2)).otherwise(F.col("area")))
    return per.groupBy(*told, "b").agg(F.try_divide(gain, F.sum("tp")).alias("ap"), F.try_divide(area, F.sum("tp") * (F.sum("n") - F.sum("tp"))).alias("auc"))


def draw_aps(df: DataFrame, key: str, draws: int, scores: list[str], y: str = "y", weight: str | list[str | None] | None = None, size: int = RANGE) -> DataFrame:
    """(m, b, ap): average precision of the m-th of the scores in each Poisson draw, null without positives; of a list of weights ``_g`` too."""
    return draw_metrics(df, key, draws, scores, y, weight, size=size).drop("auc")


def delta(aps: DataFrame, variant: int = 1, base: int = 0) -> DataFrame:
    """(b, delta) of draw_aps(); a draw without positives counts as 0."""
    of = lambda m: F.coalesce(F.max(F.when(F.col("m") == m, F.col("ap"))), F.lit(0.0))
    return aps.groupBy("b").agg((of(variant) - of(base)).alias("delta"))


def interval(deltas: DataFrame, comparisons: int = 1) -> DataFrame:
    """Mean delta with a Bonferroni-corrected 95 % interval and a verdict."""
    tail = 0.05 / (2 * comparisons)
    out = deltas.agg(F.count("*").alias("draws"), F.round(F.avg("delta"), 6).alias("delta"), F.round(F.percentile("delta", tail), 6).alias("low"), F.round(F.percentile("delta", 1 - tail), 6).alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0)).withColumn(
        "verdict", F.when(~F.col("significant"), "no significant difference").when(F.col("delta") > 0, "better").otherwise("worse"))


def vdr_delta(df: DataFrame, key: str, draws: int, base_t: float, variant_t: float, y: str = "y", base: str = "s", variant: str = "v", amount: str = "amount_inr", comparisons: int = 1) -> DataFrame:
    """Change in value detection rate from a base to a variant score, each at its fixed threshold."""
    caught = lambda c, t: F.when(F.col(c) >= t, F.col(amount))
    per = draw_sums(df.where(F.col(y) == 1), key, draws, {"all": F.col(amount), "base": caught(base, base_t), "variant": caught(variant, variant_t)}).where("n > 0")
    rate = lambda c: F.coalesce(F.try_divide(c, "all"), F.lit(0.0))
    return interval(per.select("b", (rate("variant") - rate("base")).alias("delta")), comparisons)


def ap_delta(df: DataFrame, key: str, draws: int, y: str = "y", base: str = "s", variant: str = "v", comparisons: int = 1, weight: str | None = None) -> DataFrame:
    """Change in average precision, of rows weighted by ``weight`` if given; a draw without positives, or without any of their weight, counts as 0."""
    return interval(delta(draw_aps(df, key, draws, [base, variant], y, weight)), comparisons)


#: Tasks among which the draws of exact_bootstrap() are dealt, and indexes that are drawn at once.
DEALT, INDEXES = 8, 1 << 16


def exact_bootstrap(df: DataFrame, metric, y: str = "y", base: str = "s", variant: str = "v", draws: int = 400, seed: int = 0, comparisons: int = 1, counted: bool = False) -> DataFrame:
    """The paired multinomial bootstrap of any metric(y, s), with NumPy's generator.

    Equal rows are counted first. The draws are dealt over a few tasks; each holds the
    distinct rows and a number for every row, and passes over the draws of those before it,
    so the draws are those of one generator. ``counted``: the metric is metric(y, s, n) of
    distinct rows and how often each was drawn (never 0), so no sample is written out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "y", "a", "b"])
        task = int(pdf["task"].iloc[0])
        labels, a, b, n = (pdf[c].to_numpy() for c in ("y", "a", "b", "n"))
        place = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rng, deltas = np.random.default_rng(seed), []
        for draw in range((task + 1) * draws // DEALT):
            own, found = draw >= task * draws // DEALT, []
            times = np.zeros(len(n), np.int64)
            for low in range(0, len(place), INDEXES):
                i = rng.integers(0, len(place), min(INDEXES, len(place) - low))
                if own and counted:
                    times += np.bincount(place[i], minlength=len(n))
                elif own:
                    found.append(place[i])
            if not own:
                continue
            i = np.flatnonzero(times) if counted else np.concatenate(found)
            more = (times[i],) if counted else ()
            try:
                deltas.append(metric(labels[i], b[i], *more) - metric(labels[i], a[i], *more))
            except (ValueError, ZeroDivisionError):
                deltas.append(0.0)
        return pd.DataFrame({"delta": np.array(deltas, float)})

    rows = df.select(F.xxhash64(base, variant, y).alias("k"), F.col(y).alias("y"), F.col(base).alias("a"), F.col(variant).alias("b")).groupBy("k", "y", "a", "b").agg(F.count("*").alias("n"))
    # written first, so that every task gets the same table
    rows = Scratch(df.sparkSession, "exact").table(rows, "rows").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    # by range, as hashes of so few numbers meet
    return interval(rows.repartitionByRange(DEALT, "task").groupBy("task").applyInPandas(run, "delta double"), comparisons)


def intervals_of(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, draws, ap_low, ap_high, auc_low, auc_high): 95 % percentile intervals over the draws of draw_metrics(); those of one class alone are skipped."""
    per = metrics.where("ap is not null and auc is not null")
    grouped = per.groupBy(*by) if by else per
    # at most as many values a group as there are draws
    return grouped.agg(F.count("*").alias("draws"), *[F.round(F.percentile(m, q), 6).alias(f"{m}_{n}") for m in ("ap", "auc") for n, q in (("low", 0.025), ("high", 0.975))])


def metric_interval(df: DataFrame, key: str, metric: str, draws: int = 200, by: tuple[str, ...] = (), y: str = "y", s: str = "s") -> DataFrame:
    """(by, draws, low, high) of intervals_of() for "ap" or "auc", from rows."""
    found = intervals_of(draw_metrics(df, key, draws, [s], y, by=by), by)
    return found.select(*by, "draws", F.col(f"{metric}_low").alias("low"), F.col(f"{metric}_high").alias("high"))


#: Leading bits of a hash by which keys are counted in each draw.
DIGITS = 12


def permuted_bits(df: DataFrame, key: str, label: str, draws: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, bits): for each draw the 0/1 labels dealt anew, as many ones as before, on the keys first by md5; 64 draws to a number.

    Tasks count their keys by draw and the first bits of their hash, which tells where a
    draw's ones run out; keys before that are ones. Only the few that share those bits are
    ordered by their whole hash, a draw each. No row is made for a key and a draw.
    """
    s = Scratch(df.sparkSession, "permuted")
    rows = s.table(df.select(key, label, *carry), "rows")
    ones, words = int(rows.agg(F.sum(label)).first()[0] or 0), -(-draws // 64)
    shift = np.uint32(32 - DIGITS)
    told = rows.select(F.col(key).cast("string").alias("_k"))

    def count(batches):
        n = np.zeros((draws, 1 << DIGITS), np.int64)
        for pdf in in_blocks(batches):
            for j, at, h in hashes([x.encode() for x in pdf["_k"]], [f":{b}".encode() for b in range(1, draws + 1)]):
                n[j] += np.bincount(h >> shift, minlength=1 << DIGITS)
        b, p = np.nonzero(n)
        yield pd.DataFrame({"b": b, "p": p, "n": n[b, p]})

    up_to = F.sum("n").over(Window.partitionBy("b").orderBy("p"))  # at most 2^DIGITS rows a draw
    counts = told.where("_k is not null").mapInPandas(count, "b int, p int, n long").groupBy("b", "p").agg(F.sum("n").alias("n")).withColumn("to", up_to)
    edge, left = np.full(draws, 1 << DIGITS), np.zeros(draws, np.int64)
    for r in counts.where(F.col("to") >= ones).groupBy("b").agg(F.min_by(F.struct("p", "to", "n"), "p").alias("e")).select("b", "e.*").collect():  # a row a draw
        edge[r["b"]], left[r["b"]] = r["p"], ones - (r["to"] - r["n"])
    if not ones:
        edge[:] = 0

    def mark(batches):
        for pdf in batches:
            bits, tied = np.zeros((len(pdf), words * 64), np.uint8), [[] for _ in range(len(pdf))]
            known = np.flatnonzero(pdf["_k"].notna())
            for j, at, h in hashes([x.encode() for x in pdf["_k"].iloc[known]], [f":{b}".encode() for b in range(1, draws + 1)]):
                at, p = known[at], (h >> shift).astype(np.int64)
                bits[at[p < edge[j]], j] = 1
                for i in at[(p == edge[j]) & (ones > 0)].tolist():
                    tied[i].append(j + 1)
            out = pdf.drop(columns="_k")
            out["bits"] = list(np.packbits(bits, axis=1, bitorder="little").view(np.int64))
            out["tied"] = tied
            yield out

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *carry))
    marked = s.table(rows.select(key, *carry, F.col(key).cast("string").alias("_k")).mapInPandas(mark, f"{kinds}, bits array<long>, tied array<int>"), "marked")
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("b").cast("string")))
    tied = marked.select(key, F.explode("tied").alias("b")).withColumn("h", h)
    take = F.array(*[F.lit(int(x)) for x in left])
    late = tied.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", key))).where(F.col("r") <= F.get(take, F.col("b") - 1))
    more = late.groupBy(key).agg(F.collect_set("b").alias("more"))
    word = lambda w: F.aggregate(F.filter("more", lambda b: F.floor((b - 1) / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b - 1, F.lit(64)))))
    joined = marked.join(more, key, "left")
    bits = F.array(*[F.get("bits", F.lit(w)).bitwiseOR(F.coalesce(word(w), F.lit(0).cast("long"))) for w in range(words)])
    return joined.select(key, *carry, bits.alias("bits"))


def permuted(df: DataFrame, key: str, label: str, draws: int) -> DataFrame:
    """(b, key, label) of permuted_bits(), a row for a key and a draw."""
    bit = F.call_function("shiftrightunsigned", F.get("bits", F.floor((F.col("b") - 1) / 64).cast("int")), F.pmod(F.col("b") - 1, F.lit(64))).bitwiseAND(F.lit(1).cast("long"))
    return permuted_bits(df, key, label, draws).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("b", key, bit.cast("int").alias(label))


def bit_counts(df: DataFrame, draws: int) -> DataFrame:
    """(b, k): how many rows' ``bits`` have the bit of each draw. A task adds its rows up and gives one row a draw."""

    def run(batches):
        total = np.zeros(draws, np.int64)
        for pdf in in_blocks(batches):
            words = np.ascontiguousarray(np.stack(pdf["bits"].to_numpy()))
            total += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :draws].sum(0, dtype=np.int64)
        yield pd.DataFrame({"b": np.arange(1, draws + 1), "k": total})

    return df.select("bits").mapInPandas(run, "b int, k long").groupBy("b").agg(F.sum("k").alias("k"))


def z_score(observed: Column, mean: Column, sd: Column) -> Column:
    return (observed - mean) / (sd + 1e-9)


def ring_counts(members: DataFrame) -> DataFrame:
    """Components of two or more linked members that are all fraud, mixed or clean. ``members``: component, fraud."""
    per = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("fraud").alias("f")).where("n >= 2")
    return per.agg(F.count("*").alias("components"), F.count_if(F.col("f") == F.col("n")).alias("all_fraud"), F.count_if((F.col("f") > 0) & (F.col("f") < F.col("n"))).alias("mixed"), F.count_if(F.col("f") == 0).alias("clean"))


def ring_test(members: DataFrame, key: str = "uid", draws: int = 200) -> DataFrame:
    """All-fraud components against permuted labels. ``members``: uid, component, fraud of linked entities.

    The draws in which all members of a component are ones are the bits that all of them have.
    """
    seen = ring_counts(members)
    dealt = permuted_bits(members, key, "fraud", draws, ("component",))
    words = range(-(-draws // 64))
    whole = dealt.groupBy("component").agg(F.count("*").alias("n"), *[F.bit_and(F.get("bits", F.lit(w))).alias(f"w{w}") for w in words]).where("n >= 2")
    null = bit_counts(whole.select(F.array(*[f"w{w}" for w in words]).alias("bits")), draws).agg(F.avg("k").alias("m"), F.stddev_pop("k").alias("sd"))
    return seen.crossJoin(null).select("components", "all_fraud", "mixed", "clean", F.round("m", 6).alias("null_mean"), F.round("sd", 6).alias("null_std"), F.round(z_score(F.col("all_fraud"), F.col("m"), F.col("sd")), 4).alias("z"))


def homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of edges with both ends labelled that join two bad ends. ``labels``: node, bad; parallel edges count each."""
    a = labels.withColumnRenamed("node", "src").withColumnRenamed("bad", "x")
    b = labels.withColumnRenamed("node", "dst").withColumnRenamed("bad", "y")
    both = edges.join(a, "src").join(b, "dst")
    return both.agg(F.count("*").alias("edges"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.count("*")).alias("share"))


def homophily_test(edges: DataFrame, labels: DataFrame, draws: int = 200) -> DataFrame:
    """homophily() against permuted labels: in a draw an edge joins two bad ends if both have its bit."""
    seen = homophily(edges, labels)
    dealt = Scratch(edges.sparkSession, "homophily").table(permuted_bits(labels, "node", "bad", draws), "dealt")
    both = edges.join(dealt.select(F.col("node").alias("src"), F.col("bits").alias("x")), "src").join(dealt.select(F.col("node").alias("dst"), F.col("bits").alias("y")), "dst")
    null = bit_counts(both.select(F.zip_with("x", "y", lambda a, b: a.bitwiseAND(b)).alias("bits")), draws)
    null = null.crossJoin(seen.select("edges")).agg(F.avg(F.try_divide("k", "edges")).alias("m"), F.stddev_pop(F.try_divide("k", "edges")).alias("sd"))  # one row
    return seen.crossJoin(null).select("edges", F.round("share", 6).alias("share"), F.round("m", 6).alias("null_mean"), F.round("sd", 6).alias("null_std"), F.round(z_score(F.col("share"), F.col("m"), F.col("sd")), 4).alias("z"))
