"""Model metrics and paired comparisons as distributed aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions import market as m, stats
from foretime.operators.prior import prior_running
from foretime.operators.scorecard import with_wilson


def unpivot_models(wide: DataFrame, models: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per (row, model) with ``p``; NULL probabilities drop out."""
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p"))
                     for name, c in models.items()])
    return wide.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*").where("p IS NOT NULL")


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    hit = ((F.col(p) > 0.5).cast("int") == F.col(y)).cast("int")
    return [F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("k"),
            F.avg(m.log_loss(y, p)).alias("log_loss"), F.avg(m.brier(y, p)).alias("brier")]


def roc_auc(long: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p",
            task_rows: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are first counted per distinct score, so the ordered step runs over
    scores and not over rows.
    """
    keys = list(keys)
    per_score = long.groupBy(*keys, p).agg(
        F.sum(y).cast("double").alias("_ones"), F.sum(1 - F.col(y)).cast("double").alias("_zeros"))
    run = prior_running(per_score, keys, [p], {"_below": ("_zeros", "sum")}, task_rows=task_rows)
    return run.groupBy(*keys).agg(F.try_divide(
        F.sum(F.col("_ones") * (F.coalesce("_below", F.lit(0.0)) + F.col("_zeros") / 2)),
        F.sum("_ones") * F.sum("_zeros")).alias("auc"))


def model_metrics(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy with its interval, log loss, Brier score and AUC per key."""
    d = with_wilson(long.groupBy(*keys).agg(*metric_columns()), "k", "n")
    return d.join(roc_auc(long, keys), list(keys))


def evaluation_block(long: DataFrame) -> DataFrame:
    """Per model and season and pooled, in one pass over grouping sets."""
    d = long.rollup("model", "season").agg(F.grouping_id().alias("_g"), *metric_columns())
    d = d.where("_g < 3").select(
        "model", F.coalesce(F.col("season").cast("string"), F.lit("pooled")).alias("block"),
        "n", "k", "log_loss", "brier")
    return with_wilson(d, "k", "n")


def discordant(long: DataFrame, key: str = "game_id", by: Sequence[str] = ()) -> DataFrame:
    """All model pairs with counts of rows only one of them got right, and the exact p.

    Models of one event meet inside one array of at most as many entries as
    there are models, so nothing is paired across events.
    """
    by = list(by)
    hit = (F.col("p") > 0.5).cast("int") == F.col("y")
    per = long.groupBy(key, *by).agg(F.sort_array(F.collect_set(
        F.struct("model", hit.alias("hit")))).alias("ms"))
    pairs = F.flatten(F.transform("ms", lambda a: F.transform(
        F.filter("ms", lambda b: b["model"] > a["model"]),
        lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"),
                           a["hit"].alias("ha"), b["hit"].alias("hb")))))
    d = per.select(*by, F.explode(pairs).alias("x")).groupBy(
        *by, F.col("x.model_a").alias("model_a"), F.col("x.model_b").alias("model_b")).agg(
        F.count_if(F.col("x.ha") & ~F.col("x.hb")).alias("only_a"),
        F.count_if(~F.col("x.ha") & F.col("x.hb")).alias("only_b"))
    return d.withColumn("p", stats.sign_test_two_sided("only_a", F.col("only_a") + F.col("only_b")))


def agreement(long: DataFrame, favourite: str = "vegas_fav") -> DataFrame:
    """Model against the market favourite: accuracy where they agree, exact test where not."""
    d = long.where(F.col(favourite) != "unresolved")
    fav_home = F.col(favourite) == "home"
    model_home = F.col("p") > 0.5
    same, right = model_home == fav_home, model_home == (F.col("y") == 1)
    d = d.groupBy("model").agg(
        F.count_if(same).alias("agree_n"), F.avg(F.when(same, right.cast("double"))).alias("agree_acc"),
        F.count_if(~same).alias("disagree_n"), F.count_if(~same & right).alias("model_right"),
        F.count_if(~same & ~right).alias("vegas_right"),
        F.count_if(~same & model_home).alias("picked_home"))
    d = with_wilson(d, "model_right", "disagree_n", "disagree_acc")
    return d.withColumn("p", F.when(F.col("disagree_n") > 0,
                                    stats.sign_test_two_sided("model_right", "disagree_n")))


def reliability(long: DataFrame, keys: Sequence[str] = ("model",), bins: int = 10) -> DataFrame:
    """Equal-width probability bins with mean prediction and observed rate; empty bins stay."""
    keys = list(keys)
    index = F.lit(0)
    for i in range(1, bins):
        index = index + (F.col("p") >= F.lit(i * (1.0 / bins))).cast("int")
    d = long.withColumn("bin", index).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("observed"))
    seen = long.select(*keys, F.lit(0).alias("_one")).distinct()
    grid = seen.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(d, [*keys, "bin"], "left").fillna(0, ["n"])


def exact_quantiles(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = (),
                    task_rows: int | None = None) -> DataFrame:
    """Interpolated quantiles of a column per key.

    Distinct values are counted first and ranked by running sums, which the
    ordered operators cut into chunks when one key holds too many, so no task
    collects a key's values.
    """
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), column, points, ["_all"],
                               task_rows).drop("_all")
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranked = prior_running(counts, by, [column], {"_before": ("_c", "sum")}, task_rows=task_rows)
    ranked = ranked.withColumn("_before", F.coalesce("_before", F.lit(0)))
    joined = ranked.join(totals, by)
    out = []
    for q in points:
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_c"))
        lo, hi = F.max(F.when(holds(low), F.col(column))), F.max(F.when(holds(high), F.col(column)))
        frac = F.max(at - low)
        out.append((lo + (hi - lo) * frac).alias(f"q{round(q * 100):02d}"))
    return joined.groupBy(*by).agg(*out)


def summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles."""
    if not by:
        return summary(df.withColumn("_all", F.lit(0)), column, ["_all"]).drop("_all")
    by = list(by)
    base = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"))
    q = exact_quantiles(df, column, (0.25, 0.5, 0.75), by)
    return base.join(q, by, "left")


class CoMoments:
    """Pairwise-complete co-moments of some columns with some others: counts, means of each side over the
    rows that have both, and centred sums of squares and products. Two of them merge exactly."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        mx, my = (~np.isnan(v) for v in (x, y))
        wx, wy = mx.astype(np.float64), my.astype(np.float64)
        # shifted to the columns' own means, so that little is lost when products are centred
        cx, cy = (np.where(m.any(axis=0), np.nansum(v, axis=0) / np.maximum(m.sum(axis=0), 1), 0.0) for v, m in ((x, mx), (y, my)))
        x, y = np.where(mx, x - cx, 0.0), np.where(my, y - cy, 0.0)
        self.n = wx.T @ wy
        d = np.maximum(self.n, 1.0)
        sx, sy = x.T @ wy, wx.T @ y
        self.ax, self.ay = cx[:, None] + sx / d, cy[None, :] + sy / d
        self.vx, self.vy = (x * x).T @ wy - sx * sx / d, wx.T @ (y * y) - sy * sy / d
        self.c = x.T @ y - sx * sy / d

    PARTS = ("n", "ax", "ay", "vx", "vy", "c")

    def to_bytes(self) -> bytes:
        return np.stack([getattr(self, p) for p in self.PARTS]).tobytes()

    @classmethod
    def from_bytes(cls, data, shape: tuple[int, int]) -> "CoMoments":
        out = cls.__new__(cls)
        for p, v in zip(cls.PARTS, np.frombuffer(data).reshape(len(cls.PARTS), *shape), strict=True):
            setattr(out, p, v.copy())
        return out

    def merge(self, o: "CoMoments") -> "CoMoments":
        n = self.n + o.n
        d = np.maximum(n, 1.0)
        dx, dy, w = o.ax - self.ax, o.ay - self.ay, self.n * o.n / d
        self.vx, self.vy, self.c = self.vx + o.vx + dx * dx * w, self.vy + o.vy + dy * dy * w, self.c + o.c + dx * dy * w
        self.ax, self.ay, self.n = self.ax + dx * o.n / d, self.ay + dy * o.n / d, n
        return self

    def correlation(self) -> np.ndarray:
        """NaN where fewer than two rows have both columns, or one of them doesn't vary there."""
        with np.errstate(invalid="ignore", divide="ignore"):
            flat = (self.vx <= 1e-24 * (1 + self.ax ** 2) * self.n) | (self.vy <= 1e-24 * (1 + self.ay ** 2) * self.n)
            return np.where((self.n < 2) | flat, np.nan, np.clip(self.c / np.sqrt(self.vx * self.vy), -1.0, 1.0))


#: Columns of one side of a block of the matrix.
BLOCK_COLUMNS = 128


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r): Pearson correlation of every column pair over the ``n`` rows that have both.

    One pass: a task turns its rows into co-moments by matrix products, block of columns by block,
    and blocks are merged by a grouped aggregate whose size is that of the matrix, not of the table.
    """
    columns = list(columns)
    starts = range(0, len(columns), BLOCK_COLUMNS)
    width = lambda i: min(BLOCK_COLUMNS, len(columns) - i)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], CoMoments] = {}
        for b in batches:
            m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(columns))
            for i in starts:
                for j in starts:
                    if i <= j and len(m):
                        part = CoMoments(m[:, i:i + width(i)], m[:, j:j + width(j)])
                        held[i, j] = held[i, j].merge(part) if (i, j) in held else part
        for (i, j), part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([part.to_bytes()], pa.binary())], names=["i", "j", "part"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        total = None
        for b in batches:
            for data in b.column("part"):
                part = CoMoments.from_bytes(data.as_buffer(), (width(i), width(j)))
                total = part if total is None else total.merge(part)
        r, at = total.correlation(), [(x, y) for x in range(width(i)) for y in range(width(j)) if i + x < j + y]
        yield pa.RecordBatch.from_pydict({
            "a": [columns[i + x] for x, _ in at], "b": [columns[j + y] for _, y in at],
            "n": pa.array([int(total.n[p]) for p in at], pa.int64()), "r": pa.array([None if np.isnan(r[p]) else float(r[p]) for p in at], pa.float64())})

    return rows.mapInArrow(partial, "i long, j long, part binary").groupBy("i", "j").applyInArrow(merged, "a string, b string, n long, r double")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of ``correlation_matrix``."""
    return correlation_matrix(df, columns).select("a", "b", "r")


def null_shares(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def home_advantage(games: DataFrame) -> DataFrame:
    """Rating-point offset of the home win rate on the log-odds scale."""
    d = games.agg(F.count("home_win").alias("n"), F.avg("home_win").alias("p"))
    return d.withColumn("advantage", F.log10(F.col("p") / (1 - F.col("p"))) * 400.0)
