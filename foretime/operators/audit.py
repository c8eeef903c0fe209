"""Leakage audits and table comparisons. Each returns rows to look at, never a log line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.operators.checks import matched_or_refuse
from foretime.operators.ordered import POS, attach, number_rows, over_limit
from foretime.operators.prior import prior_running, prior_value

RTOL, ATOL = 1e-6, 1e-9


def close(a: Column, b: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Both missing, or within atol + rtol * |b|."""
    return F.when(a.isNull() & b.isNull(), True).otherwise(
        F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False)))


def newest_inputs(log: DataFrame, entity: str, period: str, time: str, id: str) -> DataFrame:
    """Per row the newest time any windowed input (``prev_time``) or earlier-period input
    (``prior_period_time``) can have."""
    rows = prior_value(log.select(entity, period, time, id), [entity], [time, id], {"prev_time": time})
    last = log.groupBy(entity, period).agg(F.max(time).alias("_last"))
    last = prior_running(last, [entity], [period], {"prior_period_time": ("_last", "max")}).drop("_last")
    return rows.join(last, [entity, period], "left")


def time_violations(inputs: DataFrame, time: str) -> DataFrame:
    """Rows with an input that is not strictly earlier than the row itself."""
    late = lambda c: F.coalesce(F.col(c) >= F.col(time), F.lit(False))
    return inputs.where(late("prev_time") | late("prior_period_time"))


def time_summary(inputs: DataFrame, time: str) -> DataFrame:
    late = lambda c: F.coalesce(F.col(c) >= F.col(time), F.lit(False))
    lag = (F.unix_micros(time) - F.unix_micros("prev_time")) / 86_400e6
    return inputs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(late("prev_time") | late("prior_period_time")).alias("violations"),
        F.min(lag).alias("min_lag_days"))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    if over_limit(df, by, None):
        return number_rows(df, by, order)
    return df.withColumn(POS, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def window_oracle(log: DataFrame, by: Sequence[str], order: Sequence[str],
                  metrics: Sequence[str], rows: int) -> DataFrame:
    """Mean over the ``rows`` rows before each one, by another route than a sliding frame.

    Running sums and counts up to a row, less those up to the row ``rows`` places before: what
    is left is the window. All metrics share the one shuffle that the running sums need.
    """
    by, order = list(by), list(order)
    prefix = {x: y for i, m in enumerate(metrics) for x, y in ((f"_s{i}", (m, "sum")), (f"_c{i}", (m, "count")))}
    log = log.select(*dict.fromkeys([*by, *order, *metrics]))
    if over_limit(log, by, None):
        run = prior_running(number_rows(log, by, order), by, [POS], prefix)
        earlier = run.select(*by, (F.col(POS) + rows).alias(POS), *[F.col(c).alias(f"{c}_e") for c in prefix])
        run = attach(run, earlier, [*by, POS])
    else:
        w = W.partitionBy(*by).orderBy(*order)
        run = prior_running(log, by, order, prefix)
        run = run.select("*", *[F.lag(c, rows).over(w).alias(f"{c}_e") for c in prefix])
    left = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"{c}_e"), F.lit(0))
    return run.select(*by, *order, *[
        F.when(left(f"_c{i}") > 0, left(f"_s{i}") / left(f"_c{i}")).alias(f"{m}_oracle") for i, m in enumerate(metrics)])


def mismatches(features: DataFrame, oracle: DataFrame, keys: Sequence[str],
               pairs: Mapping[str, str], rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """Per feature: rows compared and rows that differ from the oracle column."""
    d = features.select(*keys, *pairs).join(
        oracle.select(*keys, *[F.col(v).alias(f"_o{i}") for i, v in enumerate(pairs.values())]), list(keys))
    row = d.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(~close(F.col(c), F.col(f"_o{i}"), rtol, atol)).alias(f"b{i}") for i, c in enumerate(pairs)])
    cells = [F.struct(F.lit(c).alias("feature"), F.col("n"), F.col(f"b{i}").alias("mismatches"))
             for i, c in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def ewm_induction(df: DataFrame, by: Sequence[str], order: Sequence[str], metric: str,
                  mean: str, weight: str, halflife: float) -> DataFrame:
    """Rows where the exponential mean does not follow from the row before.

    A first row must know nothing. Every later one must hold
    ``w' = d (w + [x known])`` and ``m' w' = d (m w + x)`` with ``d = 2^(-1/halflife)``.
    If no row fails, every value is right by induction, and no row was used early.
    """
    prev = prior_value(df.withColumn("_has", F.lit(1)), by, order, {
        "_x": metric, "_m": mean, "_w": weight, "_seen": "_has"})
    d = 2.0 ** (-1.0 / halflife)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    want_w = (zero(F.col("_w")) + F.col("_x").isNotNull().cast("double")) * d
    want_mw = (zero(F.col("_m")) * zero(F.col("_w")) + zero(F.col("_x"))) * d
    got_w = zero(F.col(weight))
    sound = F.when(F.col("_seen").isNull(), F.col(mean).isNull() & (got_w == 0.0)).otherwise(
        close(got_w, want_w) & close(zero(F.col(mean)) * got_w, want_mw, RTOL, 1e-9))
    return prev.where(~sound).drop("_x", "_m", "_w", "_seen", "_has")


def tripwire(df: DataFrame, pairs: Mapping[str, str], limit: float = 0.95) -> DataFrame:
    """Correlation of each feature with the row's own raw value, and whether it trips."""
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs.items())])
    cells = [F.struct(F.lit(a).alias("feature"), F.col(f"c{i}").alias("r"))
             for i, a in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select(
        "x.*", F.coalesce(F.abs("x.r") > limit, F.lit(False)).alias("trips"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.*")


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
               rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """Per shared column: rows compared, mismatches, largest numeric gap; also rows on one side.

    One full join and one aggregate, whatever the number of columns. ``by``
    splits the report (it must be among the keys).
    """
    keys, by = list(keys), list(by)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    number = {c for c, t in left.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    side = lambda df, s: df.select(
        *[F.col(k).alias(f"_{s}k{i}") for i, k in enumerate(keys)],
        *[F.col(c).alias(f"_{s}{i}") for i, c in enumerate(shared)], F.lit(1).alias(f"_in_{s}"))
    match = reduce(lambda a, b: a & b, [
        F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}")) for i in range(len(keys))])
    d = side(left, "l").join(side(right, "r"), match, "full").withColumns({
        k: F.coalesce(f"_lk{keys.index(k)}", f"_rk{keys.index(k)}") for k in by} if by else {"_all": F.lit(0)})
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    aggs = [F.count_if(both).alias("_n"), F.count_if(F.col("_in_r").isNull()).alias("_ol"),
            F.count_if(F.col("_in_l").isNull()).alias("_or")]
    for i, c in enumerate(shared):
        a, b = F.col(f"_l{i}"), F.col(f"_r{i}")
        same = close(a, b, rtol, atol) if (rtol or atol) and c in number else a.eqNullSafe(b)
        aggs.append(F.count_if(both & ~same).alias(f"_m{i}"))
        aggs.append((F.max(F.when(both, F.abs(a.cast("double") - b.cast("double")))) if c in number
                     else F.lit(None).cast("double")).alias(f"_g{i}"))
    row = d.groupBy(*by).agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col("_n").alias("compared"), F.col(f"_m{i}").alias("mismatches"),
                      F.col(f"_g{i}").alias("max_abs_diff"), F.col("_ol").alias("only_left"),
                      F.col("_or").alias("only_right")) for i, c in enumerate(shared)]
    return row.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")


def schema_diff(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """Columns whose presence or type differs."""
    l, r = dict(left.dtypes), dict(right.dtypes)
    return [(c, l.get(c), r.get(c)) for c in sorted({*l, *r}) if l.get(c) != r.get(c)]


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and two order-insensitive digests of a table's content."""
    cols = sorted(columns or df.columns)
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"),
        F.bit_xor("h").alias("xor"))


def long_metrics(df: DataFrame, block: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(block, metric, value) rows of a report, for reconciliation."""
    name = F.concat_ws("/", *[F.coalesce(F.col(b).cast("string"), F.lit("-")) for b in block])
    cells = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    return df.select(name.alias("block"), F.explode(F.array(*cells)).alias("x")).select("block", "x.*")


def reconcile(mine: DataFrame, recorded: DataFrame, digits: int = 4) -> DataFrame:
    """Every (block, metric) whose rounded values differ or that one side lacks."""
    d = mine.join(recorded.withColumnRenamed("value", "recorded"), ["block", "metric"], "full")
    same = F.round("value", digits).eqNullSafe(F.round("recorded", digits))
    return d.where(~same)


def parts_add_up(report: DataFrame, label: str, whole: str, values: Sequence[str],
                 tolerance: float = 1e-9, rtol: float = 1e-12) -> DataFrame:
    """Values whose parts do not sum to the row called ``whole``; one of the two missing counts.

    Whole numbers must agree exactly. Doubles round with the size of what was added up: they may differ
    by ``rtol`` of the largest value in the row called ``whole``.
    """
    types = dict(report.dtypes)
    row = report.agg(*[x for i, v in enumerate(values) for x in (
        F.sum(F.when(F.col(label) == whole, F.col(v))).alias(f"w{i}"),
        F.sum(F.when(F.col(label) != whole, F.col(v))).alias(f"p{i}"))])
    scale = F.array_max(F.array(F.lit(0.0), *[F.abs(F.col(f"w{i}").cast("double")) for i in range(len(values))]))
    agree = [F.abs(F.col(f"w{i}") - F.col(f"p{i}")) <= (tolerance + scale * rtol if types[v] in ("double", "float") else F.lit(0))
             for i, v in enumerate(values)]
    cells = [F.struct(F.lit(v).alias("metric"), F.col(f"w{i}").cast("double").alias("whole"),
                      F.col(f"p{i}").cast("double").alias("parts"), agree[i].alias("same")) for i, v in enumerate(values)]
    both_missing = F.col("whole").isNull() & F.col("parts").isNull()
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(
        ~F.coalesce("same", both_missing)).drop("same")


def rule_violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule and row; a rule that is NULL counts as broken."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def exceptions_drift(found: DataFrame, documented: DataFrame, keys: Sequence[str],
                     counts: Sequence[str]) -> DataFrame:
    """Documented exceptions must match exactly, integer by integer; anything else is listed."""
    return matched_or_refuse(found, documented, keys, counts)


def gate(checks: DataFrame) -> DataFrame:
    """One decision from (check, passed) rows: save only when all passed."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("save"),
                      F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failed"))


def control_gate(results: DataFrame, clean: str = "clean") -> DataFrame:
    """Negative control: one clean build that passes, at least one leaky one, and every leaky one fails."""
    own = F.col("variant") == clean
    ok = F.coalesce(F.when(own, F.col("passed")).otherwise(~F.col("passed")), F.lit(False))
    complete = (F.count_if(own) == 1) & (F.count(F.lit(1)) > 1)
    return results.agg((F.coalesce(F.bool_and(ok), F.lit(False)) & complete).alias("sound"), F.count(F.lit(1)).alias("variants"),
                       F.count_if(F.col("variant") == clean).alias("clean_variants"))


def largest_change(before: DataFrame, after: DataFrame, keys: Sequence[str], period: str,
                   columns: Sequence[str]) -> DataFrame:
    """Per period the largest absolute change between two builds, for perturbation tests."""
    d = table_diff(before, after, [period, *keys], by=[period])
    return d.where(F.col("column").isin(list(columns))).groupBy(period).agg(
        F.max("max_abs_diff").alias("max_change"), F.sum("mismatches").alias("changed"))
