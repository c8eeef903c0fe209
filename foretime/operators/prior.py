"""Strictly-prior features: nothing a row reads comes from the row itself or later.

Every function takes ``by`` (entity columns), ``order`` (time, then a unique id)
and adds columns. ``task_rows`` overrides the key size above which the chunked
plan is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.operators.ordered import (
    CHUNK, CHUNK_ROWS, POS, attach, carry_into_chunks, chunk_rows, largest_group,
    number_rows, over_limit)

#: Half-lives per block of the exponential mean; 2^512 stays well inside a double.
HALFLIVES_PER_BLOCK = 512

_FRAME_AGGS = {
    "mean": F.avg, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max,
    "std": F.stddev_samp,
}


def prior_window(df: DataFrame, by: Sequence[str], order: Sequence[str],
                 aggs: Mapping[str, tuple[str, str]], rows: int,
                 include_current: bool = False, task_rows: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Aggregates over the last ``rows`` rows before the current one.

    ``aggs`` maps output name to (column, mean|count|sum|min|max|std). A NULL
    occupies a place in the frame but enters no aggregate. ``include_current``
    builds the deliberately leaky form used by negative controls. ``sized`` is a table whose keys
    have the same rows, for a ``df`` that takes long to build.
    """
    lo, hi = (-(rows - 1), 0) if include_current else (-rows, -1)

    def apply(d: DataFrame, keys: Sequence[str], sort: Sequence[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*sort).rowsBetween(lo, hi)
        return d.select("*", *[_FRAME_AGGS[fn](c).over(w).alias(name)
                               for name, (c, fn) in aggs.items()])

    if not over_limit(df if sized is None else sized, by, task_rows):
        return apply(df, by, order)
    size = max(_chunk_size(task_rows), 2 * rows)
    numbered = chunk_rows(df, by, order, size)
    # the last rows of a chunk are read by the next one too
    tail = F.col(POS) % size >= size - rows
    placed = numbered.withColumn("_home", F.col(CHUNK)).withColumn(
        CHUNK, F.explode(F.when(tail, F.array(F.col(CHUNK), F.col(CHUNK) + 1))
                         .otherwise(F.array(CHUNK))))
    out = apply(placed, [*by, CHUNK], [POS])
    return out.where(F.col(CHUNK) == F.col("_home")).drop(CHUNK, POS, "_home")


def prior_running(df: DataFrame, by: Sequence[str], order: Sequence[str],
                  aggs: Mapping[str, tuple[str, str]], include_current: bool = False,
                  task_rows: int | None = None) -> DataFrame:
    """Expanding aggregates (mean|count|sum|min|max) over all earlier rows."""
    end = 0 if include_current else -1

    def frame(keys, sort):
        return W.partitionBy(*keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, end)

    if not over_limit(df, by, task_rows):
        w = frame(by, order)
        return df.select("*", *[_FRAME_AGGS[fn](c).over(w).alias(name)
                                for name, (c, fn) in aggs.items()])

    numbered = chunk_rows(df, by, order, _chunk_size(task_rows))
    totals, carried = {}, {}
    for i, (c, fn) in enumerate(aggs.values()):
        for part in (("sum", "count") if fn == "mean" else (fn,)):
            key = f"_t{i}_{part}"
            totals[key] = _FRAME_AGGS[part](c)
            fold = F.sum if part in ("sum", "count") else _FRAME_AGGS[part]
            carried[key] = lambda w, key=key, fold=fold: fold(key).over(w)
    rows = carry_into_chunks(numbered, by, totals, carried)
    w = frame([*by, CHUNK], [POS])
    out = []
    for i, (name, (c, fn)) in enumerate(aggs.items()):
        def both(part, i=i, c=c):
            old, new = F.col(f"_t{i}_{part}"), _FRAME_AGGS[part](c).over(w)
            if part == "count":
                return F.coalesce(old, F.lit(0)) + new
            if part == "sum":
                return F.when(old.isNull(), new).otherwise(old + F.coalesce(new, F.lit(0)))
            return F.least(old, new) if part == "min" else F.greatest(old, new)
        value = F.try_divide(both("sum"), both("count")) if fn == "mean" else both(fn)
        out.append(value.alias(name))
    return rows.select("*", *out).drop(CHUNK, POS, *totals)


def last_known(df: DataFrame, by: Sequence[str], order: Sequence[str],
               values: Mapping[str, Column | str], include_current: bool = False,
               task_rows: int | None = None) -> DataFrame:
    """Latest non-NULL value of each expression over the earlier rows."""
    end = 0 if include_current else -1
    staged = df.select("*", *[(F.col(v) if isinstance(v, str) else v).alias(f"_v{i}")
                              for i, v in enumerate(values.values())])

    def last(i, keys, sort):
        w = W.partitionBy(*keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, end)
        return F.last(f"_v{i}", ignorenulls=True).over(w)

    scratch = [f"_v{i}" for i in range(len(values))]
    if not over_limit(df, by, task_rows):
        return staged.select("*", *[last(i, by, order).alias(n)
                                    for i, n in enumerate(values)]).drop(*scratch)
    numbered = chunk_rows(staged, by, order, _chunk_size(task_rows))
    totals = {f"_t{i}": F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(POS)))
              for i in range(len(values))}
    carried = {k: (lambda w, k=k: F.last(k, ignorenulls=True).over(w)) for k in totals}
    rows = carry_into_chunks(numbered, by, totals, carried)
    out = rows.select("*", *[F.coalesce(last(i, [*by, CHUNK], [POS]), F.col(f"_t{i}")).alias(n)
                             for i, n in enumerate(values)])
    return out.drop(CHUNK, POS, *scratch, *totals)


def prior_value(df: DataFrame, by: Sequence[str], order: Sequence[str],
                values: Mapping[str, str], task_rows: int | None = None) -> DataFrame:
    """Value of the previous row, NULL included (``lag`` by one)."""
    if not over_limit(df, by, task_rows):
        w = W.partitionBy(*by).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(n) for n, c in values.items()])
    boxed = {f"_b_{n}": F.struct(F.col(c).alias("v")) for n, c in values.items()}
    out = last_known(df, by, order, boxed, task_rows=task_rows)
    return out.select("*", *[F.col(f"_b_{n}.v").alias(n) for n in values]).drop(*boxed)


def next_value(df: DataFrame, by: Sequence[str], order: Sequence[str],
               values: Mapping[str, str], task_rows: int | None = None) -> DataFrame:
    """Value of the following row (``lead`` by one)."""
    if not over_limit(df, by, task_rows):
        w = W.partitionBy(*by).orderBy(*order)
        return df.select("*", *[F.lead(c).over(w).alias(n) for n, c in values.items()])
    numbered = chunk_rows(df, by, order, _chunk_size(task_rows))
    heads = numbered.groupBy(*by, (F.col(CHUNK) - 1).alias(CHUNK)).agg(
        *[F.min_by(F.struct(F.col(c).alias("v")), POS).alias(f"_h{i}")
          for i, c in enumerate(values.values())])
    rows = attach(numbered, heads, [*by, CHUNK])
    w = W.partitionBy(*by, CHUNK).orderBy(POS)
    out = rows.select("*", *[
        F.coalesce(F.lead(F.struct(F.col(c).alias("v"))).over(w), F.col(f"_h{i}"))["v"].alias(n)
        for i, (n, c) in enumerate(values.items())])
    return out.drop(CHUNK, POS, *[f"_h{i}" for i in range(len(values))])


def fill_gaps(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str,
              cross_key_order: Sequence[str] | None = None,
              task_rows: int | None = None) -> DataFrame:
    """Forward then backward fill of ``column`` inside each key.

    With ``cross_key_order`` what is still missing takes the next known value in
    that order over the whole table, whichever key it belongs to; without it
    the back-fill stays inside the key.
    """
    out = last_known(df, by, order, {"_seen": column}, include_current=True, task_rows=task_rows)
    out = out.withColumn(column, F.col("_seen")).drop("_seen")
    keys, sort = (by, order) if cross_key_order is None else ([], cross_key_order)
    back = _backward_rank(out, keys, sort, task_rows)
    back = last_known(back, keys, ["_back"], {"_later": column}, include_current=True,
                      task_rows=task_rows)
    return back.withColumn(column, F.coalesce(F.col(column), F.col("_later"))).drop("_later", "_back")


def _backward_rank(df, by, order, task_rows):
    if over_limit(df, by, task_rows):
        return number_rows(df, by, order).withColumn("_back", -F.col(POS)).drop(POS)
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_back", -F.row_number().over(w))


def prior_ewm(df: DataFrame, by: Sequence[str], order: Sequence[str],
              metrics: Mapping[str, str], halflife: float, include_current: bool = False,
              with_weight: bool = False, task_rows: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Exponentially weighted mean of the earlier rows, weights by row position.

    Row ``i`` weighs ``2^(i/halflife)``; a NULL has no weight but still ages the
    rows before it. Weights are re-based every ``512*halflife`` rows so that they
    never overflow, and a block receives the sums of the last two earlier blocks
    holding a value: anything older is below 2^-512 of what is kept.
    ``with_weight`` adds ``{name}_w``, the summed weight when the row itself weighs one. ``sized`` is as
    in ``prior_window``.
    """
    biggest = largest_group(df if sized is None else sized, by)
    hot = biggest > (CHUNK_ROWS * 4 if task_rows is None else task_rows)
    if hot:
        rows = number_rows(df, by, order)
    else:
        rows = df.withColumn(POS, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    block = int(HALFLIVES_PER_BLOCK * halflife)
    single = biggest <= block
    rows = rows.withColumn("_blk", F.lit(0) if single else F.expr(f"{POS} div {block}"))
    weight = F.pow(F.lit(2.0), (F.col(POS) - F.col("_blk") * block) / F.lit(float(halflife)))
    weigh = {}
    for i, c in enumerate(metrics.values()):
        weigh[f"_w{i}"] = F.when(F.col(c).isNotNull(), weight)
        weigh[f"_x{i}"] = F.col(c) * weight
    rows = rows.withColumns(weigh)
    keys = by if single else [*by, "_blk"]
    w = W.partitionBy(*keys).orderBy(POS).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1)
    if single:
        out = rows.select("*", *[
            F.try_divide(F.sum(f"_x{i}").over(w), F.sum(f"_w{i}").over(w)).alias(n)
            for i, n in enumerate(metrics)], *([
                (F.sum(f"_w{i}").over(w) / weight).alias(f"{n}_w")
                for i, n in enumerate(metrics)] if with_weight else []))
        return out.drop(POS, "_blk", *weigh)

    def decayed(state, column):
        gap = (F.col("_blk") - state["blk"]) * -float(HALFLIVES_PER_BLOCK)
        return state[column] * F.pow(F.lit(2.0), gap)

    blocks = rows.groupBy(*by, "_blk").agg(
        *[F.sum(c).alias(c) for c in weigh])
    own = {f"_s{i}": F.when(F.col(f"_w{i}").isNotNull(), F.struct(
        F.col("_blk").alias("blk"), F.col(f"_x{i}").alias("x"), F.col(f"_w{i}").alias("w")))
        for i in range(len(metrics))}
    blocks = last_known(blocks, by, ["_blk"], {f"_p{i}": s for i, s in enumerate(own.values())},
                        task_rows=task_rows)
    paired = {}
    for i in range(len(metrics)):
        p = F.col(f"_p{i}")
        paired[f"_c{i}"] = F.when(F.col(f"_w{i}").isNotNull(), F.struct(
            F.col("_blk").alias("blk"),
            (F.col(f"_x{i}") + F.coalesce(decayed(p, "x"), F.lit(0.0))).alias("x"),
            (F.col(f"_w{i}") + F.coalesce(decayed(p, "w"), F.lit(0.0))).alias("w")))
    blocks = last_known(blocks, by, ["_blk"], paired, task_rows=task_rows)
    carried = attach(rows, blocks.select(*by, "_blk", *paired), [*by, "_blk"])
    out = []
    for i, n in enumerate(metrics):
        c = F.col(f"_c{i}")
        x_new, w_new = F.sum(f"_x{i}").over(w), F.sum(f"_w{i}").over(w)
        mixed = F.try_divide(x_new + F.coalesce(decayed(c, "x"), F.lit(0.0)),
                             w_new + F.coalesce(decayed(c, "w"), F.lit(0.0)))
        # before a block's first value its mean is the carried one, whatever the scale
        out.append(F.when(w_new.isNull(), F.try_divide(c["x"], c["w"])).otherwise(mixed).alias(n))
        if with_weight:
            held = F.coalesce(w_new, F.when(c.isNotNull(), F.lit(0.0)))
            out.append(((held + F.coalesce(decayed(c, "w"), F.lit(0.0))) / weight).alias(f"{n}_w"))
    return carried.select("*", *out).drop(POS, "_blk", *weigh, *paired)


def _chunk_size(task_rows: int | None) -> int:
    return CHUNK_ROWS if task_rows is None else max(int(task_rows), 1)
