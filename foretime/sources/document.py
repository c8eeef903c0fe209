"""Export documents: nested JSON with rounded leaves, fixed order, bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.operators.audit import positions
from foretime.operators.ordered import POS


def rounded_struct(df: DataFrame, columns: Sequence[str], digits: int = 4) -> Column:
    """Struct with sorted fields, doubles rounded; NULL fields stay in the JSON."""
    types = dict(df.dtypes)
    return F.struct(*[(F.round(c, digits) if types[c] == "double" else F.col(c)).alias(c) for c in sorted(columns)])


def export_pages(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str],
                 page_rows: int = 1000, digits: int = 4) -> DataFrame:
    """One JSON document per page of at most ``page_rows`` rows of a key, rows in a fixed order.

    Paging keeps a document bounded however many rows its key has.
    """
    by = list(by)
    d = positions(df, by, order).withColumn("page", F.expr(f"{POS} div {int(page_rows)}"))
    item = F.struct(F.col(POS), rounded_struct(df, columns, digits).alias("row"))
    d = d.groupBy(*by, "page").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    doc = F.struct(F.transform("items", lambda x: x["row"]).alias("games"), F.col("page"), *[F.col(b) for b in by])
    return d.select(*by, "page", "n", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def leaves(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    """``fields`` by name, doubles rounded; NaN is missing."""
    types = dict(df.dtypes)
    cut = lambda c: F.round(F.when(~F.isnan(F.col(c)), F.col(c)), 4).alias(c)
    return [cut(c) if types[c] == "double" else F.col(c) for c in sorted(fields)]


def nested_documents(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str,
                     children: DataFrame, on: str, child_order: Sequence[str], child_fields: Sequence[str], child_name: str) -> DataFrame:
    """``keys`` and ``document``: one JSON text per key, with its rows in order and, inside each, its children in
    theirs. Names are sorted at every level and missing values, also whole lists, are left out, so equal
    content gives equal text. A document holds one key's rows: choose keys that bound it.
    """
    lists = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(child_order)], F.struct(*leaves(children, child_fields)).alias("_v")))).alias("_l"))
    lists = lists.select(on, F.transform("_l", lambda x: x["_v"]).alias(child_name))
    whole = rows.join(lists, on, "left")
    row = F.struct(*leaves(whole, [*fields, child_name]))
    d = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], row.alias("_v")))).alias("_l"))
    top = {**{k: F.col(k) for k in keys}, name: F.transform("_l", lambda x: x["_v"])}
    return d.select(*keys, F.to_json(F.struct(*[top[k].alias(k) for k in sorted(top)])).alias("document"))
