"""Mixing sources to target weights by Pareto order sampling, in SQL functions only.

A source's target in words becomes an expected number of copies per document. Its
whole part is allocated for certain; the fraction p is an inclusion probability,
and documents are ranked by (u / (1 - u)) / (p / (1 - p)) with a u hashed from the
document. The lowest ranks are taken until the source's remaining words are met.

The cut needs no sort of a source: two histograms of the rank, each a grouped sum,
close in on the bin that holds it, and only that bin's rows are ordered.

Cases: a null text has size 0 and is taken 0 words; null sources form one source,
ordered last; a source without words has target 0; equal rows may each be chosen
and their order does not change the set of result rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.llm.common import SPACED_WORD_SQL, same_type, stored, text_key, with_text

#: Bits of the rank's place, and of each of the two histograms.
PLACE_BITS, BIN_BITS = 44, 12


def source_targets(sizes: DataFrame, source: str, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: words, weight and target.

    Targets are ``share`` of all words dealt by weight; none is above ``most`` times
    its source, and what that cuts off goes to the others by weight: the level t with
    sum(min(most * words, t * weight)) = share * all. The windows without a key run on
    one row per source.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    per = per.select(source, "source_size", "source_rows", weight.alias("weight"),
                     (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    rise = W.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before, rest = rise.rowsBetween(W.unboundedPreceding, -1), rise.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = ((F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
              - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", level)
    # the first source, by rising cap over weight, that stays below its cap sets the level
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("r"), F.col("level")))).over(W.partitionBy())["level"]
    return per.select(source, "source_size", "source_rows", "weight", F.coalesce(
        F.least("cap", found * F.col("weight")), F.col("cap")).alias("target"))


def same_source(a: DataFrame, b: DataFrame, source: str) -> Column:
    return a[source].eqNullSafe(b[source])


def uniform(doc_id: str, tie: Column, seed: int) -> Column:
    """52 hashed bits of a document as a number inside (0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id).cast("string"), tie).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
        seed: int = 1) -> DataFrame:
    """(id, source, text key, size, source_size, target, copies, taken), one row per document."""
    docs = with_text(docs, text)
    kind = same_type(docs, doc_id)
    sizes = stored(docs.select(
        F.col(doc_id).cast(kind).alias("_id"), F.col(source).cast("string").alias("_source"), text_key(text).alias("_text"),
        F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD_SQL)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    targets = source_targets(sizes, "_source", weights, share, most)
    targets = stored(targets, "mix-targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    certain = F.when(each >= most, F.lit(float(most))).otherwise(F.floor(each))
    per = targets.select(F.col("_source").alias("_s"), "source_size", "target", certain.cast("long").alias("certain"),
                         (each - certain).alias("p"), (F.col("target") - certain * F.col("source_size")).alias("rest"))
    u = uniform("_id", F.when(F.col("_id").isNull(), F.col("_text").cast("string")), seed)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = sizes.join(per, sizes["_source"].eqNullSafe(per["_s"])).drop("_s").withColumn("u", u)
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    # rank / (1 + rank) keeps the order and lies inside (0, 1)
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(float(2 ** PLACE_BITS))).cast("long")
    ranked = ranked.withColumn("place", place)
    coarse = F.shiftright("place", PLACE_BITS - BIN_BITS)
    fine = F.shiftright("place", PLACE_BITS - 2 * BIN_BITS)
    cut = _cut_bin(ranked.where("place is not null").select("_source", "size", "rest", F.lit(0).cast("double").alias("base"), coarse.alias("bin")))
    at = cut.select(F.col("_source").alias("_s"), F.col("bin").alias("bin1"), F.col("base").alias("base1"))
    inside = ranked.where("place is not null").join(at, F.col("_source").eqNullSafe(F.col("_s"))).where(coarse == F.col("bin1"))
    cut2 = _cut_bin(inside.select("_source", "size", "rest", F.col("base1").alias("base"), fine.alias("bin")))
    at2 = stored(cut2.select(F.col("_source").alias("_s"), F.col("bin").alias("bin2"), F.col("base").alias("base2")), "mix-cuts")
    ranked = ranked.join(at2, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ranked = ranked.withColumn("side", F.when(F.col("place").isNull(), 1).when(F.col("bin2").isNull(), 0)
                               .otherwise(F.signum(fine - F.col("bin2")).cast("int")))
    out = ["_id", "_source", "_text", "size", "source_size", "target", "certain"]
    plain = ranked.where("side <> 0 or bin2 is null").select(*out, F.when(F.col("side") <= 0, 1).otherwise(0).alias("drawn"))
    # only the rows of the bin that holds the cut are ordered
    order = W.partitionBy("_source").orderBy("rank", "_id", "_text").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = ranked.where("side = 0 and bin2 is not null").withColumn("upto", F.col("base2") + F.sum("size").over(order))
    last = last.select(*out, F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0).alias("drawn"))
    both = plain.unionByName(last).withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + F.col("drawn")).otherwise(0))
    return both.select(F.col("_id").alias(doc_id), F.col("_source").alias(source), F.col("_text").alias("text_key"),
                       "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _cut_bin(rows: DataFrame) -> DataFrame:
    """Per source the bin in which the running sum passes ``rest``, and the sum before it."""
    bins = rows.groupBy("_source", "bin").agg(F.sum("size").alias("n"), F.max("rest").alias("rest"), F.max("base").alias("base"))
    run = W.partitionBy("_source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("upto", F.col("base") + F.sum("n").over(run))
    return (bins.where(F.col("upto") > F.col("rest")).groupBy("_source")
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("m"))
            .select("_source", F.col("m.bin").alias("bin"), F.col("m.before").alias("base")))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    taken = mix(docs, doc_id, text, source, **how).where("copies > 0")
    # equal rows may be drawn differently: deal their copies to them one by one
    times = taken.groupBy(F.col(doc_id).alias("__mix_i"), F.col(source).alias("__mix_s"), F.col("text_key").alias("__mix_t")).agg(
        F.sum("copies").alias("__mix_n"))
    one = docs.withColumn("__mix_key", text_key(text))
    firsts = one.join(times, one[doc_id].eqNullSafe(F.col("__mix_i")) & one[source].cast("string").eqNullSafe(F.col("__mix_s"))
                      & (one["__mix_key"] == F.col("__mix_t"))).drop("__mix_i", "__mix_s", "__mix_t")
    firsts = firsts.dropDuplicates([doc_id, source, "__mix_key"])
    return firsts.withColumn("__mix_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n")))).select(*docs.columns)
