"""Mixing sources to target weights by weighted sampling without replacement.

Every source has a target in words. A source gives as many complete passes over
its documents as fit into the target, then a fraction of one more pass: its
documents in the order of Efraimidis-Spirakis keys, -ln(u) / weight, up to the
rest. u comes from a digest of the id, so that runs agree; weight is a measure
of the document's quality. Whole documents are taken; the one that crosses the
target is taken if that ends nearer to it.

No source is ever sorted in one place. Keys fall into bins, bins are summed
before they are shuffled, and only the bin in which a source's target ends is
sorted; what comes of it is one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import fits_broadcast
from ..session import checkpoint
from .common import WORD, clear_of

WEIGHTS = (5, 2, 1)
#: a source is passed at most this many times
MOST_PASSES = 3
BINS = 1 << 12
#: rows of a source are dealt over so many tasks where its plan is joined by a shuffle
SALTS = 64
SEED = "mix"
# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: a document gets no less than this quality weight
LEAST_WEIGHT = 0.1


def size_of(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """From 1 down to LEAST_WEIGHT as the share of symbols grows to a quarter; LEAST_WEIGHT for NULL or empty."""
    n = F.length(text).cast("double")
    share = F.when(n > 0, F.regexp_count(text, F.lit(f"[{SYMBOLS}]")) / n)
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.lit(1.0) - F.lit(4.0) * share, F.lit(LEAST_WEIGHT)))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number above 0 and below 1 from a digest of the id; NULL is a value like any other."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    whole = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources by code point, NULL last, get the weights in turn and share the sum of
    all sizes; a source that would get more than ``most`` times its size stops there
    and the others share the excess by weight. In closed form: with the sources in
    the order of source_size / weight, those before the first that stays below its
    bound stop at it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("bigint")
    ranked = sizes.withColumn("w", weight)
    order = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    share = ((F.sum("source_size").over(whole) - capped).cast("double") / F.sum("w").over(after))
    open_ = F.col("share") * F.col("w") <= F.col("source_size") * most
    return (ranked.withColumn("share", share)
            .withColumn("level", F.max(F.when(open_, F.col("share"))).over(whole))
            .withColumn("target", F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(float("inf"))),
                                          (F.col("source_size") * most).cast("double")))
            .select("source", "source_size", "target"))


def _with_source(left: DataFrame, table: DataFrame, spread: Column) -> DataFrame:
    """Join rows with their source's row; broadcast if checked to be small, else every source is salted."""
    if fits_broadcast(table):
        return left.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("source_")))
    salted = table.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
            .join(salted, F.col("_source").eqNullSafe(F.col("source_")) & (F.col("_salt") == F.col("_salt_")))
            .drop("_salt", "_salt_"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weight: Column | None = None, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """docs with size, source_size, target, passes and taken = passes * size.

    NULL and empty texts have size 0: they cost nothing, and are given in every
    complete pass and in the fraction if their key comes before its end. Rows
    of one id are told apart by size and weight; rows equal in these too are given
    alike. A NULL source is a source of its own. Columns of docs with the
    names of the results are replaced. An empty table gives none.
    """
    docs = clear_of(docs, "size", "source_size", "target", "passes", "taken")
    quality = quality_weight(F.col(text)) if weight is None else weight
    rows = docs.withColumns({"size": size_of(F.col(text)), "_source": F.col(source), "_weight": quality})
    rows = rows.withColumn("_key", -F.log(uniform(F.col(key))) / F.col("_weight"))
    narrow = checkpoint(rows.select("_source", F.col(key).cast("string").alias("_id"), "size", "_weight", "_key"))
    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("full", full.cast("bigint"))
    plan = checkpoint(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
                      .withColumnRenamed("source", "source_"))
    # the bin in which a source's rest ends
    bin_of = F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * BINS).cast("int")
    binned = narrow.withColumn("_bin", bin_of)
    bins = binned.groupBy("_source", "_bin").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("_source").orderBy("_bin")
    bins = bins.withColumn("upto", F.sum("n").over(run))
    at = checkpoint(bins.join(plan, F.col("_source").eqNullSafe(F.col("source_")))
                    .where("upto - n <= rest and upto > rest")
                    .select("source_", F.col("_bin").alias("bin_"), (F.col("upto") - F.col("n")).alias("base"), "rest"))
    # inside it, the row at which it ends; ties in the order of id, size and weight
    order = [F.col("_key"), F.col("_id").isNull(), F.length("_id"), F.col("_id"), F.col("size"), F.col("_weight")]
    inside = _with_source(binned, at, F.col("_key")).where("_bin = bin_")
    within = Window.partitionBy("source_").orderBy(*order)
    # the last row that is taken
    last = (inside.withColumn("upto", F.col("base") + F.sum("size").over(within))
            .where((F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("rest")) < (F.col("rest") - (F.col("upto") - F.col("size")))))
            .groupBy("source_").agg(F.max(F.struct("upto", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("end"))).alias("m"))
            .select(F.col("source_").alias("s_"), F.col("m.end").alias("end")))
    cut = at.select("source_", "bin_").join(last, F.col("source_").eqNullSafe(F.col("s_")), "left").select(
        F.col("source_").alias("c_"), "bin_", "end")
    plan = checkpoint(plan.join(cut, F.col("source_").eqNullSafe(F.col("c_")), "left").drop("c_"))
    named = {"_id": F.col(key).cast("string"), "_bin": bin_of}
    mine = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    # no bin: the rest is all of the source
    part = (F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("bin_").isNull(), F.lit(True))
            .otherwise((F.col("_bin") < F.col("bin_")) | ((F.col("_bin") == F.col("bin_")) & F.coalesce(mine <= F.col("end"), F.lit(False)))))
    out = _with_source(rows.withColumns(named), plan, F.col("_key")).withColumn(
        "passes", F.col("full") + part.cast("bigint"))
    return (out.withColumn("taken", F.col("passes") * F.col("size"))
            .select(*(F.col(f"`{c}`") for c in docs.columns), "size", "source_size", "target", "passes", "taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes")))
    return mixed.where("passes > 0").select(*(F.col(f"`{c}`") for c in mixed.columns), each.alias("copy"))
