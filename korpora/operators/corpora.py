"""Several parallel corpora as one: pairs filtered, then so many of each corpus in the order of its lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpora.operators.corpus import binned, reject_reason
from korpora.session import written
from korpora.sources.readers import parallel_text


def first_of_each(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group by a number (ties as they come; ``order`` should have none).

    The order is cut into ranges. Their counts say which ranges of a group are wanted whole; only the one range in which the group's count is reached is ranked, so no task sorts a group. Null groups are a group.
    """
    cut = binned(rows.filter(F.col(order).isNotNull()), order).withColumn("_g", F.struct(F.col(group).isNull().alias("n"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("v")))
    sizes = cut.groupBy("_g", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < most)
    found = cut.join(wanted, ["_g", "_bin"])
    inside = F.col("_before") + F.col("_n") <= most
    last = found.filter(~inside).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(order))).filter(F.col("_before") + F.col("_r") <= most)
    return found.filter(inside).select(*rows.columns).unionByName(last.select(*rows.columns))


def usable(pairs: DataFrame, most: int | None = None, corpus: str = "corpus", order: str = "line_no") -> DataFrame:
    """Pairs without a reason to reject them, ``most`` of each corpus: rejected lines don't count; pairs without a place (null ``order``) only where ``most`` isn't given.

    All pairs are judged once, and only the places of usable ones are kept for the choice. What lies beyond a corpus's last chosen place is not judged again when texts are fetched.
    """
    reason = reject_reason(F.col("src"), F.col("ref"))
    if most is None:
        return pairs.filter(reason.isNull())
    own = F.struct(F.col(corpus).isNull().alias("n"), F.coalesce(F.col(corpus).cast("string"), F.lit("")).alias("v")).alias("_c")
    chosen = first_of_each(written(pairs.filter(reason.isNull()).select(own, F.col(order).alias("_o")), "usable-places"), "_c", "_o", most)
    last = chosen.groupBy("_c", "_o").agg(F.count("*").alias("_room")).groupBy("_c").agg(F.max(F.struct("_o", "_room")).alias("_last"))
    # The reason is asked for behind the comparison with a column of the other table, so it can't be moved before the join.
    near = pairs.withColumn("_c", own).join(written(last, "usable-last"), "_c").filter(F.when(F.col(order) <= F.col("_last._o"), reason).otherwise("beyond").isNull())
    tie = F.row_number().over(Window.partitionBy("_c", order).orderBy(order))
    return near.withColumn("_r", tie).filter((F.col(order) < F.col("_last._o")) | (F.col("_r") <= F.col("_last._room"))).select(*pairs.columns)


def concatenated(spark: SparkSession, files: dict[str, tuple[str, str]], most: int | None = None, skip: int = 0) -> DataFrame:
    """corpus, line_no, src, ref of line-aligned files by name of the corpus: filtered, then at most ``most`` pairs of each."""
    parts = [parallel_text(spark, left, right, skip).select(F.lit(name).alias("corpus"), "line_no", "src", "ref") for name, (left, right) in files.items()]
    if not parts:
        raise ValueError("no corpus")
    return usable(reduce(DataFrame.unionByName, parts), most)
