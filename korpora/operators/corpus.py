"""Parallel corpora: filters with reasons, alignment, splits, samples, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpora.functions.text import once

#: Letters that count as text in the corpus filter.
LETTERS = "a-zA-ZäöüÄÖÜß"
BLANK = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(x, F.lit(BLANK))


def letter_share(x: Column) -> Column:
    return F.length(F.regexp_replace(x, f"[^{LETTERS}]", "")) / F.length(x)


def length_ratio(a: Column, b: Column) -> Column:
    return F.length(a) / F.length(b)


def reject_reason(src: Column, ref: Column, shortest: int = 10, longest: int = 500, letters: float = 0.4, ratio: tuple[float, float] = (0.3, 3.0)) -> Column:
    """The first rule that a pair breaks, null if it breaks none. White space at the ends doesn't count."""

    def first(p: Column) -> Column:
        s, r, n, m = p["s"], p["r"], F.length(p["s"]), F.length(p["r"])
        return (
            F.when((n == 0) | (m == 0), "empty")
            .when((n < shortest) | (m < shortest), "too_short")
            .when((n > longest) | (m > longest), "too_long")
            .when(letter_share(s) < letters, "mostly_numbers")
            .when(F.lower(s) == F.lower(r), "identical")
            .when((n / m > ratio[1]) | (n / m < ratio[0]), "length_ratio")
        )

    return once(F.struct(strip(F.coalesce(src, F.lit(""))).alias("s"), strip(F.coalesce(ref, F.lit(""))).alias("r")), first)


def clean_term(term: Column, shortest: int = 2, longest: int = 200, letters: float = 0.4) -> Column:
    """Trimmed and squeezed; null if its length or its share of letters is out of bounds."""
    t = F.trim(F.regexp_replace(term, r"\s+", " "))
    alphabetic = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.length(t)
    return F.when(F.length(t).between(shortest, longest) & (alphabetic >= letters), t)


def align(rows: DataFrame, left: str, right: str, *keep: str, slack: int = 1) -> DataFrame:
    """Two arrays of sentences zipped by position if their sizes differ by ``slack`` at most and neither is empty; else nothing."""
    n, m = F.size(left), F.size(right)
    fits = rows.filter((n > 0) & (m > 0) & (F.abs(n - m) <= slack))
    zipped = F.slice(F.arrays_zip(F.col(left).alias("src"), F.col(right).alias("ref")), F.lit(1), F.least(n, m))
    return fits.select(*keep, F.posexplode(zipped).alias("idx", "p")).select(*keep, "idx", "p.src", "p.ref")


def hash_order(key: Column, seed: int) -> Column:
    """A fixed shuffle that other engines can repeat: a linear congruence of an integer key.

    Modulo 2**32 the key may go by its remainder and the factor by the negative number of the same remainder, so that no key, however large, leaves 64 bits.
    """
    return F.pmod(F.pmod(key.cast("long"), F.lit(1 << 32)) * F.lit(2654435761 - (1 << 32)) + F.lit(seed), F.lit(1 << 32))


def shuffled_ranks(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds _r, the rank from 1 in the shuffled order; the order is cut into ranges, so no task sees more than one."""
    shuffled = rows.withColumn("_o", hash_order(F.col(key), seed)).withColumn("_bin", F.floor(F.col("_o") / (1 << 20)).cast("int"))
    sizes = shuffled.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = sizes.select("_bin", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = shuffled.join(F.broadcast(before), "_bin")
    return ranked.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy("_o", key))).drop("_o", "_bin", "_before")


def split_by_rank(rows: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42, floor: int = 0) -> DataFrame:
    """train, val, test by exact shares of the shuffled rows; ``floor`` is the least size of val and test.

    Ranks need one order over all rows. The order is cut into ranges by key, ranked within and shifted by the sizes before, so no task sees more than a range.
    """
    n = rows.count()
    ranked = shuffled_ranks(rows, key, seed)
    if floor:
        val = test = max(floor, int(n * shares[1]))
        train = max(0, n - val - test)
    else:
        train, val = int(n * shares[0]), int(n * shares[1])
    return ranked.withColumn("split", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")).drop("_r")


def split_changed(rows: DataFrame, key: str, changed: str = "changed", seed: int = 42) -> DataFrame:
    """train and val of the changed rows only: a tenth, at least one row, validates. A missing mark counts as unchanged; no rows give no rows."""
    kept = rows.filter(F.coalesce(F.col(changed), F.lit(False)))
    val = max(1, kept.count() // 10)
    return shuffled_ranks(kept, key, seed).withColumn("split", F.when(F.col("_r") <= val, "val").otherwise("train")).drop("_r")


def within_ter(rows: DataFrame, most: float = 0.5, exempt: str = "test") -> DataFrame:
    """Pairs of a small enough edit rate (column ter); the exempt split stays whole. A missing rate counts as too large."""
    return rows.filter(F.coalesce(F.col("split") == exempt, F.lit(False)) | (F.col("ter") <= most))


def binned(rows: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """Adds ``_bin``: ranges of a number with about as many rows each, so that an order over all rows is an order of bins and one within each."""
    n = bins or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(value, [k / n for k in range(1, n)], 0.1 / n)))
    inside = sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return rows.withColumn("_bin", inside)


def ranked(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``_r``, the rank of a row by value and key among all rows: its rank in its bin, shifted by the sizes of the bins before."""
    b = binned(rows, value)
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = b.groupBy("_bin").agg(F.count("*").alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = b.join(F.broadcast(sizes), "_bin").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy(value, key)))
    return out.drop("_bin", "_before")


def tertile_sample(rows: DataFrame, score: str, key: str, sizes: tuple[int, int, int], seed: int = 42) -> DataFrame:
    """A sample by thirds of the order by score: so many of the low, middle and high third, by hash."""
    third = rows.count() // 3
    tier = F.when(F.col("_r") <= third, 0).when(F.col("_r") <= 2 * third, 1).otherwise(2)
    tiers = ranked(rows, score, key).withColumn("tier", tier).drop("_r")
    parts = [tiers.filter(F.col("tier") == k).orderBy(hash_order(F.col(key), seed), key).limit(n) for k, n in enumerate(sizes)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def within_budget(rows: DataFrame, text: str, priority: str, key: str, budget: int) -> DataFrame:
    """Rows by priority and key for as long as their characters fit; the running sum is exact. Bins that begin beyond the budget are left out before anything is sorted."""
    sized = binned(rows.withColumn("_c", F.length(text)), key)
    bins = [priority, "_bin"]
    before = Window.orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy(*bins).agg(F.sum("_c").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).filter(F.col("_before") <= budget).drop("_s")
    running = Window.partitionBy(*bins).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.join(F.broadcast(sums), bins).withColumn("chars_so_far", F.col("_before") + F.sum("_c").over(running)).filter(F.col("chars_so_far") <= budget)
    return out.drop("_c", "_bin", "_before")


def first_wins(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def top_per_group(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't there yet, one of each."""
    return new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def insert_counts(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many of the new rows ``insert_or_ignore`` takes, and how many it skips (known keys and repeats)."""
    taken = insert_or_ignore(existing, new, keys).agg(F.count("*").alias("inserted"))
    return taken.crossJoin(new.agg(F.count("*").alias("_n"))).select("inserted", (F.col("_n") - F.col("inserted")).alias("skipped"))  # a row each


def stem_counts(rows: DataFrame, text: str, stems: tuple[str, ...]) -> DataFrame:
    """(stem, n): rows whose text holds a stem, in any case, for each stem that any row holds, and for all together as '(any)'. One pass, counted before the shuffle."""
    own = tuple(dict.fromkeys(stems))
    found = rows.select(F.filter(F.array(*[F.lit(s) for s in own]), lambda s: F.lower(text).contains(s)).alias("_s")).filter(F.size("_s") > 0)
    each = found.select(F.explode(F.concat("_s", F.array(F.lit("(any)")))).alias("stem"))
    return each.groupBy("stem").agg(F.count("*").alias("n"))


def update_by_lines(rows: DataFrame, ids: DataFrame, texts: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set from two line-aligned tables (line_no, line): ids and texts. Nothing is updated, and ValueError raised, if they aren't of the same number of lines; blank id lines don't count as lines, of a repeated id the last line wins."""
    from korpora.session import written

    own = ids.filter(strip(F.col("line")) != "")
    n, m = own.count(), texts.count()
    if n != m:
        raise ValueError(f"{n} ids and {m} texts")
    if n != ids.count():  # lines are counted anew without the blank ones
        blank = ids.filter(strip(F.col("line")) == "").select(F.col("line_no").alias("_b"))
        shift = own.join(blank, F.col("_b") < F.col("line_no")).groupBy("line_no").agg(F.count("*").alias("_s"))
        own = own.join(shift, "line_no", "left").withColumn("line_no", F.col("line_no") - F.coalesce("_s", F.lit(0))).drop("_s")
    pairs = own.select("line_no", strip(F.col("line")).cast("long").alias(key)).join(texts.select("line_no", strip(F.col("line")).alias(column)), "line_no")
    return update_column(rows, written(pairs.groupBy(key).agg(F.max_by(column, "line_no").alias(column)), "line-updates"), key, column)


def update_column(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from the updates where they have the key."""
    new = updates.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def ensure_column(rows: DataFrame, column: str, kind: str = "string") -> DataFrame:
    return rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))


def delete_and_insert(rows: DataFrame, gone: Column, new: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce(gone, F.lit(False))).unionByName(new, allowMissingColumns=True)
