"""Rules over typed tables, parameterised by the columns that play each part.

The same rules serve cells parsed from text and ordinary tables. Money is compared in hundredths as whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def accepted(exact: Column, written: Column) -> Column:
    """Whether the written amount is the exact one rounded down, half up or up, to the cent or to the whole unit."""
    ways = [f(exact * 100) for f in (F.floor, F.round, F.ceil)] + [f(exact) * 100 for f in (F.floor, F.round, F.ceil)]
    w = cents(written)
    out = F.lit(False)
    for x in ways:
        out = out | (x.cast("bigint") == w)
    return out


def product_mismatch(rows: DataFrame, key: list[str], quantity: str, price: str, amount: str) -> DataFrame:
    """Rows whose quantity times price is not the amount, under any rounding; nulls are not judged."""
    known = F.col(quantity).isNotNull() & F.col(price).isNotNull() & F.col(amount).isNotNull()
    return rows.where(known & ~accepted(F.col(quantity) * F.col(price), F.col(amount))).select(*key, cents(F.col(amount)).alias("written"), cents(F.col(quantity) * F.col(price)).alias("expected"))


def total_mismatch(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str) -> DataFrame:
    """Keys whose total is not the sum of their parts within one cent for each part; keys with one part are not judged."""
    summed = parts.groupBy(key).agg(F.sum(cents(F.col(part))).alias("expected"), F.count("*").alias("n"))
    joined = totals.select(key, cents(F.col(total)).alias("written")).join(summed, key)
    return joined.where((F.col("n") >= 2) & (F.abs(F.col("written") - F.col("expected")) > F.col("n"))).select(key, "written", "expected", "n")


#: A total for a year over parts by quarter, month or week.
YEARLY = (4, 12, 52)


def inadmissible_totals(
    rows: DataFrame, key: list[str], position: str, label: str, value: str, unsure: str | None = None, bare: str | None = None, closing: str | None = None, span: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Rows that `label` calls totals whose value no admissible sum of the rows above makes: keep, position, written and expected.

    Values are whole numbers; null ones are not added. Admissible are the sum of all parts, of the parts behind the
    last total, and of that total and those parts; without parts, the sum of totals. Two parts (or two totals alone)
    must stand above, none of them unsure. Optional boolean columns: bare (numbers without a unit, where the total must
    be above each part unless one is negative), closing (may be the sum of the last parts from any row on, or the rest
    less it), span (may be YEARLY times a sum). Rows of one key and position come in any order; keys are null-safe.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    is_total, amount = F.coalesce(F.col(label), F.lit(False)), F.col(value)
    above = Window.partitionBy(*key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part, total = F.when(~is_total, amount), F.when(is_total, amount)
    each = rows.withColumns({
        "_parts": F.coalesce(F.sum(part).over(above), F.lit(0)), "_n": F.count(part).over(above), "_totals": F.coalesce(F.sum(total).over(above), F.lit(0)), "_t": F.count(total).over(above),
        "_last": F.last(total, True).over(above), "_unsure": F.coalesce(F.max(flag(unsure)).over(above), F.lit(False)), "_least": F.min(part).over(above), "_most": F.max(part).over(above),
    })
    each = each.withColumn("_behind", F.col("_parts") - F.coalesce(F.last(F.when(is_total & amount.isNotNull(), F.col("_parts")), True).over(above), F.lit(0)))
    sums = F.when(F.col("_n") == 0, F.array("_totals")).otherwise(F.array(F.col("_parts"), F.col("_behind"), F.coalesce(F.col("_last"), F.lit(0)) + F.col("_behind")))
    if closing:
        # The closing row is the last one: what it says and the sum of all parts are known to every row of its key.
        said, all_ = F.last(F.when(flag(closing), amount), True).over(whole), F.last(F.when(flag(closing), F.col("_parts")), True).over(whole)
        each = each.withColumns({"_said": said, "_all": all_})
        # A cut before a part: the parts from there on, or those before it less them.
        fits = part.isNotNull() & ((F.col("_parts") == F.col("_all") - F.col("_said")) | ((F.col("_parts") * 2 == F.col("_all") + F.col("_said")) & (F.col("_n") > 0)))
        each = each.withColumn("_fits", F.max(F.coalesce(fits, F.lit(False))).over(whole))
    admitted = F.exists(sums, lambda s: s == amount) | (flag(span) & F.exists(sums, lambda s: (s != 0) & ((s * YEARLY[0] == amount) | (s * YEARLY[1] == amount) | (s * YEARLY[2] == amount))))
    if closing:
        admitted = admitted | (flag(closing) & F.col("_fits"))
    enough = (F.col("_n") >= 2) | ((F.col("_n") == 0) & (F.col("_t") >= 2))
    as_sum = ~flag(bare) | F.coalesce((F.col("_least") < 0) | (F.col("_most") < amount), F.lit(True))
    expected = F.when(F.col("_n") == 0, F.col("_totals")).otherwise(F.coalesce(F.col("_last"), F.lit(0)) + F.col("_behind"))
    wrong = each.where(is_total & amount.isNotNull() & enough & as_sum & ~F.col("_unsure") & ~flag(unsure) & ~admitted)
    return wrong.select(*(keep or key), position, amount.alias("written"), expected.alias("expected"))


def rate_mismatch(rows: DataFrame, key: list[str], base: str, rate: str, written: str) -> DataFrame:
    """Rows whose written amount is not base times rate under any rounding."""
    return product_mismatch(rows, key, base, rate, written)


def difference_mismatch(rows: DataFrame, key: list[str], whole: str, less: str, written: str) -> DataFrame:
    """Rows where written is not whole minus less (net pay, usage, backorder, variance)."""
    return rows.where(cents(F.col(written)) != cents(F.col(whole)) - cents(F.col(less))).select(*key, cents(F.col(written)).alias("written"), (cents(F.col(whole)) - cents(F.col(less))).alias("expected"))


def over_limit(rows: DataFrame, key: list[str], value: str, limit: str) -> DataFrame:
    """Rows whose value is over its limit (delivered over ordered, net over gross, count over capacity)."""
    return rows.where(F.col(value) > F.col(limit)).select(*key, F.col(value).alias("value"), F.col(limit).alias("most"))


def running_balance_mismatch(rows: DataFrame, group: str, order: list[str], amount: str, balance: str) -> DataFrame:
    """Rows whose balance is not the one before plus this row's amount, by cent."""
    before = F.lag(cents(F.col(balance))).over(Window.partitionBy(group).orderBy(*order))
    each = rows.withColumn("expected", before + cents(F.col(amount)))
    return each.where(F.col("expected") != cents(F.col(balance))).select(group, *order, cents(F.col(balance)).alias("written"), "expected")


def cumulative_below_current(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose running total is below the row's own value: some value before them is negative on balance."""
    frame = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(cents(F.col(value))).over(frame)).where(F.col("total") < cents(F.col(value))).select(group, *order, "total")


def order_violations(rows: DataFrame, group: str, order: str, value: str, least: int = 3) -> DataFrame:
    """group, ups, downs and n of steps against the majority direction; groups of fewer rows or a tie are silent."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    steps = rows.select(group, F.signum(F.col(value).cast("double") - before.cast("double")).alias("step"))
    each = steps.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(F.col("step") > 0).alias("ups"), F.count_if(F.col("step") < 0).alias("downs"))
    return each.where((F.col("rows") >= least) & (F.col("ups") != F.col("downs"))).withColumn("n", F.least("ups", "downs")).where("n > 0").select(group, "ups", "downs", "n")


def numbering_gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Rows whose number is not one more than the one before in the group."""
    before = F.lag(number).over(Window.partitionBy(group).orderBy(number))
    return rows.withColumn("before", before).where(F.col(number) != F.col("before") + 1).select(group, F.col(number).alias("number"), "before")


def reversed_ranges(rows: DataFrame, key: list[str], low: str, high: str) -> DataFrame:
    """Rows that end before they start (amounts, dates, times, serial numbers)."""
    return rows.where(F.col(high) < F.col(low)).select(*key)


def outside_band(rows: DataFrame, bands: DataFrame, key: list[str], value: str, tier: str) -> DataFrame:
    """Rows whose value is outside the band of their tier; bands(tier, low, high) is a small fixed table, broadcast."""
    joined = rows.join(F.broadcast(bands), tier)
    return joined.where(~F.col(value).between(F.col("low"), F.col("high"))).select(*key, tier)


def outside_all(rows: DataFrame, bands: DataFrame, on: list[str], value: str, low: str, high: str) -> DataFrame:
    """Rows whose value no band of their `on` columns holds, where there is one; any number of bands, joined by cells."""
    from docaudit.operators import ranges

    judged = rows.join(bands.select(*on).distinct(), on, "left_semi").where(F.col(value).isNotNull())
    return ranges.within(judged, bands, on, value, low, high, "left_anti")


def band_gaps(bands: DataFrame, group: str) -> DataFrame:
    """Neighbouring bands that overlap or leave a gap: group, high and the next low."""
    following = F.lead("low").over(Window.partitionBy(group).orderBy("low", "high"))
    return bands.withColumn("next_low", following).where(F.col("next_low") != F.col("high")).select(group, "high", "next_low")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys on more than one row, with n."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(facts: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with just two different values; three or more read as a list."""
    each = facts.where(F.col(value).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("one"), F.max(value).alias("other"))
    return each.where("n = 2").select(key, "one", "other")


def percent_sums(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group and total of shares in per cent that, rounded to one place, do not add up to 100 within their rounding."""
    whole = F.sum(value).over(Window.partitionBy(group))
    shares = rows.select(group, F.round(F.col(value) * 100.0 / whole, 1).alias("share"))
    each = shares.groupBy(group).agg(F.round(F.sum("share"), 1).alias("total"), F.count("*").alias("n"))
    return each.where(F.abs(F.col("total") - 100) > F.col("n") * 0.05 + 0.001).select(group, "total", "n")


def dangling(references: DataFrame, targets: DataFrame, reference: str, target: str) -> DataFrame:
    """References without a target."""
    return references.join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key and side."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    joined = a.join(b, key, "full_outer")
    return joined.where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def minority(rows: DataFrame, group: str, form: str) -> DataFrame:
    """group, form and n of forms that are rarer than the group's most frequent one; ties name the first by order."""
    counts = rows.groupBy(group, form).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), form))
    return counts.withColumn("place", place).where("place > 1").select(group, form, "n")


def near_variants(names: DataFrame, name: str, most: int = 1) -> DataFrame:
    """Pairs (a, b) of distinct names, a before b, at an edit distance of `most` (1 or 2) at most and over 0.

    Names meet when one has the other's form with up to `most` letters left out, so no two unlike names are compared.
    Names shorter than four letters are not judged.
    """
    own = names.select(F.col(name).alias("name")).where(F.length(name) >= 4).distinct()

    def without(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x))))

    forms = F.array_union(F.array("name"), without(F.col("name")))
    if most == 2:
        forms = F.array_union(forms, F.flatten(F.transform(without(F.col("name")), without)))
    keyed = own.select("name", F.explode(F.array_distinct(forms)).alias("key"))
    other = keyed.select(F.col("name").alias("b"), "key")
    pairs = keyed.withColumnRenamed("name", "a").join(other, "key").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", most) >= 0)
