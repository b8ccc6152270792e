"""Membership tables: ranking, which table governs a day, strata and churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigil import constants
from vigil.functions.positions import with_rank


def eligible(symbols: DataFrame, *, quote: str = "USDT", excluded_bases: tuple[str, ...] = constants.LEVERAGED_BASES + constants.STABLE_FIAT_BASES) -> DataFrame:
    """Symbols that trade on the spot market against the quote asset and whose base is not excluded, in order."""
    keep = (F.col("status") == "TRADING") & (F.col("quote_asset") == quote) & F.coalesce(F.col("spot_allowed"), F.lit(False)) & ~F.col("base_asset").isin(*excluded_bases)
    return symbols.where(keep).select("symbol").orderBy("symbol")


def trailing_volume(daily: DataFrame, *, days: int = constants.TRAILING_DAYS) -> DataFrame:
    """Per symbol: the volume of the days latest days, without the very last, which is still running."""
    latest = Window.partitionBy("symbol").orderBy(F.desc("day"))
    ranked = daily.withColumn("_r", F.row_number().over(latest)).where((F.col("_r") > 1) & (F.col("_r") <= days + 1))
    return ranked.groupBy("symbol").agg(F.sum(F.col("volume").cast("decimal(28,8)")).alias("volume"))


def rank_table(volumes: DataFrame, *, excluded: int = constants.TOP_EXCLUDED) -> DataFrame:
    """Adds rank, by volume and then symbol, and included, for ranks beyond the first few; per table_date."""
    return with_rank(volumes, "table_date", F.desc("volume"), "symbol").withColumn("included", F.col("rank") > excluded)


def latest_table(tables: DataFrame) -> DataFrame:
    """The rows of the newest table of any date."""
    newest = tables.agg(F.max("table_date").alias("table_date"))
    return tables.join(F.broadcast(newest), "table_date", "left_semi")  # one row


def included_symbols(table: DataFrame) -> DataFrame:
    return table.where("included").select("symbol", "rank").orderBy("rank")


def governing_table(days: DataFrame, tables: DataFrame) -> DataFrame:
    """Per day: the newest table_date strictly before it, or null."""
    dates = F.broadcast(tables.select("table_date").distinct())  # one row a table: a few a month
    return days.join(dates, F.col("table_date") < F.col("day"), "left").groupBy("day").agg(F.max("table_date").alias("table_date"))


def governed(days: DataFrame, tables: DataFrame, *, reinstated: tuple[str, ...] = constants.REINSTATED, last_defective: str | None = constants.LAST_DEFECTIVE_TABLE, only: DataFrame | None = None) -> DataFrame:
    """day, symbol, rank of the included symbols of the governing table, and their stratum if the tables have one.

    Reinstated symbols come last, without rank, under tables up to last_defective that leave them out.
    only: (day, symbol) to which the result is restricted, before a table is repeated for each of its days.
    """
    governing = governing_table(days, tables)
    own = ["rank", *(c for c in ("stratum",) if c in tables.columns)]
    included = tables.where("included").select("table_date", "symbol", *own)
    if only is None:
        out = governing.join(included, "table_date")
    else:
        only = only.select("day", "symbol").distinct()
        out = only.join(F.broadcast(governing), "day").join(included, ["table_date", "symbol"])  # one row a day
    out = out.select("day", "table_date", "symbol", *own)
    if reinstated and last_defective:
        extra = governing.where(F.col("table_date") <= F.to_date(F.lit(last_defective))).withColumn("symbol", F.explode(F.array(*map(F.lit, reinstated))))
        listed = governing.join(included.where(F.col("symbol").isin(*reinstated)), "table_date").select("day", "symbol")  # of few symbols
        extra = extra.join(listed, ["day", "symbol"], "left_anti")
        if only is not None:
            extra = F.broadcast(extra).join(only, ["day", "symbol"])
        out = out.unionByName(extra.select("day", "table_date", "symbol", *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in own)))
    return out


def strata(members: DataFrame, *, parts: int = constants.STRATA, by: str = "day") -> DataFrame:
    """Adds stratum (1 is the most active) by rank, cut where round(n k / parts) members have come; per by.

    Halves round to the even number.  Members without rank are unassigned (null).
    """
    ranked = with_rank(members.where("rank is not null"), by, "rank", name="_p")
    sizes = ranked.groupBy(by).agg(F.count("*").alias("_n"))
    stratum = F.lit(None).cast("int")
    for k in range(parts, 0, -1):
        stratum = F.when(F.col("_p") <= F.rint(F.col("_n") * k / parts), F.lit(k)).otherwise(stratum)
    cut = ranked.join(sizes, by).withColumn("stratum", stratum).select(*members.columns, "stratum")
    return cut.unionByName(members.where("rank is null").withColumn("stratum", F.lit(None).cast("int")))


def table_strata(tables: DataFrame, *, parts: int = constants.STRATA) -> DataFrame:
    """Adds stratum to the included symbols of each table, which have the same one on all days that it governs; the others have none.

    governed() of these has the strata of its days, without a rank among the members of each day.
    """
    rest = tables.where(~F.coalesce("included", F.lit(False))).withColumn("stratum", F.lit(None).cast("int"))
    return strata(tables.where("included"), parts=parts, by="table_date").unionByName(rest)


def membership_sizes(tables: DataFrame) -> DataFrame:
    return tables.groupBy("table_date").agg(F.count("*").alias("total"), F.count_if("included").alias("included_count"))


def churn(tables: DataFrame) -> DataFrame:
    """Per table after the first: symbols added and dropped, and ranks changed, against the one before."""
    dates = tables.select("table_date").distinct()
    steps = dates.withColumn("before", F.lag("table_date").over(Window.orderBy("table_date"))).where("before is not null")
    now = tables.join(F.broadcast(steps), "table_date").select("table_date", "symbol", "rank")
    old = tables.select(F.col("table_date").alias("before"), "symbol", F.col("rank").alias("old_rank")).join(F.broadcast(steps), "before").drop("before")
    both = now.join(old, ["table_date", "symbol"], "full_outer")
    return both.groupBy("table_date").agg(F.count_if(F.col("old_rank").isNull()).alias("added"), F.count_if(F.col("rank").isNull()).alias("dropped"), F.count_if(F.col("rank") != F.col("old_rank")).alias("moved"))
