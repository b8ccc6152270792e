"""Statistics of the last rows of a stream at constant cost a row.

Rows are numbered and cut into blocks as long as the window.  A window then is the end of one block and the beginning of the next: a running
statistic from each block's begin, and one from its end, are looked up and put together.  Means and squared deviations
are merged as those of two samples, so that nothing is subtracted from a long running sum and no digits are lost; the lowest and
highest value tell exactly whether all values are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigil.functions.numeric import known


def rolling_stats(df: DataFrame, columns: list[str], size: int, keys: list[str], order: str, *, behind: int = 0) -> DataFrame:
    """Adds <column>_mean and <column>_sd of the size rows that end behind rows before each row, for each key in order.

    Both are null until there are as many rows with a value.  The sample deviation of equal values is exactly zero, and their mean
    exactly that value.  Times of a key are distinct.  One shuffle by keys; every row is read a fixed number of times, whatever size is.
    """
    at, inside = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "_block")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin, end = upto(inside.orderBy(order)), upto(inside.orderBy(F.desc(order)))

    def stats(c: str, over: Window) -> F.Column:
        x = F.col(c).cast("double")
        return F.struct(F.count(x).over(over).alias("n"), F.avg(x).over(over).alias("mean"), F.var_pop(x).over(over).alias("var"), F.min(x).over(over).alias("low"), F.max(x).over(over).alias("high"))

    numbered = df.withColumn("_place", F.row_number().over(at) - 1).withColumn("_block", F.expr(f"_place div {size}"))
    table = numbered.withColumns({f"_end_{c}": stats(c, end) for c in columns}).withColumns({f"_begin_{c}": stats(c, begin) for c in columns})
    whole = (F.col("_place") + 1) % size == 0  # the window is the block itself
    table = table.withColumns({f"_end_{c}": F.when(~whole, F.lag(f"_end_{c}", size - 1).over(at)) for c in columns})
    found = {}
    for c in columns:
        a, b = F.col(f"_end_{c}"), F.col(f"_begin_{c}")
        part = lambda s, name: F.coalesce(s[name], F.lit(0.0))
        n_a, n_b = F.coalesce(a["n"], F.lit(0)), b["n"]
        equal = F.least(a["low"], b["low"]) == F.greatest(a["high"], b["high"])
        mean = (n_a * part(a, "mean") + n_b * part(b, "mean")) / size
        between = (part(a, "mean") - part(b, "mean")) ** 2 * n_a * n_b / size
        squares = part(a, "var") * n_a + part(b, "var") * n_b + between
        full = n_a + n_b == size
        found[f"{c}_mean"] = known(F.when(full, F.when(equal, b["low"]).otherwise(mean)))
        found[f"{c}_sd"] = known(F.when(full, F.when(equal, 0.0).otherwise(F.sqrt(squares / max(size - 1, 1)))))
    table = table.withColumns(found)
    if behind:
        table = table.withColumns({name: F.lag(name, behind).over(at) for name in found})
    return table.drop("_place", "_block", *(f"_{side}_{c}" for side in ("begin", "end") for c in columns))
