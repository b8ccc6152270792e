"""Archives of trades and bars, and the CSV tables around them."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from vigil.functions.numeric import epoch_to_timestamp, epoch_unit, flag, known
from vigil.sources import zip_source

TRADES = ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker", "is_best_match")
BARS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume", "ignore")


#: (pair, first day, last day) of archives to open.
Ranges = list[tuple[str, dt.date, dt.date]]


def ranges_of(pair_days: DataFrame, *, before: int = 0) -> Ranges:
    """The runs of days of each pair in pair_days (pair, day), each begun so many days before.  The driver gets one row a run: about one a pair."""
    order = Window.partitionBy("pair").orderBy("day")
    new = F.when(F.datediff("day", F.lag("day").over(order)) == 1, 0).otherwise(1)
    runs = pair_days.select("pair", "day").distinct().withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return [tuple(r) for r in runs.groupBy("pair", "_run").agg(F.date_sub(F.min("day"), before).alias("first"), F.max("day").alias("last")).drop("_run").collect()]


def read_zip_csv(spark: SparkSession, path: str, columns: tuple[str, ...], wanted: tuple[str, ...] | None = None, *, keep: Ranges | None = None) -> DataFrame:
    """Rows of ZIP archives that hold one CSV file each: file, seq, pair, day (from the file's name), and the wanted columns as text.

    Columns are named by place.  A first line whose first field is no number is a header.  An archive with
    another number of members, or a line with another number of fields, ends the job; an empty
    file has no rows.  With keep, only archives of these pairs and days are opened; columns that are not wanted are not parsed.
    Rows leave in batches, so that an archive is never held as a whole table.
    """
    fields = ["file string", "seq long", "pair string", "day date", *(f"`{c}` string" for c in (columns if wanted is None else wanted))]
    return _scan(spark, path, columns, ", ".join(fields), keep)


def read_heads(spark: SparkSession, path: str, *, keep: Ranges | None = None) -> DataFrame:
    """file, pair, day, headed, first: whether an archive begins with a header, and the fields of its first record.  Nothing behind that is inflated."""
    return _scan(spark, path, (), zip_source.HEAD, keep)


def _scan(spark: SparkSession, path: str, columns: tuple[str, ...], schema: str, keep: Ranges | None) -> DataFrame:
    uri, names = zip_source.qualified(spark, path), ",".join(columns)
    if zip_source.file_system(uri):
        spark.dataSource.register(zip_source.ZipCsv)
        reader = spark.read.format(zip_source.FORMAT).option("columns", names).schema(schema)
        return (reader if keep is None else reader.option("keep", json.dumps([(p, str(a), str(b)) for p, a, b in keep]))).load(uri)
    files = _archives(spark, path)
    if keep is not None:
        name = F.regexp_extract("path", r"([^/]+?)-[^/]*?(\d{4}-\d{2}-\d{2})\.zip$", 1), F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.zip$", 1))
        ranges = spark.createDataFrame(keep, "_pair string, _first date, _last date")
        files = files.join(ranges, (name[0] == F.col("_pair")) & name[1].between(F.col("_first"), F.col("_last")), "left_semi")
    return files.select("path", "content").mapInArrow(zip_source.from_content(names, StructType.fromDDL(schema)), schema)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)


_NUMBERS = ("open", "high", "low", "close", "volume", "quote_volume", "trades")


def read_trades(spark: SparkSession, path: str, *, columns: tuple[str, ...] = ("file", "seq", "ts", "price", "quote_volume", "side"), keep: Ranges | None = None) -> DataFrame:
    """pair, day (of the archive) and the columns asked for: a trade whose buyer is the maker is a sell."""
    price, quantity = F.col("price").cast("double"), F.col("quantity").cast("double")
    made = {
        "file": (F.col("file"), ()), "seq": (F.col("seq"), ()), "ts": (epoch_to_timestamp(F.col("transact_time").cast("long")), ("transact_time",)), "price": (price, ("price",)),
        "quote_volume": (price * quantity, ("price", "quantity")), "side": (F.when(flag(F.col("is_buyer_maker")), "sell").otherwise("buy"), ("is_buyer_maker",)),
    }
    used = tuple(c for c in TRADES if any(c in made[x][1] for x in columns))
    return read_zip_csv(spark, path, TRADES, used, keep=keep).select("pair", "day", *(made[x][0].alias(x) for x in columns))


def read_bars(spark: SparkSession, path: str, *, columns: tuple[str, ...] = _NUMBERS, keep: Ranges | None = None) -> DataFrame:
    """pair, day (of the archive), open_time and the numbers asked for of each bar."""
    raw = read_zip_csv(spark, path, BARS, ("open_time", *columns), keep=keep)
    return raw.select("pair", "day", epoch_to_timestamp(F.col("open_time").cast("long")).alias("open_time"), *(known(F.col(c).cast("double")).alias(c) for c in columns))


def epoch_units(spark: SparkSession, path: str, *, keep: Ranges | None = None) -> DataFrame:
    """Per archive of trades with a record: file, pair, day, headed and the unit of its first record, of which alone it is read."""
    value = F.try_element_at("first", F.lit(TRADES.index("transact_time") + 1)).try_cast("double").cast("long")
    return read_heads(spark, path, keep=keep).where(F.size("first") > 0).select("file", "pair", "day", "headed", F.coalesce(epoch_unit(value), F.lit("")).alias("unit"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Membership tables; the date is in the name of the file, or of the folder with its parts, universe_YYYY-MM-DD.csv."""
    raw = spark.read.schema("symbol string, vol30d decimal(28,8), rank int, included string").csv(f"{path}/universe_*.csv", header=True)
    date = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"universe_(\d{4}-\d{2}-\d{2})\.csv", 1))
    return raw.select(date.alias("table_date"), "symbol", "vol30d", "rank", (F.col("included") == "1").alias("included"))


def read_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV log; an empty field is the empty text."""
    return spark.read.schema(columns).csv(path, header=True, nullValue="\0", emptyValue="")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pull manifest with seq, the order of its rows: its own column, or in one plain file the place of the row.  Several plain files have no order."""
    columns = "date date, symbol string, file string, bytes long, sha256 string, source_checksum_ok string"
    if "seq" in spark.read.csv(path, header=True).columns:
        return read_log(spark, path, columns + ", seq long")
    rows = read_log(spark, path, columns)
    if len(rows.inputFiles()) > 1:
        raise ValueError(f"{path} has several files without a column seq")
    return rows.withColumn("seq", F.monotonically_increasing_id())


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    schema = "pair string, ts_utc timestamp_ntz, detector string, frequency string, score double, day string"
    return spark.read.schema(schema).csv(path, header=True).withColumn("frequency", F.coalesce("frequency", F.lit("")))


def present_files(spark: SparkSession, path: str) -> DataFrame:
    """The names of all archives below a folder; their content is not read."""
    return _archives(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file")).distinct()


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    schema = "pair string, ts_utc timestamp_ntz, detector string, threshold double, score double, threshold_label string, frequency string, ts_available_utc timestamp_ntz, day string"
    return spark.read.schema(schema).csv(path, header=True).withColumn("frequency", F.coalesce("frequency", F.lit("")))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The distinct dates in a text file, divided by white space."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("d")).where("d <> ''")
    return words.select(F.to_date("d").alias("day")).distinct()


def read_matrix(spark: SparkSession, path: str, features: tuple[str, ...], label: str = "gt") -> DataFrame:
    """A labelled feature matrix in (compressed) CSV; only the columns asked for are kept."""
    return spark.read.csv(path, header=True).select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("int").alias(label))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in sample; a verdict that is blank or unknown ends the job."""
    from vigil.constants import VERDICTS

    rows = spark.read.csv(path, header=True).withColumn("verdict", F.lower(F.trim(F.coalesce("verdict", F.lit("")))))
    return rows.where(F.assert_true(F.col("verdict").isin(*VERDICTS), F.concat(F.lit("unknown verdict "), F.col("verdict"))).isNull())


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file and the SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))
