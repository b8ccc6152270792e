"""Writers: tables with provenance, append-only logs, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil import constants
from vigil.functions.positions import with_position


def stamp(df: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """Adds the provenance to every row."""
    return df.withColumns({k: F.lit(provenance.get(k, "")) for k in ("protocol_freeze_commit", "analysis_commit", "run_id")})


def write_table(df: DataFrame, path: str, provenance: dict[str, str] | None = None, *, mode: str = "errorifexists", format: str = "csv") -> None:
    out = stamp(df, provenance) if provenance else df
    writer = out.write.mode(mode)
    writer.csv(path, header=True, emptyValue="") if format == "csv" else writer.format(format).save(path)


def write_episodes(df: DataFrame, path: str, **options) -> None:
    write_table(df.select(*constants.EPISODE_COLUMNS), path, **options)


def write_candidates(df: DataFrame, path: str, **options) -> None:
    write_table(df.select(*constants.CANDIDATE_COLUMNS), path, **options)


def append_log(rows: DataFrame, path: str, *, order: tuple[str, ...] = ("symbol", "file")) -> None:
    """Appends rows with seq, which goes on from the highest one there and grows within an append by order: files of a folder have no order themselves."""
    spark, last = rows.sparkSession, -1
    if exists(spark, path):
        last = spark.read.csv(path, header=True).agg(F.max(F.col("seq").cast("long"))).first()[0]
    placed = with_position(rows.drop("seq"), *order, name="seq")
    write_table(placed.withColumn("seq", F.col("seq") + (-1 if last is None else last) + 1), path, mode="append")


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _files(spark, path)
    return files.exists(hadoop)


def replace_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """Writes a few lines beside path and then puts them in its place."""
    fresh, files = _files(spark, f"{path}.{uuid.uuid4().hex}")
    old, _ = _files(spark, path)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(fresh.toString())
    files.delete(old, True)
    files.rename(fresh, old)


def write_universe(table: DataFrame, path: str) -> None:
    """Writes a day's membership table once, and beside it the digests of its files; a table that is there is never written again."""
    write_table(table.orderBy("rank").coalesce(1), path)
    digests = table.sparkSession.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    digests.select(F.concat_ws("  ", "sha256", "file").alias("value")).write.text(path.rstrip("/") + ".sha256")


def markdown(facts: dict[str, DataFrame], path: str, *, title: str, rows: int = 50) -> None:
    """Writes the first rows of small tables as one Markdown text."""
    lines = [f"# {title}"]
    for name, df in facts.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
    spark = next(iter(facts.values())).sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, present: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key is not present, so that a job that was cut off can go on."""
    write_table(rows.join(present.select(key), key, "left_anti"), path, mode="append")


def requeue(days: DataFrame, day: str) -> DataFrame:
    return days.where(F.col("day") != F.to_date(F.lit(day)))


def report(df: DataFrame, path: str) -> None:
    """Writes a small table as one JSON line a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
