"""Reference tables from nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.edits import allocate, highest_id

NESTED = "festivals map<string, map<string, struct<date:string, start:string, end:string, source:string>>>"


def festival_table(spark: SparkSession, path: str) -> DataFrame:
    """(festival, year, date, start, end) of a JSON file: festival -> year -> dates.

    A missing start or end is the day itself.
    """
    nested = spark.read.schema(NESTED).json(path, multiLine=True)
    years = nested.select(F.explode("festivals").alias("festival", "years"))
    rows = years.select("festival", F.explode("years").alias("year", "entry"))
    day = F.col("entry.date").cast("date")
    return rows.select(
        "festival",
        F.col("year").cast("int").alias("year"),
        day.alias("date"),
        F.coalesce(F.col("entry.start").cast("date"), day).alias("start"),
        F.coalesce(F.col("entry.end").cast("date"), day).alias("end"),
    )


def seed_missing(table: DataFrame, builtin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the missing rows added, the added rows). Present rows are never touched."""
    absent = builtin.join(table.select("festival", "year"), ["festival", "year"], "left_anti")
    added = allocate(absent, [F.col("festival"), F.col("year")], highest_id(table))
    added = added.withColumn("user_edited", F.lit(False)).select(*table.columns)
    return table.unionByName(added), added
