"""The landing folder of expense files, and the report files: CSV with every column text.

A file is ``expenses_<date>_v<version>.csv``, or a folder of that name with parts in it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..schemas import EXPENSE, EXPENSE_COLUMNS

NAME = r"expenses_(\d{4}-\d{2}-\d{2})_v(\d+)\.csv"


def _named(path) -> list:
    return [F.regexp_extract(path, NAME, 1).alias("sim_date"), F.regexp_extract(path, NAME, 2).try_cast("int").alias("version")]


def land(lines: DataFrame, root: str) -> None:
    """Write expense lines, one folder per date and version, beside those that are there."""
    name = F.concat(F.lit("expenses_"), "sim_date", F.lit("_v"), F.col("version").cast("string"), F.lit(".csv"))
    lines.select(*EXPENSE_COLUMNS, name.alias("file")).write.mode("append").partitionBy("file").option("header", True).csv(root)


def expense_file(spark: SparkSession, root: str, sim_date: str, version: int) -> DataFrame | None:
    """The lines of one file as ``expense_files`` has them, without a look at any other; None if
    it isn't there."""
    try:
        return expense_files(spark, f"{root}/*expenses_{sim_date}_v{version}.csv")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def expense_files(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all expense files: (sim_date, version, line_no, six text columns).

    ``line_no`` is a struct that orders the lines of a file as they stand there: part, offset of
    the block, row in the block. Other files in the folder are left out.
    """
    df = spark.read.schema(EXPENSE).option("header", True).option("recursiveFileLookup", True).csv(root)
    path = F.col("_metadata.file_path")
    place = F.struct(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*_named(path), place.alias("line_no"), *EXPENSE_COLUMNS).where("sim_date != ''")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(sim_date, version, arrived_at) of every expense file; a missing folder has none.

    Only names and times are read, not the files.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "sim_date string, version int, arrived_at timestamp_ntz")
    found = files.select(*_named(F.col("path")), "modificationTime").where("sim_date != ''")
    return found.groupBy("sim_date", "version").agg(F.max("modificationTime").cast("timestamp_ntz").alias("arrived_at"))


def newest(files: DataFrame) -> DataFrame:
    """The highest version of each date."""
    return files.groupBy("sim_date").agg(F.max("version").alias("version"))


def late(files: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """First versions that came after the end of their day by more than the agreed minutes."""
    due = F.expr(f"timestampadd(MINUTE, {24 * 60 + p.expense_sla_min}, cast(sim_date AS timestamp_ntz))")
    return files.where((F.col("version") <= 1) & (F.col("arrived_at") > due))


def write_report(rec: DataFrame, root: str) -> None:
    """Reconciled rows as CSV with a header, one folder per date; other dates stay."""
    rec.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sim_date").option("header", True).csv(root)


def read_report(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(root)
