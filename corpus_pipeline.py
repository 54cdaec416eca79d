"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

In every stage rows that repeat an id with other columns are documents of their own; a row
that repeats another in all columns is the same document. Null texts are empty documents.
An empty table passes through as an empty table, and columns beyond those of ``documents``
are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.llm.common import remove, scratch, sized, stored, table
from wayledger.llm.gam import classify
from wayledger.llm.jaccard_join import jaccard_components
from wayledger.llm.mixing import mix
from wayledger.llm.phrase_index import decontaminate
from wayledger.llm.pii import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``row``, unique and never null, and whether that is the id: where ids
    are unique and not null. Else it is a hash of all columns, after rows that are equal in
    all columns have become one."""
    docs = docs.select(COLUMNS)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id IS NULL OR c > 1").limit(1).count()
    if odd:
        return docs.dropDuplicates().withColumn("row", F.xxhash64(*COLUMNS)), False
    return docs.withColumn("row", F.col("doc_id").cast("long")), True


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(sized(stored(rows.select("row"), "gone")), "row", "left_anti").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Empty texts are scored like others;
    repeated rows get equal scores."""
    return classify(docs, table(spark, sf_dir, "labels"), COLUMNS).where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id,
    a null id last. Documents without words are in no group and stay."""
    keyed, by_id = _keyed(docs)
    groups = jaccard_components(keyed, "row")
    ids = groups.withColumn("doc_id", F.col("row")) if by_id else groups.join(keyed.select("row", "doc_id"), "row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = ids.groupBy("component_id").agg(F.min(place).alias("least"), F.count("*").alias("c")).where("c > 1")
    return _without(keyed, ids.join(least, "component_id").where(F.col("row") != F.col("least.row")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; those without words stay."""
    keyed, _ = _keyed(docs)
    return _without(keyed, decontaminate(keyed, table(spark, sf_dir, "benchmark"), "row").where("contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; every row stays, null texts too."""
    return redact(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy.

    Rows that are equal in id, source and text share what the mix takes of them. Only
    narrow rows are counted and joined to the texts; equal rows are told apart by a number
    of their own, and only where there are any.
    """
    mixed = mix(docs).groupBy("row").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    mixed = stored(mixed.where("copies > 0"), "copies")
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "source", "text").alias("row"))
    taken = keyed.join(sized(mixed.where("rows = 1")), "row")
    many = mixed.where("rows > 1")
    if many.limit(1).count():
        nth = F.row_number().over(Window.partitionBy("row").orderBy("lang", "n_chars")) - 1
        share = F.floor(F.col("copies") / F.col("rows")) + (nth < F.col("copies") % F.col("rows")).cast("long")
        taken = taken.unionByName(keyed.join(sized(many), "row").withColumn("copies", share).where("copies > 0"))
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: Classifier fitting and span learning are not SQL; the stages are tested against brute force.
ORACLE_SQL = None
