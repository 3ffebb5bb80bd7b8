"""Reading and writing: tables, labelled CSV, files by pattern, JSON artifacts, chart specs, sheet exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts that come in fewer splits than there are cores, so in a small file, are dealt out."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and found.rdd.getNumPartitions() < cores else found


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for name in NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table through JDBC; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel scan."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def pdf_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """path, length, file_type of PDF files; paths that differ in case only are one file, the first in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths)).select("path", "length", "modificationTime")
    typed = found.withColumn("file_type", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where("file_type = 'pdf'")
    return typed.groupBy(F.lower("path").alias("path_key")).agg(F.min(F.struct("path", "length", "file_type")).alias("f")).select("f.*")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """text, label from CSV with a header and quoted fields; rows without either are left out."""
    rows = spark.read.schema("text string, label string").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.where("text IS NOT NULL AND label IS NOT NULL")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Parquet, replaced as a whole by the writer's commit."""
    df.write.mode("overwrite").parquet(path)


def chart_url(base: str, kind: Column, labels: Column, values: Column, title: Column) -> Column:
    """The URL of a chart service for a spec built from arrays; spaces are %20."""
    spec = F.to_json(F.struct(kind.alias("type"), F.struct(labels.alias("labels"), F.array(F.struct(title.alias("label"), values.alias("data"))).alias("datasets")).alias("data")))
    return F.concat(F.lit(base), F.replace(F.url_encode(spec), F.lit("+"), F.lit("%20")))


def sheet_name(name: Column) -> Column:
    """A workbook sheet's name: no []:*?/\\ characters, 31 characters at most, 'Sheet' if nothing is left."""
    clean = F.substring(F.trim(F.regexp_replace(name, r"[\[\]:*?/\\]", " ")), 1, 31)
    return F.when(F.length(clean) > 0, clean).otherwise("Sheet")


def guide_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Bullet lines of a text as rows (id, row_no, topic, detail): '- Topic: detail', with or without the topic."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\s*[-*•]\s+\S"))
    body = F.regexp_replace("line", r"^\s*[-*•]\s+", "")
    topic = F.regexp_extract(body, r"^([^:]{1,60}):\s+\S", 1)
    return lines.select(id_col, F.col("at").alias("row_no"), topic.alias("topic"), F.trim(F.when(topic != "", F.regexp_replace(body, r"^[^:]{1,60}:\s+", "")).otherwise(body)).alias("detail"))
