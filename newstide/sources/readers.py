"""Readers and writers: tables in Parquet, records in tab- or space-separated text, topics in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def read_records(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Records without quoting, gzip or plain, under a fixed schema."""
    return spark.read.schema(schema).options(sep=sep, quote="", header=header).csv(path)


def read_system_updates(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated system updates with the update id and the document's time derived from its id."""
    rows = read_records(spark, path, schemas.SYSTEM_UPDATE, " ", False)
    return rows.withColumns({"update_id": F.concat_ws("-", "document_id", F.col("sentence_id").cast("string")), "document_epoch": F.split_part("document_id", F.lit("-"), F.lit(1)).cast("long")})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the shared folder that the session names; one of this machine only under a local master."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="newstide-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def intact(files: DataFrame, content: str, name: str) -> DataFrame:
    """The files whose content has the digest that names them."""
    return files.where(F.md5(F.col(content)) == F.col(name))


def write_records(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated, gzip, no quoting."""
    df.write.mode("overwrite").options(sep="\t", quote="", header=header, compression="gzip").csv(path)


def write_stream(df: DataFrame, path: str, per_file: int = 1000) -> None:
    """Parquet by topic, at most ``per_file`` rows in a file."""
    df.write.mode("overwrite").partitionBy("query_id").option("maxRecordsPerFile", per_file).parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """The seven submission columns, tab-separated, no header."""
    write_records(df.select("qid", "team", "run", "stream_id", "sent_id", "ts", "conf"), path, False)


def read_topics(spark: SparkSession, path: str, ids: list | None = None, types: list[str] | None = None, prefix: str = "TS14") -> DataFrame:
    """Topics of an XML file (rows tagged ``event``). Ids go before types; bare numbers take the prefix."""
    raw = spark.read.format("xml").option("rowTag", "event").load(path)
    rows = raw.select(
        F.concat(F.lit(f"{prefix}."), F.col("id").cast("string")).alias("query_id"),
        F.col("id").cast("int").alias("query_num"),
        F.trim("title").alias("title"),
        F.trim("type").alias("type"),
        F.split(F.trim("query"), r"\s+").alias("query"),
        F.timestamp_seconds(F.col("start").cast("long")).alias("start_ts"),
        F.timestamp_seconds(F.col("end").cast("long")).alias("end_ts"),
    )
    return select_topics(rows, ids, types, prefix)


def select_topics(topics: DataFrame, ids: list | None = None, types: list[str] | None = None, prefix: str = "TS14") -> DataFrame:
    """Topics by id or else by type; the filter reaches the scan."""
    if ids:
        return topics.where(F.col("query_id").isin([x if isinstance(x, str) else f"{prefix}.{x}" for x in ids]))
    return topics.where(F.col("type").isin(types)) if types else topics
