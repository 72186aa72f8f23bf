"""Stored market tables: readers that push their filters down, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where each table lies below the store's root, its time column and its order.
TABLES = {
    "raw_market_events": ("exchange_event_ms", ["seq"]),
    "trades": ("ts_ms", ["seq"]),
    "order_book_updates": ("ts_ms", ["seq", "pos"]),
    "order_book_snapshots": ("ts_ms", ["seq"]),
    "analytics_snapshots": ("ts_ms", ["ts_ms"]),
    "analytics_events": ("ts_ms", ["ts_ms"]),
    "delta_by_price": ("ts_ms", ["price"]),
    "liquidity_events": ("ts_ms", ["ts_ms"]),
}
SEQS = 5_000_000
RAW, TRADES, UPDATES, SNAPSHOTS = "raw_market_events", "trades", "order_book_updates", "order_book_snapshots"


def write(rows: DataFrame, root: str, table: str, mode: str = "append", below: str = "") -> None:
    """Append rows by day, symbol and session, so that a session's, a symbol's or a day's read opens its own files alone.

    A task and a file hold at most SEQS sequence numbers of a day and session, where rows have them.
    below names a folder under the table's, such as batch=7, which a retry overwrites as a whole.
    """
    ms = TABLES[table][0]
    day = F.to_date(F.timestamp_millis(F.col(ms)))
    parts = [c for c in ("symbol", "session_id") if c in rows.columns]
    pieces = [F.floor(F.col("seq") / SEQS)] if "seq" in rows.columns else []
    rows.withColumn("dt", day).repartition("dt", *parts, *pieces).sortWithinPartitions(*TABLES[table][1]).write.mode(mode).partitionBy("dt", *parts).parquet(f"{root}/{table}/{below}" if below else f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table; a session or symbol of digits stays text. Its folders are listed again only for that."""
    path = f"{root}/{table}"
    found = spark.read.parquet(path)
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("symbol", "session_id") else f.dataType) for f in found.schema])
    return found if found.schema == texts else spark.read.schema(texts).parquet(path)


def read_session(spark: SparkSession, root: str, table: str, session_id: str) -> DataFrame:
    """One session's rows of a table in their order: a partition filter, then a sort."""
    return read(spark, root, table).where(F.col("session_id") == session_id).orderBy(*TABLES[table][1])


def read_range(spark: SparkSession, root: str, table: str, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """A symbol's rows within an inclusive range of event time; days and symbol are pruned by partition, the rest in the scan."""
    ms = TABLES[table][0]
    day = lambda t: F.to_date(F.timestamp_millis(F.lit(t)))
    rows = read(spark, root, table).where(F.col("dt").between(day(start_ms), day(end_ms)))
    return rows.where((F.col("symbol") == symbol) & F.col(ms).between(start_ms, end_ms)).orderBy(*TABLES[table][1])


def get_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id).limit(1)


def list_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The newest n sessions."""
    return sessions.orderBy(F.col("started_ms").desc(), "session_id").limit(n)


def resolve_session(sessions: DataFrame, symbol: str, among: int = 20) -> DataFrame:
    """The newest session of symbol among the newest ones, else the newest of all."""
    return list_sessions(sessions, among).orderBy((F.col("symbol") == symbol).desc(), F.col("started_ms").desc(), "session_id").limit(1)


def session_status(log: DataFrame) -> DataFrame:
    """The newest entry of each session in an append-only log (session_id, version, status, ended_ms, ...)."""
    rest = [c for c in log.columns if c != "session_id"]
    return log.groupBy("session_id").agg(F.max_by(F.struct(*rest), F.col("version")).alias("x")).select("session_id", "x.*")


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a folder; the contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("length").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw rows that arrive as Parquet files in a folder."""
    schema = "session_id string, seq long, symbol string, stream_type string, exchange_event_ms long, raw_payload string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
