"""Decoding capture files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Profile
from ..functions.bits import bytes_hex
from ..plans import captures
from ..sources import edge_csv
from ..storage import cut


def decode_stream(spark: SparkSession, path: str, out: str, checkpoint: str, profile: Profile) -> StreamingQuery:
    """Watch a folder of capture files; the frames of each batch of new files go to ``out``/frames (Parquet), the bad
    lines to ``out``/errors. A file is a whole capture, so no state goes from batch to batch; the checkpoint sees to
    it that each file is read once. Stops when all files that are there have been read."""
    root = edge_csv.root_of(spark, path)
    files = spark.readStream.format("text").load(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))

    def batch(rows: DataFrame, number: int) -> None:
        ranges = rows.select("file_path", "start", F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("value"))
        checked = cut(edge_csv.checked(edge_csv.range_lines(ranges, profile.charset, root)), "lines")
        frames = captures.decoded(edge_csv.edges_of(checked), profile)
        where = f"batch={number}"
        frames.select("capture_id", "frame_no", bytes_hex(F.col("bytes")).alias("hex"), "channel", "action", "valid", "start_t", "end_t").write.mode("overwrite").parquet(f"{out}/frames/{where}")
        edge_csv.csv_errors(checked).write.mode("overwrite").parquet(f"{out}/errors/{where}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
