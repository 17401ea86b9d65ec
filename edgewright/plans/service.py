"""One uploaded capture to one workbook, with the errors and the log line that a service needs."""

from __future__ import annotations

import logging
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..errors import CaptureError
from ..sources import edge_csv, report, workbook
from . import captures

log = logging.getLogger(__name__)


def _size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.isFile(where):
        raise CaptureError("INVALID_REQUEST")
    return fs.getFileStatus(where).getLen()


def parse_capture(spark: SparkSession, path: str, config_key: str, out_dir: str, config: Config | None = None) -> str:
    """Decode the capture file ``path`` and write its report below ``out_dir``; returns the report's path.

    The configuration is resolved before the file is looked at. Errors carry the code of the step that failed. The log
    gets the file's name, the profile, the time taken and the kind of failure, never what a capture holds.
    """
    began, name, failure = time.time(), path.replace("\\", "/").rsplit("/", 1)[-1], None
    try:
        profile = (config or load_config()).profile(config_key)
        name = edge_csv.check_upload(name, _size(spark, path))
        try:
            edges = edge_csv.read_edges(spark, path, profile.charset, strict=True)
            edges = captures.cut(edges, "edges")
        except PySparkException as e:  # text that is not in the profile's charset
            raise CaptureError("CSV_READ_FAILED") from e
        try:
            result = captures.decode_edges(edges, profile)
            known = spark.createDataFrame([(name,)], "capture_id string")
            summary = known.join(result.summary.withColumn("capture_id", F.lit(name)), "capture_id", "left").fillna(0)
            views = report.result_view(result.frames, profile), report.summary_view(summary, profile), result.fragments
            views = tuple(captures.cut(v, "view") for v in views)
        except PySparkException as e:
            raise CaptureError("PROTOCOL_PARSE_FAILED") from e
        try:
            workbook.save(*views, out_dir)
        except (PySparkException, OSError) as e:
            raise CaptureError("EXCEL_GENERATION_FAILED") from e
        return f"{out_dir}/{report.download_name(name)}"
    except CaptureError as e:
        failure = e.code
        raise
    except Exception as e:
        failure = type(e).__name__
        raise CaptureError("INTERNAL_ERROR") from e
    finally:
        log.info("capture file=%s config=%s elapsedMs=%d result=%s", name, config_key, (time.time() - began) * 1000, failure or "ok")
