"""SRC-3: image file catalog - the metadata the upload screen records.

Reads a folder with Spark's ``binaryFile`` source selecting only path,
length and modification time (the content column is pruned, so no file
bytes are read).  Accepted: a dot in the name, last extension in the
allowed set (case-insensitive), size within the upload limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Allowed extensions, upload limit (16 MiB), mime types.
ALLOWED_EXTENSIONS = ["png", "jpg", "jpeg", "gif"]
MAX_BYTES = 16 * 1024 * 1024
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif"}


def file_catalog(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ext = F.lower(F.substring_index(name, ".", -1))
    has_dot = F.instr(name, ".") > 0
    mime = F.lit(None).cast("string")
    for e, m in MIME.items():
        mime = F.when(ext == e, F.lit(m)).otherwise(mime)
    ok_ext = has_dot & ext.isin(ALLOWED_EXTENSIONS)
    return files.select(
        F.col("path"),
        name.alias("original_filename"),
        F.col("length").alias("file_size"),
        F.when(ok_ext, mime).alias("mime_type"),
        F.col("modificationTime").cast("timestamp_ntz").alias("upload_date"),
        (ok_ext & (F.col("length") <= max_bytes)).alias("accepted"),
        F.when(~ok_ext, F.lit("extension not allowed"))
        .when(F.col("length") > max_bytes, F.lit("file too large"))
        .alias("reject_reason"),
    )
