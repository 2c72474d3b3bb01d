"""Formats, media types and signatures of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import col, extension

#: Extension to format, format to media type, format to first bytes.
FORMATS = {".pdf": "pdf", ".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png", ".bmp": "bmp", ".tif": "tiff", ".tiff": "tiff", ".heif": "heif"}
MEDIA = {"pdf": "application/pdf", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tiff": "image/tiff", "heif": "image/heif"}
SIGNATURES = {"pdf": ("25504446",), "jpeg": ("FFD8FF",), "png": ("89504E470D0A1A0A",), "bmp": ("424D",), "tiff": ("49492A00", "4D4D002A")}


def _lookup(key: Column, values: dict[str, str], default: str | None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def detect_format(ref: Column | str) -> Column:
    return _lookup(extension(ref), FORMATS, "unknown")


def media_type(kind: Column | str) -> Column:
    return _lookup(col(kind), MEDIA, None)


def signature_matches(kind: Column | str, content: Column | str) -> Column:
    """HEIF is known by `ftyp` within the first 16 bytes, the others by their first bytes."""
    k, c = col(kind), col(content)
    fine = F.lit(False)
    for name, starts in SIGNATURES.items():
        for start in starts:
            fine = fine | ((k == name) & F.startswith(c, F.unhex(F.lit(start))))
    return fine | ((k == "heif") & F.contains(F.substring(c, 1, 16), F.unhex(F.lit("66747970"))))


def normalize(sources: DataFrame) -> DataFrame:
    """ref, content to format, content_type, document_id and error_type (null: fine).

    The format is judged before the bytes are looked at. An id is given only to accepted bytes.
    """
    kind = detect_format("ref")
    error = (
        F.when(kind == "unknown", "UnsupportedFormatError")
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, "EmptyContentError")
        .when(~signature_matches(kind, "content"), "SignatureMismatchError")
    )
    out = sources.withColumn("format", kind).withColumn("error_type", error)
    fine = F.col("error_type").isNull()
    return out.withColumn("content_type", F.when(fine, media_type("format"))).withColumn("document_id", F.when(fine, F.sha2("content", 256)))


def split_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and failures; a failure never stops the batch."""
    return rows.where("error_type IS NULL").drop("error_type"), rows.where("error_type IS NOT NULL")
