"""Embedded pictures and file signatures."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CFBF_MAGIC,
    DATA_URL_PREFIX,
    DEFAULT_IMAGE_EXTENSION,
    MIN_IMAGE_SIZE,
    PDF_FILTER_EXTENSIONS,
    SNIFF_BYTES,
    WORD_MARKERS,
    ZIP_MAGIC,
)
from ..functions.pictures import picture_header, shows_something
from ..plans.lineage import settled


def is_legacy_doc(content: Column, path: Column) -> Column:
    """Whether a file is an old binary DOC: compound-file magic and a Word marker near the start.

    A file without readable content is judged by its extension.
    """
    head = F.substring(content, 1, SNIFF_BYTES)
    marked = reduce(or_, [F.contains(head, F.lit(m)) for m in WORD_MARKERS])
    # A ZIP container fails the compound-file test as well; no separate check.
    by_content = (F.substring(content, 1, len(CFBF_MAGIC)) == F.lit(CFBF_MAGIC)) & marked
    return F.when(content.isNull(), F.endswith(F.lower(path), F.lit(".doc"))).otherwise(by_content)


def sniff_format(files: DataFrame) -> DataFrame:
    """Adds ``format``: ``doc``, ``zip`` (DOCX containers) or ``other``."""
    content = F.col("content")
    return files.withColumn(
        "format",
        F.when(is_legacy_doc(content, F.col("path")), "doc")
        .when(F.substring(content, 1, len(ZIP_MAGIC)) == F.lit(ZIP_MAGIC), "zip")
        .otherwise("other"),
    )


def base64_text(content: Column) -> Column:
    """Base64 on one line (Spark breaks it after 76 characters)."""
    return F.translate(F.base64(content), "\r\n", "")


def data_url(content: Column) -> Column:
    """The content as a data URL."""
    return F.concat(F.lit(DATA_URL_PREFIX), base64_text(content))


def pdf_extension(filter_name: Column) -> Column:
    """File extension for a PDF stream filter."""
    known = [F.when(filter_name == name, F.lit(ext)) for name, ext in PDF_FILTER_EXTENSIONS.items()]
    return F.coalesce(*known, F.lit(DEFAULT_IMAGE_EXTENSION))


def pdf_asset_name(page: Column, content: Column, filter_name: Column) -> Column:
    """``pdf_p<page>_img_<md5 start>.<ext>``."""
    return F.concat(F.lit("pdf_p"), page.cast("string"), F.lit("_img_"), _digest(content),
                    F.lit("."), pdf_extension(filter_name))


def docx_asset_name(content: Column, image_format: Column) -> Column:
    """``docx_img_<md5 start>.<ext>``."""
    extension = F.coalesce(F.lower(image_format), F.lit(DEFAULT_IMAGE_EXTENSION))
    return F.concat(F.lit("docx_img_"), _digest(content), F.lit("."), extension)


def with_picture_header(assets: DataFrame) -> DataFrame:
    """Adds ``format``, ``width`` and ``height`` read from the picture's own header."""

    @F.arrow_udf("format string, width int, height int")
    def header(contents: pa.Array) -> pa.Array:
        # One content at a time is Python's.
        rows = [picture_header(c.as_py()) for c in contents]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = {"format": pa.string(), "width": pa.int32(), "height": pa.int32()}
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return assets.withColumn("header", header("content")).select(*assets.columns, "header.*")


def is_valid_asset(width: Column, height: Column, min_size: int = MIN_IMAGE_SIZE) -> Column:
    """Large enough on both sides; pictures without readable size are not valid."""
    return F.coalesce((width >= min_size) & (height >= min_size), F.lit(False))


def is_visible(content: Column) -> Column:
    """Whether a picture is not blank: a PNG with any sample but zero, or a picture of another format."""

    @F.arrow_udf("boolean")
    def visible(contents: pa.Array) -> pa.Array:
        return pa.array([shows_something(c.as_py()) for c in contents], pa.bool_())

    return visible(content)


def valid_assets(assets: DataFrame, min_size: int = MIN_IMAGE_SIZE) -> DataFrame:
    """The pictures (``content, width, height``) that are large enough and not blank; small ones are not unpacked."""
    large = assets.where(is_valid_asset(F.col("width"), F.col("height"), min_size))
    return large.where(is_visible(F.col("content")))


def has_pixels(data: Column) -> Column:
    """Whether decoded pixel data (the ``image`` source's) is not all zero."""
    blank = F.lpad(F.lit(b""), F.length(data), F.lit(b"\x00"))
    return F.coalesce(data != blank, F.lit(False))


def valid_images(images: DataFrame, min_size: int = MIN_IMAGE_SIZE) -> DataFrame:
    """Rows of the ``image`` source that decode, are large enough and not blank."""
    image = F.col("image")
    return images.where(is_valid_asset(image["width"], image["height"], min_size) & has_pixels(image["data"]))


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """The first asset by ``(path, name)`` of every distinct content, with ``md5``.

    Keys first: contents are written once with a number and their digest, the
    least ``(path, name)`` per digest is chosen from keys alone (combined before
    the shuffle, so a picture that a third of all documents carry is no hot
    group), and the chosen numbers fetch their rows.  No content is aggregated
    or sorted.
    """
    numbered = settled(assets.withColumn("md5", F.md5("content")).withColumn("_number", F.monotonically_increasing_id()), "assets")
    order = F.struct("path", "name", "_number")
    chosen = numbered.groupBy("md5").agg(F.min(order)["_number"].alias("_number")).select("_number")
    return numbered.join(chosen.hint("shuffle_hash"), "_number", "left_semi").drop("_number")


def _digest(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 8)
