"""Files as rows: listing, text, DOCX text and embedded pictures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DOC_TYPES
from ..functions.docx import docx_media, docx_text
from ..operators.assets import docx_asset_name, is_legacy_doc, with_picture_header
from ..plans.lineage import settled

TEXT_TYPES = ("text", "json", "yaml")
LENGTH_LIMIT = "spark.sql.sources.binaryFile.maxLength"

DOCX_TEXT_SCHEMA = "path string, text string, status string, error string"
MEDIA_SCHEMA = "path string, member string, place int, content binary"


def doc_type(path: Column, types: Mapping[str, str] = DOC_TYPES) -> Column:
    """Document type by file extension (any case), null for others."""
    extension = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    pairs = [F.lit(part) for pair in types.items() for part in pair]
    return F.create_map(*pairs)[extension]


def discover(spark: SparkSession, directory: str, types: Mapping[str, str] = DOC_TYPES,
             only: Sequence[str] | None = None, hidden: Hidden | None = None) -> DataFrame:
    """Supported files under a directory: ``path, doc_type, length, modificationTime, content``.

    The directory is any path that Spark reads, relative ones included.
    ``only`` restricts the document types.  Other files drop out while listing:
    a filter on the rows would come after their contents have been read.
    ``content`` itself is read only where it is selected.

    Spark's listing leaves out names that begin with ``_`` or ``.``.  Such
    folders are listed as roots of their own, and such files read one by one;
    ``hidden`` has them if they are known already (see :func:`hidden_names`).
    """
    wanted = {ext: kind for ext, kind in types.items() if only is None or kind in only}
    hidden = hidden or hidden_names(spark, directory)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
            .option("pathGlobFilter", extension_glob(wanted)).load([directory, *hidden.folders])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"Directory not found: {directory}") from error
    if hidden.files is not None:
        paths = hidden.files.where(doc_type(F.col("path"), wanted).isNotNull()).select("path")
        files = files.unionByName(paths.mapInPandas(read_one_by_one(limit_of(spark)), files.schema))
    return files.withColumn("doc_type", doc_type(F.col("path"), wanted))


class Hidden(NamedTuple):
    """Names under a directory that Spark's listing leaves out: the folders, and a table of files (``path``)."""

    folders: list[str]
    files: DataFrame | None


def hidden_names(spark: SparkSession, directory: str) -> Hidden:
    """Folders and files under a directory, at any depth, whose names begin with ``_`` or ``.``.

    The tree is walked on the executors, a level at a time with a row per folder;
    only hidden folders come to the driver, as Spark's reader takes roots from
    there.  Nothing is found where the store has no client in Python; Spark then
    reads all but hidden names.
    """
    root = qualified(spark, directory)
    try:
        opened(root)
    except (pa.ArrowException, OSError, NotImplementedError):
        return Hidden([], None)
    level, found = spark.createDataFrame([(root,)], "path string"), []
    while not level.isEmpty():
        listed = settled(level.mapInPandas(list_folders, LISTED), "listing")
        found.append(listed)
        level = listed.where("folder").select("path").repartition(F.col("path"))
    hidden = reduce(DataFrame.unionByName, found).where("hidden") if found else None
    if hidden is None or hidden.isEmpty():
        return Hidden([], None)
    return Hidden([r.path for r in hidden.where("folder").collect()], hidden.where("NOT folder").select("path").repartition(F.col("path")))


LISTED = "path string, folder boolean, hidden boolean"
LISTED_ROWS = 10_000


def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The folders, and the hidden files, that lie directly in the given folders; other files only have to be read."""
    for batch in batches:
        for folder in batch["path"]:
            store, name = opened(folder)
            try:
                inside = store.get_file_info(fs.FileSelector(name))
            except (FileNotFoundError, NotADirectoryError):
                continue
            rows = [(f"{folder.rstrip('/')}/{x.base_name}", x.type == fs.FileType.Directory, x.base_name.startswith(("_", "."))) for x in inside]
            rows = [row for row in rows if row[1] or row[2]]
            for lo in range(0, len(rows), LISTED_ROWS):
                yield pd.DataFrame(rows[lo:lo + LISTED_ROWS], columns=["path", "folder", "hidden"])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and all folders above it, as the file system that Spark is configured with has it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


# Schemes of Spark's clients that Python's client has under another name.
CLIENT_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{CLIENT_SCHEMES.get(scheme, scheme)}:{rest}")


def read_one_by_one(limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of the ``binaryFile`` source for given paths; a file beyond the limit is not read and has no content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, name = opened(path)
                info = store.get_file_info(name)
                content = None
                if info.size <= limit:
                    with store.open_input_stream(name) as stream:
                        content = stream.read()
                yield pd.DataFrame({"path": [path], "modificationTime": [pd.Timestamp(info.mtime)], "length": [info.size], "content": [content]})

    return read


def limit_of(spark: SparkSession) -> int:
    return int(spark.conf.get(LENGTH_LIMIT))


def within_limit(files: DataFrame) -> Column:
    """Whether Spark reads a file: a larger one would end the whole job."""
    return F.col("length") <= limit_of(files.sparkSession)


def extension_glob(extensions: Iterable[str]) -> str:
    """A glob for file names with one of the extensions, in any case."""
    any_case = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in extensions)
    return "*.{" + ",".join(any_case) + "}"


def read_text_files(files: DataFrame) -> DataFrame:
    """Text, JSON and YAML files as ``path, text, status, error``."""
    return files.where(F.col("doc_type").isin(*TEXT_TYPES) & within_limit(files)).select(
        "path", F.col("content").cast("string").alias("text"), F.lit("read").alias("status"), F.lit(None).cast("string").alias("error"))


def read_docx(files: DataFrame) -> DataFrame:
    """DOCX files as ``path, text, status, error``; an unreadable one fails alone."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, legacy in zip(batch["path"], batch["content"], batch["legacy"]):
                try:
                    rows.append((path, None, "failed", "no decoder for doc") if legacy else (path, docx_text(content), "read", None))
                except Exception as error:
                    rows.append((path, None, "failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "text", "status", "error"])

    content = F.col("content")
    found = files.where(F.col("doc_type") == "docx")
    found = found.where(within_limit(files)) if "length" in files.columns else found
    legacy = content.isNotNull() & is_legacy_doc(content, F.col("path"))
    return found.select("path", "content", legacy.alias("legacy")).mapInPandas(parse, DOCX_TEXT_SCHEMA)


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """All supported files of a directory as ``path, doc_type, text, status, error``.

    Types that need an outside decoder (PDF, video, audio) and files too large
    to read come out as failed, without their contents being read.
    """
    undecoded = [t for t in dict.fromkeys(DOC_TYPES.values()) if t not in (*TEXT_TYPES, "docx")]
    hidden = hidden_names(spark, directory)
    text, docx, rest = (discover(spark, directory, only=kinds, hidden=hidden) for kinds in (TEXT_TYPES, ["docx"], undecoded))
    other = _failed(rest, F.concat(F.lit("no decoder for "), "doc_type"))
    size = F.concat(F.lit("too large to read: "), F.col("length").cast("string"), F.lit(" bytes"))
    large = [_failed(files.where(~within_limit(files)), size) for files in (text, docx)]
    rows = read_text_files(text).unionByName(read_docx(docx)).unionByName(other)
    return rows.unionByName(large[0]).unionByName(large[1]).withColumn("doc_type", doc_type(F.col("path")))


def _failed(files: DataFrame, error: Column) -> DataFrame:
    return files.select("path", F.lit(None).cast("string").alias("text"), F.lit("failed").alias("status"), error.alias("error"))


#: Bytes of pictures that leave a Python worker at once, unless a single picture is larger.
MEDIA_BATCH = 8 << 20


def explode_docx_media(files: DataFrame) -> DataFrame:
    """Embedded pictures of DOCX files: ``path, member, place, content, format, width, height, name``."""

    kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("place", pa.int32()), ("content", pa.binary())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            # Archives are taken from Arrow one at a time, pictures unpacked one at a
            # time: together they may be far larger than the files.
            for path, archive in zip(batch.column("path"), batch.column("content"), strict=True):
                for place, (member, content) in enumerate(docx_media(archive.as_py())):
                    if rows and held + len(content) > MEDIA_BATCH:
                        yield media_batch(rows, kinds)
                        rows, held = [], 0
                    rows.append((path.as_py(), member, place, content))
                    held += len(content)
        yield media_batch(rows, kinds)

    packed = files.where(F.col("doc_type") == "docx").select("path", "content")
    media = with_picture_header(packed.mapInArrow(explode, MEDIA_SCHEMA))
    return media.withColumn("name", docx_asset_name(F.col("content"), F.col("format")))


def media_batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    """Picture files decoded by Spark's ``image`` source; undecodable ones are dropped."""
    return spark.read.format("image").option("dropInvalid", "true") \
        .option("recursiveFileLookup", "true").load(directory)
