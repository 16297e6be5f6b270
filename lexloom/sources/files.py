"""Files as rows: their type by content, content-addressed keys, load requests, and a sink that writes each content once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIFFED = 1024


def mime(content: Column) -> Column:
    """application/pdf or text/html by the first bytes; null for anything else."""
    head = F.substring(content, 1, SNIFFED)
    text = F.lower(F.trim(F.regexp_replace(F.decode(head, "ISO-8859-1"), "^\\u00ef\\u00bb\\u00bf", "")))
    return F.when(F.instr(text, "%pdf-").between(1, SNIFFED), "application/pdf").when(text.rlike("^\\s*(<!--.*?-->\\s*)*<(!doctype html|html|head|body)"), "text/html")


def raw_key(digest: Column) -> Column:
    return F.concat(F.lit("raw/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def valid_key(key: Column) -> Column:
    """Whether a key is relative, without `..`, empty parts, backslashes and NULs."""
    return (key != "") & ~key.rlike(r"(^/)|(/$)|(//)|(\\)|(\x00)|((^|/)\.\.(/|$))")


def file_name(name: Column) -> Column:
    """A name of safe characters, at most 120 of them."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, 120)


def checked_requests(requests: DataFrame) -> DataFrame:
    """requests (url, file, object_key, title) with `problem`, null where just one of the three is given, and a title."""
    given = sum((F.col(c).isNotNull().cast("int") for c in ("url", "file", "object_key")), F.lit(0))
    last = F.element_at(F.split(F.coalesce("file", "object_key", "url"), "/"), -1)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""), F.lit("")), F.lit("untitled"))
    return requests.withColumn("problem", F.when(given != 1, F.concat(F.lit("given: "), given.cast("string")))).withColumn("title", title)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below <root>/<source>/<doc_type>/ with digest, key and type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    digest = F.sha2("content", 256)
    return files.select("path", F.element_at(parts, -3).alias("source"), F.element_at(parts, -2).alias("doc_type"), "length", "modificationTime", digest.alias("digest"), raw_key(digest).alias("key"), mime(F.col("content")).alias("mime"), "content")


def watched(spark: SparkSession, root: str, archive: str | None = None, oldest: str = "7d") -> DataFrame:
    """A stream of the files that come to <root>/<source>/<doc_type>/; where an archive is given, files that were read are moved there."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFileAge", oldest)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = stream.load(f"{root}/*/*")
    parts = F.split("path", "/")
    digest = F.sha2("content", 256)
    return files.select("path", F.element_at(parts, -3).alias("source"), F.element_at(parts, -2).alias("doc_type"), "length", "modificationTime", digest.alias("digest"), mime(F.col("content")).alias("mime"), "content")


def stored(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(key, length) of the objects below a prefix of a store, in the order of their keys; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{prefix}")
    return files.select(F.substring_index("path", root.rstrip("/").rpartition("/")[2] + "/", -1).alias("key"), "length").orderBy("key")


def write_once(files: DataFrame, path: str) -> None:
    """Store each content once, in folders by the first two digits of its digest, however often this is run."""
    new = files.dropDuplicates(["digest"])
    try:
        new = new.join(files.sparkSession.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    new.select(*files.columns).withColumn("prefix", F.substring("digest", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
