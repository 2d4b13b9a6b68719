"""Input discovery: files, folders, globs and manifests become a table of sources.

Listing goes through Spark's file source, so every store that Spark reads is served; only names
and lengths are read. What is collected are the items that the caller names, the paths of manifests and
the folders that their entries lie in, but no list of files. Whether a JSON file is a manifest is told by
its head alone, so a manifest must name its `inputs` or `files` there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.shared import written
from .archives import place

# Fixed values.
EXTENSIONS = {
    ".pdf": "PDF",
    ".jpg": "Image",
    ".jpeg": "Image",
    ".png": "Image",
    ".webp": "Image",
    ".tif": "Image",
    ".tiff": "Image",
    ".bmp": "Image",
    ".txt": "Text/OCR",
    ".md": "Text/OCR",
    ".html": "Text/OCR",
    ".hocr": "Text/OCR",
    ".xml": "Text/OCR",
    ".json": "Text/OCR",
    ".zip": "Archive",
    ".csv": "Manifest",
}
SCHEMA = "item double, root string, path string, length bigint"


def clean_item(item: str) -> str:
    """Quotes off both ends, and forward slashes."""
    return item.strip().strip("\"'").replace("\\", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(list(EXTENSIONS))


def _listed(spark: SparkSession, path: str, recursive: bool) -> DataFrame | None:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        return reader.load(path).select("path", "length")
    except Exception as problem:  # Spark says by its message alone that a path is missing
        if "PATH_NOT_FOUND" in str(problem) or "does not exist" in str(problem):
            return None
        raise


#: Manifests that name manifests are followed so deep.
DEPTH = 8
#: Bytes of a JSON file that are looked at to tell a manifest.
HEAD_BYTES = 1 << 16


def discover(spark: SparkSession, items: list[str], recursive: bool = True) -> tuple[DataFrame, list[str]]:
    """(sources, missing): sources in order of the items, each path once, with label, kind and status.

    A source is `ok` or, by its extension, `unsupported`. Labels are the folder's name and the path
    below it, or the file's name. Manifests among the items and in folders are followed: their
    entries stand in their place, and each manifest is read once.
    """
    parts, missing, read = [], [], set()

    def add(todo: list[str], depth: int) -> None:
        for item in map(clean_item, todo):
            found = _listed(spark, item, recursive)
            if found is None:
                missing.append(item)
                continue
            root = "" if re.search(r"[*?\[]", item) else item.rstrip("/")
            n = len(parts)
            manifests = written(_manifests(found), "manifests")
            plain = found.join(manifests, "path", "left_anti")
            parts.append(plain.select(F.lit(n).alias("item"), F.lit(root).alias("root"), "path", "length"))
            # Manifests are control files: a run has few of them, whatever they name.
            for path in sorted(r["path"] for r in manifests.collect()):
                if path not in read and depth < DEPTH:
                    read.add(path)
                    follow(path, depth)

    def follow(path: str, depth: int) -> None:
        """Entries of a manifest: files by listing their folders once, what else they are one by one."""
        entries = written(read_manifest(spark, path).withColumnRenamed("path", "entry"), "entries")
        folders = [r["f"] for r in entries.select(F.regexp_extract("entry", "^(.*)/[^/]*$", 1).alias("f")).distinct().collect()]
        listed = [x for x in (_listed(spark, f, False) for f in sorted(folders)) if x is not None]
        nothing = spark.createDataFrame([], "path string, length bigint")
        files = written(reduce(DataFrame.unionByName, listed, nothing).withColumn("_plain", _plain(F.col("path"))), "files")
        known = entries.withColumn("_entry", _plain(F.col("entry"))).join(files, F.col("_entry") == F.col("_plain"), "left")
        manifests = written(_manifests(known.where(F.col("path").isNotNull()).select("path", "length")), "manifests")
        own = known.where(F.col("path").isNotNull()).join(manifests, "path", "left_anti")
        n = len(parts)
        # Entries stand in the manifest's order, each a root of its own, as if given alone.
        parts.append(own.select((F.lit(n) + (F.col("pos") + 1) / (1 << 40)).alias("item"), F.col("entry").alias("root"), "path", "length"))
        rest = known.where(F.col("path").isNull()).select("entry", "pos").unionByName(
            known.join(manifests, "path", "left_semi").select("entry", "pos")
        )
        # Folders, patterns, other manifests and what is missing: few beside the files.
        add([r["entry"] for r in rest.orderBy("pos").collect()], depth + 1)

    add(items, 0)
    if not parts:
        return _finish(spark.createDataFrame([], SCHEMA)), missing
    return _finish(reduce(DataFrame.unionByName, parts)), missing


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def _manifests(found: DataFrame) -> DataFrame:
    """(path) of the manifests among listed files: by name, or by the head of a JSON file, of which no more is read."""
    named = found.where(_named(F.col("path"))).select("path")
    maybe = found.where(F.lower("path").endswith(".json") & ~_named(F.col("path"))).select("path")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path in batch.column("path").to_pylist():
                source, at = place(path)
                with source.open_input_file(at) as f:
                    texts.append(f.read(HEAD_BYTES).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], ["path", "head"])

    looked = maybe.mapInArrow(heads, "path string, head string")
    return named.unionByName(looked.where(is_manifest(F.col("path"), F.col("head"))).select("path"))


def _finish(found: DataFrame) -> DataFrame:
    plain = _plain(F.col("path"))
    name = F.element_at(F.split("root", "/"), -1)
    below = F.when((F.col("root") != "") & plain.startswith(F.concat("root", F.lit("/"))), F.substring(plain, F.length("root") + 2, F.length(plain)))
    label = F.when(below.isNotNull(), F.concat(name, F.lit("/"), below)).otherwise(F.element_at(F.split(plain, "/"), -1))
    first = W.partitionBy("path").orderBy("item")
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return (
        found.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select(
            "item", plain.alias("path"), "length", label.alias("label"), extension(F.col("path")).alias("ext"),
            F.try_element_at(kinds, extension(F.col("path"))).alias("kind"),
            F.when(is_supported(F.col("path")), "ok").otherwise("unsupported").alias("status"),
        )
    )


def is_manifest(path: Column, head: Column) -> Column:
    """Any CSV, a file so named, a JSON list, or an object with inputs or files."""
    sniff = F.lower(path).endswith(".json") & (F.ltrim(head).startswith("[") | head.rlike(r'(?s)^\s*\{.*"(?:inputs|files)"\s*:\s*\['))
    return _named(path) | sniff


def _named(path: Column) -> Column:
    return F.lower(path).endswith(".csv") | F.lower(path).endswith(".manifest.json")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, path): entries of a CSV or JSON manifest, relative ones taken from its folder.

    Both kinds are read whole by one task, as quoted cells may hold line ends, so `pos` is the place.
    """
    folder = path.rsplit("/", 1)[0]
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
        named = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for want in ("path", "file", "input") for c in rows.columns if c.strip().lower() == want]
        entry = F.coalesce(*named) if named else F.lit(None).cast("string")
        entries = rows.select(F.monotonically_increasing_id().alias("pos"), entry.alias("entry"))
    else:
        text = spark.read.text(path, wholetext=True)
        value = F.trim("value")
        listed = F.when(value.startswith("["), value).otherwise(
            F.coalesce(F.get_json_object(value, "$.inputs"), F.get_json_object(value, "$.files"))
        )
        items = text.select(F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "item"))
        entry = F.coalesce(F.get_json_object("item", "$.path"), F.when(~F.col("item").startswith("{"), F.col("item")))
        entries = items.select("pos", F.nullif(F.trim(entry), F.lit("")).alias("entry"))
    slashed = F.translate("entry", "\\", "/")
    absolute = slashed.startswith("/") | slashed.rlike("^[a-z0-9]+://")
    return entries.where(F.col("entry").isNotNull()).select(
        "pos", F.when(absolute, slashed).otherwise(F.concat(F.lit(folder + "/"), slashed)).alias("path")
    )
