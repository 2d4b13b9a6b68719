"""Pages, blocks, replies and runs projected from plain tables, the same way in Spark and in SQL.

Each query of the catalogue works on one of these, so that operators on pages and layouts can run
over tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines put before documents, by doc_id, so that every rule of the role classifier is met.
KEYWORD_LINES = (
    "Table of contents", "PREFACE", "Abstract", "Works cited", "The index of names", "Appendix",
    "Chapter one", "Section two", "Masthead and volume", "Editorial", "Classifieds", "Continued from before",
    "GREAT FIRE IN HARBOUR", "Folio 12 recto", "Colophon", "Dear madam", "Yours sincerely", "Folder no 7",
    "Dated register", "This agreement", "Whereas", "Balance sheet", "Invoice", "Grand total",
    "Patient report", "Dosage", "Policy coverage", "[image: plate | a.png]", "xii", "Plain words",
)
TYPES = (
    "Book", "Manuscript", "Newspaper", "Magazine", "Journal article", "Letter", "Archive bundle", "Legal document",
    "Finance document", "Healthcare document", "Insurance document", "General",
)


#: What one core reads at least before it is worth while to keep a table's own splits.
SPLIT_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A small table's rows dealt over all cores, for projections that cost more than this shuffle.

    A Parquet file is split by row groups only, so a small table has fewer tasks than there are cores,
    often one. By the planner's estimate of its size, a table with `SPLIT_BYTES` or more for each core
    has splits enough and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def zipped(docs: DataFrame, size: int = 100) -> DataFrame:
    """(path, part, content): zip archives of `size` documents each, a member for every document."""
    import io
    import zipfile

    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for doc, lang, text in zip(rows["doc_id"], rows["lang"], rows["text"]):
                z.writestr(zipfile.ZipInfo(f"{lang}/{doc}.txt", (2020, 1, 1, 0, 0, 0)), text or "", zipfile.ZIP_DEFLATED)
        return pd.DataFrame([(f"{rows['archive'].iloc[0]:06d}.zip", 0, out.getvalue())], columns=["path", "part", "content"])

    grouped = docs.select("doc_id", "lang", "text", F.floor(F.col("doc_id") / size).alias("archive")).groupBy("archive")
    return grouped.applyInPandas(pack, "path string, part long, content binary")


def keyed_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, document_type, text): a keyword line before each document."""
    line = F.get(F.array(*map(F.lit, KEYWORD_LINES)), (F.col("doc_id") % len(KEYWORD_LINES)).cast("int"))
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.floor(F.col("doc_id") / len(KEYWORD_LINES)) % len(TYPES)).cast("int"))
    return docs.select(
        "doc_id", (F.col("doc_id") % 7).cast("int").alias("page_index"), kind.alias("document_type"),
        F.concat(line, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"), "lang", "source",
    )


def table_pages(lineitem: DataFrame) -> DataFrame:
    """(page, text): the lines of each order as rows with bars."""
    row = F.concat_ws(" | ", F.lit("item"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"])
    return lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(listed, "\n").alias("text"))


def contents_pages(part: DataFrame) -> DataFrame:
    """(page, text): part names of a brand with leaders and sizes."""
    row = F.concat(F.col("p_name"), F.lit(" ..... "), F.col("p_size").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"])
    return part.groupBy(F.col("p_brand").alias("page")).agg(F.array_join(listed, "\n").alias("text"))


def boxes(lineitem: DataFrame) -> DataFrame:
    """Blocks of pages of 1000 by 1500, one for each line of an order."""
    left, top = (F.col("l_partkey") % 900).cast("int"), (F.col("l_suppkey") * 37 % 1400).cast("int")
    # Sides are rounded half even, as SQL's cast does; Spark's drops the fraction.
    w = F.least(F.lit(1000) - left, F.rint(F.col("l_quantity") * 18).cast("int") + 20)
    h = F.least(F.lit(1500) - top, F.rint(F.col("l_quantity") * 9).cast("int") + 12)
    return lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), left.alias("left"), top.alias("top"),
        (left + w).alias("right"), (top + h).alias("bottom"), w.alias("block_width"), h.alias("block_height"), F.lit(1000).alias("page_width"), F.lit(1500).alias("page_height"),
        (F.col("l_discount") * 5).alias("dark_ratio"), (F.col("l_tax") * 2).alias("mid_ratio"),
    )


def distinct_boxes(lineitem: DataFrame) -> DataFrame:
    """One box for each page and block number, the first by its place."""
    found = boxes(lineitem)
    rest = ["left", "top", "right", "bottom", "dark_ratio", "mid_ratio", "page_width", "page_height", "block_width", "block_height"]
    return found.groupBy("page", "block").agg(F.min(F.struct(*rest)).alias("b")).select("page", "block", "b.*")


#: Rasters that a task holds at once, of 60 kB each.
DRAWN = 64


def rasters(lineitem: DataFrame, step: int) -> DataFrame:
    """(page, width, height, gray): pages of 200 by 300 with each box drawn as lines `step` pixels apart.

    A batch of rows has up to 10,000 pages, whose rasters are handed on a few at a time.
    """
    import numpy as np
    import pyarrow as pa

    def draw(batches):
        for batch in batches:
            for i in range(0, len(batch), DRAWN):
                part = batch.slice(i, DRAWN)
                made = []
                for boxes in part.column("boxes").to_pylist():
                    gray = np.full((300, 200), 255, np.uint8)
                    for x in boxes:
                        gray[x["top"] // 5 : x["bottom"] // 5 : step, x["left"] // 5 : x["right"] // 5] = 40
                    made.append(gray.tobytes())
                n = len(made)
                columns = [part.column("page"), pa.array([200] * n, pa.int32()), pa.array([300] * n, pa.int32()), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["page", "width", "height", "gray"])

    listed = boxes(lineitem).groupBy("page").agg(F.collect_list(F.struct("left", "top", "right", "bottom")).alias("boxes"))
    # The lists are small and their rasters are not: dealt over all cores, as small partitions would be united.
    listed = listed.repartition(max(lineitem.sparkSession.sparkContext.defaultParallelism, 1) * 4)
    return listed.mapInArrow(draw, "page bigint, width int, height int, gray binary")


def replies(docs: DataFrame) -> DataFrame:
    """(doc_id, source_text, reply): model replies of several shapes, by doc_id."""
    text = F.coalesce("text", F.lit(""))
    body = F.to_json(F.struct(text.alias("restored_text"), F.lit("checked").alias("notes")))
    n = F.col("doc_id") % 6
    reply = (
        F.when(n == 0, body)
        .when(n == 1, F.concat(F.lit("<think>role: none {x}</think>"), body))
        .when(n == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n == 3, F.lit('{"restored_text": " . ", "status": "restored", "failure_reason": ""}'))
        .when(n == 4, F.concat(F.lit("Task: repeat the text. "), text))
        .otherwise(text)
    )
    return docs.select("doc_id", text.alias("source_text"), reply.alias("reply"))


def marked_replies(docs: DataFrame) -> DataFrame:
    """(doc_id, reply): whole documents behind block markers, the rest of the lines in the last; one number comes twice."""
    part = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def at(i: int) -> F.Column:
        return F.coalesce(F.get(part, F.lit(i)), F.lit(""))

    rest = F.array_join(F.slice(part, F.lit(4), F.size(part)), "\n")
    return docs.select(
        "doc_id",
        F.concat(F.lit("[BLOCK 1] "), at(0), F.lit("\n[block #2]"), at(1), F.lit("[BLOCK 3]"), at(2), F.lit("\n[BLOCK 2]\n"), rest).alias("reply"),
    )


def usage(events: DataFrame) -> DataFrame:
    """Units of work by user: token counts, and failures for errors."""
    n = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    return events.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), n.alias("prompt_tokens"), (n * 2).alias("completion_tokens"),
        (n * 3).alias("total_tokens"), (n > 90).alias("truncated"),
        F.when(F.col("event_type").isin("error", "signup"), F.concat(F.lit("failed in "), F.col("event_type"))).otherwise("").alias("failure_reason"),
        "event_type",
    )
