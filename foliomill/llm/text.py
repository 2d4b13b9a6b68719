"""Expressions and session helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators understand it: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, with null taken as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast path serves pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def digest(key: Column) -> Column:
    """128 bits that stand for a string in shuffles."""
    return F.unhex(F.md5(key))


def words(text: Column, separators: str = SPACE_RUN) -> Column:
    return F.array_remove(F.split(text, separators), "")


def let(value: Column, body) -> Column:
    """Bind a value once: a lambda evaluates outer expressions again for each element."""
    return F.transform(F.array(value), body)[0]


def row_key(text: str = "text", *others: str) -> Column:
    """128 bits that stand for a row: for its text and the other columns, null apart from empty there.

    Rows that share a doc_id, or have none, are told apart by it; rows equal in all these columns
    share it, and everything that is found out about them is equal too.
    """
    known = [F.col(c).cast("string") for c in others]
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in known]
    return digest(F.concat(*marked, whole(text)))


def named(name: str) -> Column:
    """The column of this name, dots and quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered_names(df: DataFrame) -> DataFrame:
    """The columns under plain names, which functions over Arrow batches need; toDF() gives theirs back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as no column of the frame has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Local mode has one machine, whose own temporary folder serves where none is named; a cluster
    without a shared folder is an error, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = spark.sparkContext._jvm.java.nio.file.Files.createTempDirectory(
        "foliomill-", spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)
    ).toString()
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back, so that lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a Parquet table: smaller, and with statistics that the planner trusts.

    The table goes when the application ends, or earlier by forget().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliomill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Written tables of at most so many bytes may go to every executor.
BROADCAST_BYTES = 16 << 20


def sent(frame: DataFrame, *arrays: str) -> DataFrame:
    """A written table, marked for every executor while its rows take few bytes, else as it is.

    A row counts as 48 bytes, and 16 for each element of the named arrays; the sizes come from the
    table itself, not from an estimate.
    """
    held = F.lit(48).cast("long")
    for name in arrays:
        held = held + 16 * F.greatest(F.size(name), F.lit(0))
    size = frame.agg(F.sum(held)).first()[0] or 0
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def forget(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again, lost executors included."""
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
