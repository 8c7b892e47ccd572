"""Reading, materialising and splitting of document tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes nothing but these characters: the contract's white space [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"

#: A word as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for those that do not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    context.addPyFile(str(archive))  # the driver serves it; executors need no access to the folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir``; where that is unset, as in tests, a folder of its own
    in the warehouse, which is shared as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a table that may be broadcast.
BROADCAST = 1 << 16


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has no more than BROADCAST rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def row_key(text: Column, *cols: Column) -> Column:
    """What decisions about a row are looked up by: its text, by 256 bits, and the values of ``cols``; never null."""
    parts = [x for i, c in enumerate(cols) for x in (c.isNull().alias(f"n{i}"), F.coalesce(c.cast("string"), F.lit("")).alias(f"v{i}"))]
    return F.struct(*parts, F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256).alias("text"))


def spread(spark: SparkSession) -> int:
    """Number of groups or buckets that rows are dealt into: twice the shuffle partitions, so that partitions even out."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(n: int, *cols: Column) -> Column:
    """Deterministic bucket 0..n-1 of the columns' values; repeated rows share a bucket."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


#: Bytes of text in a group of documents: no group is meant to hold less than the first, nor more than the second.
GROUP_LEAST, GROUP_MOST = 8 << 20, 128 << 20


def group_count(docs: DataFrame, text_col: str = "text") -> int:
    """Number of groups, and of buckets, for messages between them (see packed.py).

    As many as ``spread`` says, but no more than groups of GROUP_LEAST bytes of text allow, since
    messages grow with groups times buckets, and no fewer than groups of GROUP_MOST bytes need.
    The bytes are counted, as estimates can be far off.
    """
    size = int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)
    return max(4, min(spread(docs.sparkSession), size // GROUP_LEAST), size // GROUP_MOST)


def groups_of(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(grp, doc_id, text): documents dealt by id and text into n groups that one task can hold."""
    text = F.col(text_col).cast("string")
    return docs.select(bucket_of(n, F.col(id_col), text).alias("grp"), F.col(id_col).alias("doc_id"), text.alias("text"))
