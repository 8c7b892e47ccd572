"""Exact deduplication by content-defined chunk recipes.

A text, without white space, is cut into chunks where its own content says so: after
punctuation, at least ``LEAST`` characters into the chunk, or at ``MOST`` characters.  Each chunk
gets a 128-bit identifier.  The distinct chunks are compared by content once, so that an
identifier is known to stand for one chunk; should two chunks share one, the run goes on with
256-bit identifiers, verified in the same way.  Texts are then compared as ordered lists of
identifiers (recipes).  Only chunks are moved for verification, once each and combined before
the shuffle; documents themselves are never moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACES

LEAST, MOST = 256, 2048


def squeeze(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(squeezed: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a squeezed text, in order; none if it is empty."""
    pattern = rf"(?s).{{{least},{most - 1}}}?[.,;:!?\p{{Lo}}]|.{{1,{most}}}"
    return F.regexp_extract_all(squeezed, F.lit(pattern), F.lit(0))


def short_id(chunk: Column) -> Column:
    """128 bits: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def long_id(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def collisions(cut: DataFrame, identify: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for more than one of the chunks in column ``chunks``."""
    parts = cut.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk")).alias("ident"), "chunk")
    return parts.distinct().groupBy("ident").count().filter("count > 1")


def verified_identifier(cut: DataFrame, candidates: tuple = (short_id, long_id)) -> Callable[[Column], Column]:
    """The first of ``candidates`` that names no two different chunks alike; the chunk itself if all do."""
    for identify in candidates:
        if not collisions(cut, identify).take(1):
            return identify
    return lambda chunk: chunk


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: tuple = (short_id, long_id)) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars, n_chunks.

    Texts are equal when they are identical without white space; null counts as empty, and empty
    texts are equal to each other.  The longest original stays, of these the smallest id; a null
    id counts as larger than any other.  Of rows that repeat an id and its text, one stays.  Texts
    of any length are read whole; other columns are not read, whatever their names.  An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"), squeeze(F.col(text_col)).alias("bare"))
    cut = cut.select("doc_id", "n_chars", F.sha2("bare", 256).alias("text_sha256"), chunks(F.col("bare")).alias("chunks"))
    identify = verified_identifier(cut, candidates)
    rows = cut.select("doc_id", "n_chars", "text_sha256", F.transform("chunks", identify).alias("recipe"))
    rows = rows.groupBy("recipe", "text_sha256", "n_chars", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    # groups by recipe: first by length, so that plain minima and sums do
    sizes = rows.groupBy("recipe", "n_chars").agg(F.min("doc_id").alias("low"), F.sum("copies").alias("size"))
    groups = sizes.groupBy("recipe").agg(F.max("n_chars").alias("longest"), F.max_by("low", "n_chars").alias("keep_id"), F.sum("size").alias("group_size"))
    # joined on a derived key, so that both sides are dealt out anew and a hot group can be split
    out = rows.withColumn("_key", F.struct("recipe")).join(groups.select(F.struct("recipe").alias("_key"), "longest", "keep_id", "group_size"), "_key")
    keeper = (F.col("n_chars") == F.col("longest")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = out.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", (keeper & (F.col("_nth") == 1)).alias("kept"), "text_sha256", F.col("n_chars").cast("long").alias("n_chars"), F.size("recipe").alias("n_chunks"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns; one row of each group stays."""
    from pyspark.sql import Window as W

    stay = exact_dedup(docs, id_col, text_col).filter("kept").select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("doc_id").isNull().alias("n"), F.col("n_chars").alias("c"), F.col("text_sha256").alias("h")).alias("_tessera_key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(id_col).isNull().alias("n"), F.length(text).cast("long").alias("c"), F.sha2(squeeze(F.col(text_col)), 256).alias("h"))
    found = docs.withColumn("_tessera_key", key).join(stay, "_tessera_key", "left_semi")
    nth = F.row_number().over(W.partitionBy("_tessera_key").orderBy(F.col(id_col)))
    return found.withColumn("_tessera_nth", nth).filter("_tessera_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
