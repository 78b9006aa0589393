"""Helpers shared by the corpus operators: shared scratch tables, tokenisation, broadcast bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of words made of digits, ASCII letters and all characters beyond ASCII.
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
#: A side with more rows than this is never broadcast.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one for local masters only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[sc.applicationId]


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str = "stash") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, rows: int, how: str = "left") -> DataFrame:
    """left joined with right, which has each key once at most, where a key may hold most rows of left.

    counts: (*keys, n), the rows of left per key; rows: all of them. Keys with more than a
    10,000th of the rows (4,096 at least), fewer than 10,000 in number, are cut into blocks:
    their rows are dealt by a hash of the row, and right is repeated for each block.
    """
    most = max(4096, rows // 10_000)
    heavy = F.broadcast(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_blocks")))
    one = F.coalesce("_blocks", F.lit(1))
    mine = left.join(heavy, keys, "left").withColumn("_block", F.pmod(F.xxhash64(*[c for c in left.columns if c not in keys]), one).cast("int")).drop("_blocks")
    other = right.join(heavy, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), one - 1))).drop("_blocks")
    return mine.join(other, [*keys, "_block"], how).drop("_block")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def plain_words(text: Column) -> Column:
    """Words without ASCII punctuation, as an array, in the case of the text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_BREAK), "")


def blank_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, as an array."""
    return F.array_remove(F.split(text, BLANKS), "")


def content_key(text: Column) -> Column:
    """Names a text beside its doc_id, so that repeated identifiers with other texts stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def split_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values that cut an integer column into like-sized ranges."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(found or []))


def range_index(column: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the value, by a balanced tree of comparisons; null: -1."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))
