"""Helpers shared by the corpus operators: scratch tables, let-bindings and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import materialize

__all__ = ["WHITE", "by_hash", "let", "materialize", "named", "numbered", "plainly_named", "table", "text_batches", "train_fold"]

WHITE = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def named(column: str) -> Column:
    """A column by its whole name, dots and back-ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def plainly_named(df: DataFrame) -> DataFrame:
    """The same columns under names that any function over batches takes."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def train_fold(doc_id: Column) -> Column:
    """True for rows that labels may be learned from: crc32 of the id's text modulo 5 is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, salts: int = 256) -> DataFrame:
    """Add ``out``: a gapless number from 0 in each ``group``, without gathering a group in one task.

    Rows are dealt by (group, salt of the order columns); each such cell is
    numbered by itself and starts where the cells before it end.  The table of
    cell sizes has at most groups x ``salts`` rows.  ``df`` must be cheap to
    read twice (a scratch table).
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    cells = df.withColumn("_salt", salt)
    counts = cells.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*group, "_salt", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
    return (
        cells.withColumn("_rank", rank.cast("long"))
        .join(starts, [*group, "_salt"])
        .withColumn(out, F.col("_start") + F.col("_rank") - 1)
        .drop("_salt", "_rank", "_start")
    )


def text_batches(batch, column: int, most: int = 4_000_000):
    """A batch of Arrow rows in parts of at most ``most`` bytes of text, or one row; large texts come alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def by_hash(rows: DataFrame, share: Column | float, key: str) -> DataFrame:
    """About ``share`` of the rows, those with the least hashes of ``key``: the same ones whatever the partitions."""
    place = F.shiftrightunsigned(F.xxhash64(key), 12) / F.lit(float(1 << 52))
    return rows.filter(place < share)
