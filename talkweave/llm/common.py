"""What the training-text operators share: input shaping, the shared folder, and order by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave.session import arrow_rows as arrow_rows, shared_folder

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts lineage: a lost executor costs no more than the tasks that follow.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions_of(df: DataFrame) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not ASCII blanks."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", ""))
