"""Text expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words, as regular expressions that Java and RE2 both read.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII alone take the faster ``lower``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separator: str = PUNCTUATION) -> Column:
    """Array of the runs between separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def with_output(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """``frame`` with the output column; an input column of that name gives way, whatever its case."""
    return frame.select(*[frame[f"`{c}`"] for c in frame.columns if c.lower() != name.lower()], value.alias(name))


def computed_once(value: Column) -> Column:
    """``value``, to be selected by itself: filters and projections above can't pull copies of it down.

    It is a generator of one row, which the optimizer neither merges nor sees through.
    """
    return F.explode(F.array(value))


#: Texts that go to a Python worker at once: whole texts may be long, so fewer than Spark's default.
TEXTS_AT_ONCE = 1000


def small_batches(frame: DataFrame) -> DataFrame:
    """``frame``; its session from now on sends at most TEXTS_AT_ONCE rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(frame.sparkSession.conf.get(key)) <= TEXTS_AT_ONCE:
        frame.sparkSession.conf.set(key, str(TEXTS_AT_ONCE))
    return frame


#: Rows of a few numbers and short strings that may be broadcast; larger frames are joined by a shuffle.
BROADCAST_ROWS = 200_000


def bounded(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` (stored already, as it is counted here), to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def table(spark, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
