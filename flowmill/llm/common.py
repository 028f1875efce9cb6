"""Column expressions and small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space that separates words and is stripped from lines, and the letters
# whose case is folded.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; the faster built-in where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text, lower-cased; none for null or blank texts."""
    bare = strip_spaces(lower_ascii(text))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(F.split(bare, SPACE_CLASS + "+"), F.array().cast("array<string>")))


def digest(text: Column) -> Column:
    """128 bits that stand for a text in shuffles."""
    return F.unhex(F.md5(text.cast("binary")))


def keep_row(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that names an operator adds cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unfold(df: DataFrame, columns: list[str], own: dict[str, Column], name: str = "row") -> DataFrame:
    """The kept columns again, with an operator's own in place of those that have their name."""
    kept = [F.col(f"{name}.`{c}`").alias(c) for c in columns if c not in own]
    return df.select(*[own[c].alias(c) if c in own else F.col(f"{name}.`{c}`").alias(c) for c in columns],
                     *[v.alias(k) for k, v in own.items() if k not in columns]) if kept or own else df


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row: a generator's output is never inlined into
    the lambdas and filters above it, as a projection's may be."""
    return df.withColumn(name, F.explode(F.array(value)))
