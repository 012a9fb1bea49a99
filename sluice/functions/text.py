"""Text transforms, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The modulus of the number-to-letter code and the size of a UTF-16 unit.
LETTER_MODULUS = 65
UTF16_UNITS = 65536


def uppercase(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.upper(column))


def count_newlines(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(df: DataFrame, column: str = "text") -> DataFrame:
    """Number of newline characters over all texts."""
    return df.agg(F.coalesce(F.sum(count_newlines(column)), F.lit(0)).alias("n_lines"))


def to_letters(df: DataFrame, column: str = "line") -> DataFrame:
    """Integer prefix of each line, modulo 65, as ``code`` and ``letter``; others drop out.

    The remainder is folded over the digits, so a number may have any length. A negative
    number has a negative code, whose letter is that of its 16-bit unit.
    """
    sign = F.when(F.startswith("_prefix", F.lit("-")), -1).otherwise(1)
    digits = F.split(F.regexp_replace("_prefix", "[+-]", ""), "")
    folded = F.aggregate(
        digits,
        F.lit(0),
        lambda rest, digit: (rest * 10 + F.coalesce(digit.try_cast("int"), F.lit(0))) % LETTER_MODULUS,
    )
    unit = F.lpad(F.hex(F.pmod("code", F.lit(UTF16_UNITS))), 4, "0")
    return (
        df.withColumn("_prefix", F.regexp_extract(column, r"^\s*([+-]?[0-9]+)", 1))
        .where("_prefix != ''")
        .withColumn("code", (sign * folded).cast("int"))
        .withColumn("letter", F.decode(F.unhex(unit), "UTF-16BE"))
        .drop("_prefix")
    )


def field(df: DataFrame, n: int, skip: int = 0, column: str = "text") -> DataFrame:
    """The ``n``-th blank-separated field of every line after the first ``skip`` lines.

    A line with fewer fields gives an empty string.
    """
    kept = [c for c in df.columns if c != column]
    lines = df.select(*kept, F.posexplode(F.split(column, "\n")).alias("line_no", "_line"))
    words = F.split(F.regexp_replace("_line", r"^[ \t]+|[ \t]+$", ""), r"[ \t]+")
    value = F.coalesce(F.get(words, F.lit(n - 1)), F.lit(""))
    return lines.where(F.col("line_no") >= skip).select(*kept, "line_no", value.alias("field"))


# output names derived from input names


def same_folder(path: Column, name: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"^(.*/)?", 0), name)


def replace_suffix(path: Column, pattern: str, suffix: str) -> Column:
    return F.regexp_replace(path, f"{pattern}$", suffix)


def drop_last(path: Column, n: int) -> Column:
    return path.substr(F.lit(1), F.length(path) - n)


def first_segments(path: Column, n: int) -> Column:
    """The first ``n`` dot-separated parts of the file name."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", n)


def derive_outputs(df: DataFrame, output: Column, input: str = "path") -> DataFrame:
    """Output of each input and the number of inputs that claim the same output.

    Claims are counted before they are joined back, so an output claimed by a large share
    of all inputs is one row of the counted side.
    """
    from sluice.operators.skew import lookup

    named = df.select(F.col(input).alias("input"), output.alias("output"))
    claims = named.groupBy("output").agg(F.count(F.lit(1)).alias("n_claims"))
    return lookup(named, claims, ["output"]).select("input", "output", "n_claims")
