"""Typing, missing values and column classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, StringType

# The words a yes/no text may use, lower case.
TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast columns to double. Text that is no number raises, as ANSI casts do."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def blank_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty text and the word ``None`` become NULL."""
    return df.withColumns({c: F.when(~F.col(c).isin("", "None"), F.col(c)) for c in columns})


def parsed_double(text: Column) -> Column:
    """Text as a double, NULL when it is no number (a trailing Java ``d``/``f`` is none)."""
    java_suffix = text.rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~java_suffix, text.try_cast("double"))


def plain_double(df: DataFrame, c: str) -> Column:
    """The column as a double; NaN and text that is no number read as missing."""
    kind = df.schema[c].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(c), F.col(c).cast("double"))
    if isinstance(kind, BooleanType):
        return F.col(c).cast("int").cast("double")
    if isinstance(kind, StringType):
        return parsed_double(F.col(c))
    return F.col(c).cast("double")


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL (or NaN) in the subset, by default in any column."""
    return df.na.drop(subset=list(subset) if subset is not None else None)


def _present(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        return F.when(~F.isnan(c), F.col(c))
    return F.col(c)


def _level_facts(df: DataFrame, columns: Sequence[str], *, parse: bool = True) -> list[dict]:
    """Per column: distinct non-missing values up to "more than two", missing rows, unparsable texts.

    Texts are only read as numbers with ``parse``; without it none counts as unparsable.

    Exactly two values means: the extremes differ and nothing lies between. That takes two
    aggregates without any shuffle of values, where a distinct count would move them all.
    """
    first = []
    for i, c in enumerate(columns):
        v = _present(df, c)
        bad = (
            v.isNotNull() & parsed_double(F.col(c)).isNull()
            if parse and isinstance(df.schema[c].dataType, StringType)
            else F.lit(False)
        )
        first += [
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.count_if(v.isNull()).alias(f"na{i}"),
            F.count_if(bad).alias(f"bad{i}"),
        ]
    row: Row = df.agg(*first).first()
    between = []
    for i, c in enumerate(columns):
        v, kind = _present(df, c), df.schema[c].dataType
        lo, hi = F.lit(row[f"lo{i}"]).cast(kind), F.lit(row[f"hi{i}"]).cast(kind)
        between.append(F.coalesce(F.bool_or((v > lo) & (v < hi)), F.lit(False)).alias(f"mid{i}"))
    more: Row = df.agg(*between).first()
    facts = []
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        levels = 0 if lo is None else 1 if lo == hi else 3 if more[f"mid{i}"] else 2
        facts.append(
            {"column": c, "levels": levels, "missing": row[f"na{i}"], "unparsable": row[f"bad{i}"]}
        )
    return facts


def two_value_types(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Is a column continuous? Not when it has exactly two distinct non-missing values."""
    return {f["column"]: f["levels"] != 2 for f in _level_facts(df, columns, parse=False)}


def column_types(
    df: DataFrame, predictors: Sequence[str], response: str
) -> tuple[list[str], list[str], bool]:
    """(categorical predictors, continuous predictors, is the response categorical).

    A predictor is categorical if a value is no number or if it has at most two distinct
    values, where "missing" counts as one; the response if a value is no number or if it
    has exactly two.
    """
    cats, conts, response_cat = [], [], False
    for f in _level_facts(df, [*predictors, response]):
        levels = f["levels"] + (1 if f["missing"] else 0)
        if f["column"] == response:
            response_cat = bool(f["unparsable"]) or levels == 2
        elif f["unparsable"] or levels <= 2:
            cats.append(f["column"])
        else:
            conts.append(f["column"])
    return cats, conts, response_cat


def column_type_table(df: DataFrame, predictors: Sequence[str], response: str) -> DataFrame:
    """The same as a frame: (column, role, type)."""
    cats, _, response_cat = column_types(df, predictors, response)
    rows = [(p, "predictor", "categorical" if p in cats else "continuous") for p in predictors]
    rows.append((response, "response", "categorical" if response_cat else "continuous"))
    return df.sparkSession.createDataFrame(rows, "column string, role string, type string")


def truth_value(c: Column) -> Column:
    """1 / 0 for yes/no words, NULL for other text."""
    word = F.lower(c)
    return F.when(word.isin(*TRUE_WORDS), F.lit(1)).when(word.isin(*FALSE_WORDS), F.lit(0))


def numeric_response(df: DataFrame, response: str) -> Column | None:
    """The response as a double, or None when it cannot be read as one.

    Numbers are taken as they are; a text column of yes/no words becomes 1/0; any other
    text has no numeric reading.
    """
    if not isinstance(df.schema[response].dataType, StringType):
        return plain_double(df, response)
    text = F.col(response)
    row = df.agg(
        F.count_if(text.isNotNull() & parsed_double(text).isNull()).alias("no_number"),
        F.count_if(text.isNotNull() & truth_value(text).isNull()).alias("no_word"),
    ).first()
    if row["no_number"] == 0:
        return parsed_double(text)
    if row["no_word"] == 0:
        return truth_value(text).cast("double")
    return None


def as_category(c: Column | str) -> Column:
    """A number used as a class name."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def sign_category(c: Column | str) -> Column:
    """"1" for positive values, else "0"."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, F.lit("1")).otherwise(F.lit("0"))
