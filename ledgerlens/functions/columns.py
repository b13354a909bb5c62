"""Column builders: codes, labels, flags, buckets, periods, ratios and number text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def decoded(label, code, prefix: str = "Code ") -> Column:
    """The dictionary label, or `prefix` and the code where the dictionary has none."""
    return F.coalesce(col(label), F.concat(F.lit(prefix), col(code).cast("string")))


def normalised_code(c) -> Column:
    """'186.0' and '186' to '186'; text that is no number to null."""
    return col(c).try_cast("double").cast("bigint").cast("string")


def clean_label(c) -> Column:
    return F.trim(F.regexp_replace(col(c), "\t", " "))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def category_ladder(c, steps: list[tuple[Column, str]]) -> Column:
    """First matching category, else the trimmed original."""
    out = None
    for condition, name in steps:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(F.trim(col(c)))


def bucket(c, edges: list[float], labels: list[str]) -> Column:
    """labels[i] below edges[i], the last label from the last edge on; null stays null."""
    value = col(c)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def prefix_class(c, classes: dict[str, str], other: str) -> Column:
    """Category by the first letter of a code."""
    first = F.substring(F.upper(F.trim(col(c))), 1, 1)
    out = None
    for letters, name in classes.items():
        hit = first.isin(*letters)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def month_key(d) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def quarter_key(d) -> Column:
    return F.concat(F.year(col(d)), F.lit("-Q"), F.quarter(col(d)))


def fiscal_start(d, first_month: int = 4) -> Column:
    return F.year(col(d)) - F.when(F.month(col(d)) >= first_month, 0).otherwise(1)


def year_label(start) -> Column:
    """2024 to '2024-2025'."""
    year = col(start).cast("int")
    return F.concat_ws("-", year.cast("string"), (year + 1).cast("string"))


def fiscal_year(d, first_month: int = 4) -> Column:
    return year_label(fiscal_start(d, first_month))


def days_between(start, end) -> Column:
    """Elapsed days with fraction."""
    return (F.unix_timestamp(col(end).cast("timestamp")) - F.unix_timestamp(col(start).cast("timestamp"))) / 86400.0


def days_since(d, as_of) -> Column:
    return F.datediff(col(as_of), col(d))


def safe_ratio(a, b) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0).cast("double"))


def signed_difference(spent, base, keep_null_base: bool = False) -> Column:
    """spent - base; a missing base counts as 0 unless it must stay unknown."""
    left = F.coalesce(col(spent), F.lit(0.0))
    return left - (col(base) if keep_null_base else F.coalesce(col(base), F.lit(0.0)))


def search_text(*cols) -> Column:
    return F.lower(F.concat_ws(" ", *[col(c) for c in cols]))


def serial_to_date(c, low: int = 20000, high: int = 60000) -> Column:
    """Spreadsheet day serial to date, null outside the plausible range."""
    n = col(c).try_cast("int")
    return F.when(n.between(low, high), F.date_add(F.lit("1899-12-30").cast("date"), n))


def indian_grouping(c, decimals: int = 0) -> Column:
    """Text of a number grouped 12,34,567."""
    value = col(c)
    text = F.format_string(f"%.{decimals}f", F.abs(value))
    whole = F.substring_index(text, ".", 1)
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    tail = F.right(whole, F.lit(3))
    # pairs from the right: an odd head starts with a single digit
    grouped_head = F.when(
        F.length(head) % 2 == 1,
        F.concat(F.substring(head, 1, 1),
                 F.regexp_replace(F.substring(head, F.lit(2), F.length(head)), "(\\d{2})", ",$1")),
    ).otherwise(F.substring(F.regexp_replace(head, "(\\d{2})", ",$1"), F.lit(2), F.length(head) * 2))
    whole_text = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(grouped_head, F.lit(","), tail))
    fraction = F.concat(F.lit("."), F.substring_index(text, ".", -1)) if decimals else F.lit("")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole_text, fraction)


def rupee_text(c) -> Column:
    """Crore or lakh from one lakh up, plain below."""
    v = col(c)
    return (
        F.when(F.abs(v) >= 1e7, F.concat(F.lit("Rs "), indian_grouping(v / 1e7, 2), F.lit(" crore")))
        .when(F.abs(v) >= 1e5, F.concat(F.lit("Rs "), indian_grouping(v / 1e5, 2), F.lit(" lakh")))
        .otherwise(F.concat(F.lit("Rs "), indian_grouping(v, 0)))
    )


def period_bounds(label) -> Column:
    """struct(first, last) month index of '2020-08', '2020-Q3' or '2024-2025' (April to March), else null."""
    s = F.trim(col(label).cast("string"))
    year = F.substring(s, 1, 4).try_cast("int")
    month = F.regexp_extract(s, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    quarter = F.regexp_extract(s, r"^\d{4}-Q([1-4])$", 1).try_cast("int")
    until = F.regexp_extract(s, r"^\d{4}-(\d{4})$", 1).try_cast("int")
    start = (
        F.when(month.isNotNull(), year * 12 + month - 1)
        .when(quarter.isNotNull(), year * 12 + (quarter - 1) * 3)
        .when(until == year + 1, year * 12 + 3)
    )
    length = F.when(month.isNotNull(), 0).when(quarter.isNotNull(), 2).otherwise(11)
    return F.when(start.isNotNull(), F.struct(start.alias("first"), (start + length).alias("last")))


def optional_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Filter on equality, or not at all when no value was given."""
    return df if value is None else df.filter(F.col(column) == value)


def date_window(df: DataFrame, column: str, kind: str, start, end) -> DataFrame:
    """Keep rows inside the window; `kind` says how the column stores time."""
    if kind == "iso":
        return df.filter(F.to_date(F.col(column)).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if kind == "year":
        return df.filter(F.col(column).between(int(str(start)[:4]), int(str(end)[:4])))
    raise ValueError(f"unknown date kind {kind!r}")
