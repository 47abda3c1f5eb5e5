"""File sources: CSV with mixed encodings, the standard schemas, parquet stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweek.functions.scalar import parse_date, require_columns, to_number

# Accepted source names of every standard column, and the encodings tried.
TRANSACTION_ALIASES = {
    "date": ("거래일자", "date"),
    "item": ("품목명", "품목", "item"),
    "qty_in": ("반입량", "수량", "qty_in"),
    "amount": ("금액", "amount"),
}
WEATHER_DATE_ALIASES = ("조회일자", "date")
WEATHER_VARIABLES = (
    "tavg",
    "tmin",
    "tmax",
    "precip",
    "humidity",
    "sunshine",
    "radiation",
    "wind",
)
FALLBACK_ENCODING = "cp949"
# end of fixed values


def file_facts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, utf8, header)`` of every file: whether all lines are UTF-8, a hash of the first.

    Sums of plain numbers: a task holds one row a file and sorts no lines.
    """
    # The first line of a file: in the block at offset 0, the first row read.
    at = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), at.alias("at"))
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.min_by(F.xxhash64("value"), "at").alias("header"),
    )


def group_files(
    spark: SparkSession, paths: Sequence[str], fallback: str = FALLBACK_ENCODING
) -> list[tuple[str, list[str]]]:
    """Sort files into ``(encoding, files)`` groups with one header line each.

    Spark takes the columns of a CSV scan from one file, so files with other headers need a
    scan of their own. A file is UTF-8 (with or without a byte-order mark) if all its lines
    are, else it has the ``fallback`` encoding. The executors test every line; one short row
    per file comes back, no more than the driver holds for the scan itself.
    """
    verdict = file_facts(spark, paths)
    found: dict[tuple[str, int], list[str]] = {}
    for row in verdict.orderBy("path").toLocalIterator():
        encoding = "utf-8" if row.utf8 else fallback
        found.setdefault((encoding, row.header), []).append(row.path)
    return [(encoding, files) for (encoding, _), files in found.items()]


#: Set by ``session.configured``; reading changes no setting of the session.
CHARSETS = "spark.sql.legacy.javaCharsets"


def read_parts(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None
) -> list[DataFrame]:
    """CSV files with a header row as text columns, one table per encoding and header.

    With an ``encoding`` given, all files must share one header and are not examined. A
    missing path fails here, before any job.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = [(encoding, paths)] if encoding else group_files(spark, paths)
    if any(name.lower() == FALLBACK_ENCODING for name, _ in groups):
        # Spark 4 accepts only a short list of encodings unless this is on.
        if spark.conf.get(CHARSETS, "false") != "true":
            raise ValueError(f"files in {FALLBACK_ENCODING} need a session with {CHARSETS} on: session.configured sets it")
    if not groups:
        raise ValueError(f"no data in {paths}")
    return [
        spark.read.option("header", True).option("encoding", name).csv(files)
        for name, files in groups
    ]


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None
) -> DataFrame:
    """The tables of :func:`read_parts` united by column name; absent columns are NULL."""
    return unite(read_parts(spark, paths, encoding), allow_missing=True)


def unite(parts: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """One table out of many with the same columns in any order."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts
    )


def resolve_alias(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """First alias the table has; decided from the schema, without a job."""
    return next((name for name in aliases if name in df.columns), None)


def standardise_transactions(df: DataFrame) -> DataFrame:
    """Map source columns to ``date, item, qty_in, amount`` with their types."""
    found = {std: resolve_alias(df, names) for std, names in TRANSACTION_ALIASES.items()}
    missing = [std for std, name in found.items() if name is None]
    if missing:
        raise ValueError(f"missing required columns: {missing}")

    def typed(std: str) -> Column:
        source = F.col(f"`{found[std]}`")
        if std == "date":
            is_text = dict(df.dtypes)[found[std]] == "string"
            return parse_date(source) if is_text else source.cast("date")
        return source.cast("string") if std == "item" else to_number(source)

    return df.select(*[typed(std).alias(std) for std in TRANSACTION_ALIASES])


def read_transactions(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """The master table: every kind of source file mapped on its own, then united."""
    return unite([standardise_transactions(p) for s in sources for p in read_parts(spark, s)])


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather: ``date`` plus the standard variables that are present."""
    df = read_csv(spark, path)
    name = resolve_alias(df, WEATHER_DATE_ALIASES)
    if name is None:
        raise ValueError(f"missing required columns: {list(WEATHER_DATE_ALIASES)}")
    return df.select(
        parse_date(F.col(f"`{name}`")).alias("date"),
        *[to_number(F.col(v)).alias(v) for v in WEATHER_VARIABLES if v in df.columns],
    )


def read_wide_prices(spark: SparkSession, path: str, date_column: str = "거래일자") -> DataFrame:
    """Wide file: one date column, one numeric column per product."""
    df = read_csv(spark, path)
    require_columns(df, [date_column])
    return df.select(
        parse_date(F.col(f"`{date_column}`")).alias("date"),
        *[to_number(F.col(f"`{c}`")).alias(c) for c in df.columns if c != date_column],
    )


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A table another stage wrote."""
    return spark.read.parquet(path)


def read_rules(
    spark: SparkSession, params_path: str, aliases_path: str, groups_path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Substitution rules as three small JSON-lines tables."""
    params = spark.read.schema("price_discount_threshold double, top_k int").json(params_path)
    aliases = spark.read.schema("alias string, canonical string").json(aliases_path)
    groups = spark.read.schema("grp string, item string").json(groups_path)
    return params, aliases, groups
