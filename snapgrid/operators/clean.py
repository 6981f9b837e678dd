"""Header, type and coordinate cleaning; the same for batches and streams."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The box that crash coordinates must lie in, ends included.
LAT_RANGE = (40.4, 41.0)
LON_RANGE = (-74.3, -73.6)
COUNT_PREFIX = "number_of"
DATE_PATTERNS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a")
# A decimal number: Spark's own cast also takes "12d" and "7f".
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
REQUIRED_COLUMNS = {
    "collision_id": "string",
    "crash_date": "string",
    "latitude": "double",
    "longitude": "double",
    "number_of_persons_killed": "double",
    "number_of_persons_injured": "double",
}


def normalise_headers(df: DataFrame, lower: bool = True, underscore: bool = True) -> DataFrame:
    """Trim headers, then lower-case them and put underscores for spaces if asked.

    Of columns that end up with the same name the first one stays.
    """
    names = []
    for name in df.columns:
        name = name.strip()
        name = name.lower() if lower else name
        names.append(name.replace(" ", "_") if underscore else name)
    positions: dict[str, int] = {}
    for i, name in enumerate(names):
        positions.setdefault(name, i)
    numbered = df.toDF(*[f"_{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"_{i}").alias(name) for name, i in positions.items()])


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the missing ones of ``{name: type}`` as nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def to_number(column: Column) -> Column:
    """Number or null. Text that is not a decimal number becomes null, and so do NaN,
    infinities and what is too large for a double."""
    number = F.when(column.cast("string").rlike(NUMBER), column.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def number_of(df: DataFrame, column: str) -> Column:
    """``to_number`` of a column; one that holds numbers is not taken through text."""
    if isinstance(df.schema[column].dataType, NumericType):
        number = F.col(column).cast("double")
        return F.when(F.abs(number) < float("inf"), number)
    return to_number(F.col(column))


def coerce_numbers(df: DataFrame, columns: Iterable[str] = (), containing: str | None = None) -> DataFrame:
    """Make numbers of the named columns and of those whose name contains a text."""
    chosen = set(columns) | {c for c in df.columns if containing and containing in c}
    return df.withColumns({c: number_of(df, c) for c in df.columns if c in chosen})


def to_integer_key(column: Column) -> Column:
    """Whole-number key or null; accepts "12" as well as "12.0"."""
    whole = F.when(column.cast("string").rlike(NUMBER), column.try_cast("bigint"))
    return F.coalesce(whole, to_number(column).try_cast("bigint"))


def to_time(column: Column, pattern: str | None = None) -> Column:
    """Timestamp or null; month, day and year with slashes are read too."""
    text = column.cast("string")
    if pattern:
        return F.try_to_timestamp(text, F.lit(pattern))
    return F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(F.trim(text), F.lit(p)) for p in DATE_PATTERNS]
    )


def drop_zero_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where((F.col(lat) != 0) & (F.col(lon) != 0))


def within_box(
    df: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
) -> DataFrame:
    return df.where(F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range))


def typed_crashes(raw: DataFrame) -> DataFrame:
    """Raw crash rows under tidy headers with typed columns; all rows stay."""
    df = ensure_columns(normalise_headers(raw), REQUIRED_COLUMNS)
    df = coerce_numbers(df, ["latitude", "longitude"], containing=COUNT_PREFIX)
    return df.withColumn("crash_date", to_time(F.col("crash_date")))


def clean_crashes(
    raw: DataFrame,
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
) -> DataFrame:
    """Raw crash rows to typed rows with usable coordinates.

    Only projections and filters: runs unchanged on a stream, and Spark pushes
    the filters to the scan where the source allows it.
    """
    df = typed_crashes(raw).dropna(subset=["latitude", "longitude"])
    return within_box(drop_zero_coordinates(df), lat_range=lat_range, lon_range=lon_range)


def keyed_crashes(crashes: DataFrame, key: str = "collision_id") -> DataFrame:
    """Rows with a whole-number key."""
    return crashes.withColumn(key, to_integer_key(F.col(key))).dropna(subset=[key])


def union_pages(*pages: DataFrame) -> DataFrame:
    """Append pages by column name; a column that a page lacks is null there."""
    whole = pages[0]
    for page in pages[1:]:
        whole = whole.unionByName(page, allowMissingColumns=True)
    return whole
