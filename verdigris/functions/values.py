"""Comparison and canonical text of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

#: Types whose values Spark hashes as they are: NaN equals NaN, and zero has no sign.
PLAIN = (IntegralType, DoubleType, FloatType, BooleanType, DateType, TimestampType, TimestampNTZType)


def named(column: str) -> Column:
    """The column of that name, whatever characters the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def approx_equal(a: Column, b: Column, tol: float) -> Column:
    """Whether two numbers are equal, both null, both NaN, or at most ``tol`` apart. Never null.

    A difference that the numbers' type does not hold is compared as a double.
    """
    near = lambda d: (d <= F.lit(tol)) & (d >= F.lit(-tol))
    return a.eqNullSafe(b) | F.coalesce(near(F.try_subtract(a, b)), near(a.cast("double") - b.cast("double")), F.lit(False))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as it takes to differ from all ``taken`` names, whatever their case."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def family(kind: DataType) -> str:
    """Types of one family compare by value; others do not, and are told as retyped: a number is no text, a date no timestamp."""
    return "number" if isinstance(kind, NumericType) else "text" if isinstance(kind, StringType) else kind.simpleString()


def canonical(column: Column, kind: DataType, scale: int | None = None) -> Column:
    """A value as text, different values as different text; null stays null.

    Floating-point numbers are exact, or decimals of ``scale`` places that other engines can produce too; NaN and
    infinities keep their names. Timestamps have microseconds; instants are in UTC, whatever zone the session has. Of arrays, structs and maps (sorted by key) every
    element has a null flag and its length.
    """
    if isinstance(kind, (DoubleType, FloatType)):
        column = column + F.lit(0).cast(kind)  # no negative zero
        if scale is None:
            return column.cast("string")
        rounded = column.try_cast(DecimalType(38, scale)).cast("string")
        return F.coalesce(rounded, column.cast("string"))
    if isinstance(kind, TimestampType):
        instant = F.timestamp_add("MICROSECOND", F.unix_micros(column), F.lit("1970-01-01").cast("timestamp_ntz"))
        return F.concat(F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))
    if isinstance(kind, TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.concat(F.lit("("), *(flagged(column[f.name], f.dataType, scale) for f in kind.fields), F.lit(")")))
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: flagged(x, kind.elementType, scale)), ""), F.lit("]"))
    if isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(column))
        return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(flagged(k, kind.keyType, scale), flagged(F.element_at(column, k), kind.valueType, scale))), ""), F.lit("}"))
    return column.cast("string")


def flagged(column: Column, kind: DataType, scale: int | None = None) -> Column:
    """``canonical`` with a null flag and its length, so that such texts can be joined and no two rows read alike."""
    text = canonical(column, kind, scale)
    return F.when(column.isNull(), F.lit("N;")).otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def comparable(column: Column, kind: DataType) -> Column:
    """The value itself where Spark can compare it for equality, else (maps, also inside others) its canonical text."""
    return canonical(column, kind) if "map<" in kind.simpleString() else column


def row_digest(columns: list[tuple[str, DataType]], scale: int | None = None) -> Column:
    """md5 over the columns, each with a null flag and its length."""
    return F.md5(F.concat(*(flagged(named(name), kind, scale) for name, kind in columns)))
