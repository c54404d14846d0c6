"""One table out of blocks whose schemas differ in ways that lose nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType)
#: Digits that a whole number of each type may have.
DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


class Conflict(TypeError):
    pass


def common_type(a: T.DataType, b: T.DataType, name: str = "a column") -> T.DataType:
    """The least type that holds the values of both; types of different kinds are a conflict, never text.

    Whole numbers widen, with reals they become doubles, decimals keep all digits of both sides, dates become times; arrays, maps and
    structs are widened within, fields of a struct that one side lacks are null there.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, WHOLE) and isinstance(b, WHOLE):
        return max(a, b, key=lambda t: WHOLE.index(type(t)))
    if isinstance(a, (*WHOLE, *REAL)) and isinstance(b, (*WHOLE, *REAL)):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        if isinstance(a, REAL) or isinstance(b, REAL):
            return T.DoubleType()
        if isinstance(a, (*WHOLE, T.DecimalType)) and isinstance(b, (*WHOLE, T.DecimalType)):
            x, y = (t if isinstance(t, T.DecimalType) else T.DecimalType(DIGITS[type(t)], 0) for t in (a, b))
            scale = max(x.scale, y.scale)
            precision = max(x.precision - x.scale, y.precision - y.scale) + scale
            if precision > 38:
                raise Conflict(f"{name}: {a.simpleString()} and {b.simpleString()} need {precision} digits")
            return T.DecimalType(precision, scale)
    times = {T.DateType, T.TimestampType, T.TimestampNTZType}
    if {type(a), type(b)} <= times and T.DateType in {type(a), type(b)}:
        return b if isinstance(a, T.DateType) else a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType, f"{name}[]"), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType, f"{name} keys"), common_type(a.valueType, b.valueType, f"{name} values"), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema(a, b, f"{name}.")
    raise Conflict(f"{name}: {a.simpleString()} and {b.simpleString()} have no common type")


def common_schema(a: T.StructType, b: T.StructType, prefix: str = "") -> T.StructType:
    """Fields of a in their order, then those that b alone has; names are told apart by case."""
    left, right = ({f.name: f.dataType for f in s.fields} for s in (a, b))
    names = [*left, *[n for n in right if n not in left]]
    return T.StructType([T.StructField(n, common_type(left.get(n, T.NullType()), right.get(n, T.NullType()), prefix + n), True) for n in names])


def relaxed_union(*blocks: DataFrame) -> DataFrame:
    """All rows of the blocks under their common schema; a column that a block lacks is null in it. A conflict is raised before anything runs."""
    schema = reduce(common_schema, [b.schema for b in blocks])

    def widened(block: DataFrame) -> DataFrame:
        return block.select([_as(F.col(f"`{f.name}`") if f.name in block.columns else F.lit(None), block.schema[f.name].dataType if f.name in block.columns else T.NullType(), f.dataType).alias(f.name) for f in schema.fields])

    return reduce(DataFrame.unionAll, [widened(b) for b in blocks])


def _as(value, have: T.DataType, want: T.DataType):
    """A cast, field by field where a struct has to gain fields."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        names = set(have.names)
        fields = [_as(value[f.name] if f.name in names else F.lit(None), have[f.name].dataType if f.name in names else T.NullType(), f.dataType).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and have.elementType != want.elementType:
        return F.transform(value, lambda x: _as(x, have.elementType, want.elementType))
    return value.cast(want)
