"""Order-independent sums and exact quantiles.

Adding doubles in parallel gives results that depend on task order. A double is therefore split into a whole number of
``10**-scale`` steps and a rest. Steps are summed as two longs (high and low part), which is exact whatever the order,
stays in generated code and combines before the shuffle. The rest is zero for values with at most ``scale`` decimals
and tiny otherwise, so its plain sum does not disturb the result. Values too large for steps are all rest. Nothing is
rounded away and no total overflows one long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.selection import DIRECT_LIMIT, Selection

_LOW_BITS = 21
_LARGEST_STEPS = float(2**52)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL)


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, _FRACTIONAL)


def is_numeric(data_type: T.DataType) -> bool:
    """Numeric measure types; booleans are not numeric."""
    return isinstance(data_type, T.NumericType)


def without_nan(column: Column, data_type: T.DataType) -> Column:
    """NaN counts as missing, as it does in a data frame library."""
    if not is_float(data_type):
        return column
    return F.when(~F.isnan(column), column)


def half_even(column: Column, digits: int) -> Column:
    """Round a double to some decimals by its exact binary value, ties to even.

    Scaling may push a value onto a tie it only comes close to. The rounding error of the product, exact by splitting
    both factors into halves (Dekker 1971), then tells on which side of the tie the value lies.
    """
    factor = float(10**digits)
    scaled = column * F.lit(factor)
    wide = column * F.lit(134217729.0)
    high = wide - (wide - column)
    low = column - high
    factor_high = (134217729.0 * factor) - (134217729.0 * factor - factor)
    factor_low = factor - factor_high
    error = ((high * factor_high - scaled) + high * factor_low + low * factor_high) + low * factor_low
    tie = F.abs(scaled - F.rint(scaled)) == 0.5
    aside = F.when(error > 0, F.rint(scaled + 0.25)).when(error < 0, F.rint(scaled - 0.25))
    whole = F.when(tie & (F.abs(scaled) < _LARGEST_STEPS), F.coalesce(aside, F.rint(scaled))).otherwise(F.rint(scaled))
    return whole / F.lit(factor)


def exact_sum(column: Column, data_type: T.DataType, scale: int = 6) -> Column:
    """Aggregate expression: the sum as a double, null for a group without values."""
    if isinstance(data_type, T.DecimalType):
        return F.sum(column).cast("double")
    if is_integral(data_type):
        return _step_total(column.cast("bigint")).cast("double")
    if not is_float(data_type):
        raise TypeError(f"cannot sum {data_type.simpleString()}")
    value = without_nan(column.cast("double"), data_type)
    scaled = F.rint(value * F.lit(float(10**scale)))
    fits = F.abs(scaled) < F.lit(_LARGEST_STEPS)
    steps = F.when(fits, scaled).when(value.isNotNull(), F.lit(0.0)).cast("bigint")
    rest = F.when(fits, value - scaled / F.lit(float(10**scale))).otherwise(value)
    unit = "0." + "0" * (scale - 1) + "1" if scale else "1"
    factor = F.expr(f"CAST('{unit}' AS DECIMAL({max(scale, 1)},{scale}))")
    return (_step_total(steps).cast(f"decimal({37 - max(scale, 1)},0)") * factor).cast("double") + F.sum(rest)


def _step_total(steps: Column) -> Column:
    """Total of longs in three parts of about 21 bits, none of which overflows below four trillion rows."""
    mask = F.lit((1 << _LOW_BITS) - 1)
    high = F.sum(F.shiftright(steps, 2 * _LOW_BITS)).cast("decimal(20,0)") * F.lit(1 << _LOW_BITS)
    middle = F.sum(F.shiftright(steps, _LOW_BITS).bitwiseAND(mask)).cast("decimal(20,0)")
    return (high + middle) * F.lit(1 << _LOW_BITS) + F.sum(steps.bitwiseAND(mask)).cast("decimal(20,0)")


def exact_mean(column: Column, data_type: T.DataType, scale: int = 6) -> Column:
    """Aggregate expression: exact sum over the count of values."""
    return F.try_divide(exact_sum(column, data_type, scale), F.count(without_nan(column, data_type)).cast("double"))


def small_total(column: Column) -> Column:
    """The same for doubles of any magnitude in small tables (trend points, slices), with decimal steps."""
    steps = column.try_cast("decimal(38,6)")
    rest = column - F.coalesce(steps.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(steps).cast("double"), F.lit(0.0)) + F.sum(rest)


def small_mean(column: Column) -> Column:
    return F.try_divide(small_total(column), F.count(column).cast("double"))


def ordered_total(values: Column) -> Column:
    """Sum of a short array from first to last."""
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


# --- exact quantiles -------------------------------------------------------------------------------------------------


def doubles(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Columns as doubles, NaN as missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: without_nan(F.col(f"`{c}`"), types[c]).cast("double") for c in columns}


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], direct_limit: int = DIRECT_LIMIT,
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles of whole columns, exact, without holding a column in one task.

    The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. ``Selection`` reads the table twice
    for all columns together and sorts only the values near the wanted ranks.
    """
    return Selection(df, doubles(df, columns), direct_limit=direct_limit).quantiles(probabilities) if columns else {}
