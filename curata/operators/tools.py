"""Units and engineering calculators as column expressions, with refusals as codes instead of exceptions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# Units with scale to SI and exponents of mass, length, time, current, temperature, amount, luminosity.
UNITS = {
    "1": (1.0, (0, 0, 0, 0, 0, 0, 0)),
    "%": (0.01, (0, 0, 0, 0, 0, 0, 0)),
    "kg": (1.0, (1, 0, 0, 0, 0, 0, 0)),
    "g": (1e-3, (1, 0, 0, 0, 0, 0, 0)),
    "m": (1.0, (0, 1, 0, 0, 0, 0, 0)),
    "mm": (1e-3, (0, 1, 0, 0, 0, 0, 0)),
    "cm": (1e-2, (0, 1, 0, 0, 0, 0, 0)),
    "km": (1e3, (0, 1, 0, 0, 0, 0, 0)),
    "in": (0.0254, (0, 1, 0, 0, 0, 0, 0)),
    "ft": (0.3048, (0, 1, 0, 0, 0, 0, 0)),
    "s": (1.0, (0, 0, 1, 0, 0, 0, 0)),
    "ms": (1e-3, (0, 0, 1, 0, 0, 0, 0)),
    "min": (60.0, (0, 0, 1, 0, 0, 0, 0)),
    "h": (3600.0, (0, 0, 1, 0, 0, 0, 0)),
    "A": (1.0, (0, 0, 0, 1, 0, 0, 0)),
    "mA": (1e-3, (0, 0, 0, 1, 0, 0, 0)),
    "K": (1.0, (0, 0, 0, 0, 1, 0, 0)),
    "degC": (1.0, (0, 0, 0, 0, 1, 0, 0)),
    "delta_K": (1.0, (0, 0, 0, 0, 1, 0, 0)),
    "delta_degC": (1.0, (0, 0, 0, 0, 1, 0, 0)),
    "mol": (1.0, (0, 0, 0, 0, 0, 1, 0)),
    "cd": (1.0, (0, 0, 0, 0, 0, 0, 1)),
    "rad": (1.0, (0, 0, 0, 0, 0, 0, 0)),
    "deg": (math.pi / 180, (0, 0, 0, 0, 0, 0, 0)),
    "Hz": (1.0, (0, 0, -1, 0, 0, 0, 0)),
    "rpm": (math.pi / 30, (0, 0, -1, 0, 0, 0, 0)),
    "N": (1.0, (1, 1, -2, 0, 0, 0, 0)),
    "kN": (1e3, (1, 1, -2, 0, 0, 0, 0)),
    "Pa": (1.0, (1, -1, -2, 0, 0, 0, 0)),
    "kPa": (1e3, (1, -1, -2, 0, 0, 0, 0)),
    "MPa": (1e6, (1, -1, -2, 0, 0, 0, 0)),
    "GPa": (1e9, (1, -1, -2, 0, 0, 0, 0)),
    "J": (1.0, (1, 2, -2, 0, 0, 0, 0)),
    "kJ": (1e3, (1, 2, -2, 0, 0, 0, 0)),
    "W": (1.0, (1, 2, -3, 0, 0, 0, 0)),
    "kW": (1e3, (1, 2, -3, 0, 0, 0, 0)),
    "V": (1.0, (1, 2, -3, -1, 0, 0, 0)),
    "mV": (1e-3, (1, 2, -3, -1, 0, 0, 0)),
    "Ohm": (1.0, (1, 2, -3, -2, 0, 0, 0)),
    "ohm": (1.0, (1, 2, -3, -2, 0, 0, 0)),
    "kohm": (1e3, (1, 2, -3, -2, 0, 0, 0)),
    "H": (1.0, (1, 2, -2, -2, 0, 0, 0)),
    "mH": (1e-3, (1, 2, -2, -2, 0, 0, 0)),
    "uH": (1e-6, (1, 2, -2, -2, 0, 0, 0)),
    "F": (1.0, (-1, -2, 4, 2, 0, 0, 0)),
    "uF": (1e-6, (-1, -2, 4, 2, 0, 0, 0)),
    "nF": (1e-9, (-1, -2, 4, 2, 0, 0, 0)),
    "C": (1.0, (0, 0, 1, 1, 0, 0, 0)),
}
# Offset scales, units of angle and of intervals.
OFFSETS = {"degC": 273.15}
ANGULAR, INTERVALS = ["rad/s", "rpm", "deg/s"], ["delta_K", "delta_degC"]
UNIT = StructType([StructField("scale", DoubleType()), StructField("shift", DoubleType()), StructField("dims", ArrayType(IntegerType())), StructField("error", StringType())])


def unit_of(text: str | None) -> tuple:
    """``(scale, shift, dims, error)`` of a unit: terms with powers up to 12, joined by * and /, left to right."""
    bad = lambda e: (None, None, None, e)
    if not text or len(text) > 128:
        return bad("NO_UNIT")
    text = text.strip()
    if text in UNITS:
        scale, dims = UNITS[text]
        return scale, OFFSETS.get(text, 0.0), list(dims), None
    scale, dims, sign = 1.0, [0] * 7, 1
    for part in re.split(r"([*/])", text):
        if part in ("*", "/"):
            sign = 1 if part == "*" else -1
            continue
        m = re.fullmatch(r"([A-Za-z_%]+|1)(?:\^(-?\d+))?", part)
        if not m or m[1] not in UNITS:
            return bad("UNSUPPORTED_UNIT")
        power = int(m[2] or 1)
        if m[1] in OFFSETS:
            return bad("AFFINE_UNIT_IN_PRODUCT")
        if abs(power) > 12:
            return bad("POWER_OUT_OF_RANGE")
        try:
            scale *= UNITS[m[1]][0] ** (sign * power)
        except (OverflowError, ZeroDivisionError):
            return bad("SCALE_OUT_OF_RANGE")
        dims = [a + sign * power * b for a, b in zip(dims, UNITS[m[1]][1])]
    return (scale, 0.0, dims, None) if 0 < scale < math.inf else bad("SCALE_OUT_OF_RANGE")


@F.pandas_udf(UNIT)
def parse_unit(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unit_of(x) for x in s], columns=["scale", "shift", "dims", "error"])


def unit_table(spark) -> DataFrame:
    """The single units as a small dimension table ``(unit, scale, shift, dims)``."""
    return spark.createDataFrame([(k, float(s), OFFSETS.get(k, 0.0), list(d)) for k, (s, d) in UNITS.items()], "unit string, scale double, shift double, dims array<int>")


def convert(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """``df`` with ``converted`` and ``code``; frequencies against angular speeds and temperatures against intervals are refused."""
    f, t = F.col(source), F.col(target)
    d = df.withColumn("_a", parse_unit(f)).withColumn("_b", parse_unit(t))
    cross = lambda one, many: ((f == one) & t.isin(many)) | ((t == one) & f.isin(many))
    code = (
        F.coalesce("_a.error", "_b.error")
    )
    code = F.when(code.isNotNull(), code).when(cross("Hz", ANGULAR), "CYCLES_AND_ANGLE").when(cross("degC", INTERVALS), "POINT_AND_INTERVAL").when(F.col("_a.dims") != F.col("_b.dims"), "DIMENSIONS_DIFFER").when(F.col(value).isNull() | F.isnan(value), "NO_VALUE")
    got = (F.col(value) * F.col("_a.scale") + F.col("_a.shift") - F.col("_b.shift")) / F.col("_b.scale")
    d = d.withColumn("code", code).withColumn("converted", F.when(F.col("code").isNull(), got))
    return d.drop("_a", "_b")


def same_dimensions(left: Column, right: Column) -> Column:
    return F.coalesce(parse_unit(left)["dims"] == parse_unit(right)["dims"], F.lit(False))


def axial_stress(force: Column, area: Column, strength: Column) -> Column:
    s = force / area
    return F.when((force >= 0) & (area > 0) & (strength > 0), F.struct(s.alias("stress"), F.try_divide(strength, s).alias("safety_factor"), F.when(force == 0, "unbounded_zero_load").otherwise("finite").alias("status")))


def dc_motor(kt: Column, current: Column, speed: Column, resistance: Column) -> Column:
    torque, loss = kt * current, current * current * resistance
    power = torque * speed
    return F.when((kt > 0) & (current >= 0) & (speed >= 0) & (resistance >= 0), F.struct(torque.alias("torque"), power.alias("mechanical_power"), loss.alias("copper_loss"), (kt * speed + current * resistance).alias("terminal_voltage"), F.try_divide(power, power + loss).alias("efficiency")))


def thermal_expansion(length: Column, coefficient: Column, delta: Column) -> Column:
    change = length * coefficient * delta
    return F.when((length > 0) & (length + change > 0), F.struct(change.alias("length_change"), (length + change).alias("final_length")))


def second_order_step(wn: Column, zeta: Column, t: Column) -> Column:
    root = F.sqrt((1 - zeta) * (1 + zeta))
    wd = wn * root
    response = 1 - F.exp(-zeta * wn * t) * (F.cos(wd * t) + zeta / root * F.sin(wd * t))
    return F.when((wn > 0) & (t >= 0) & (zeta > 0) & (zeta < 1), F.struct(response.alias("response"), (100 * F.exp(-math.pi * zeta / root)).alias("overshoot"), (math.pi / wd).alias("peak_time"), (4 / (zeta * wn)).alias("settling_time")))


def series_rlc(r: Column, l: Column, c: Column) -> Column:  # noqa: E741
    w, q = 1 / F.sqrt(l) / F.sqrt(c), F.sqrt(l) / F.sqrt(c) / r
    return F.when((r > 0) & (l > 0) & (c > 0), F.struct(w.alias("natural_frequency"), (w / (2 * math.pi)).alias("resonance_frequency"), q.alias("quality_factor"), (1 / (2 * q)).alias("damping_ratio")))


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots in order, scaled and without cancellation; null where it is no quadratic."""
    m = F.greatest(F.abs(a), F.abs(b), F.abs(c))
    a, b, c = (F.try_divide(x, m) for x in (a, b, c))
    disc = b * b - 4 * a * c
    q = -0.5 * (b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(disc, F.lit(0.0))))
    two = F.array_sort(F.array(F.try_divide(q, a), F.try_divide(c, q)))
    return F.when(a != 0, F.when(disc < 0, F.array().cast("array<double>")).when(disc == 0, F.array(-b / (2 * a))).otherwise(two))


def numeric_claim(actual: Column, reference: Column, absolute: Column, relative: Column) -> Column:
    """VERIFIED, CONFLICTING or NOT_APPLICABLE, by the larger of the absolute and the relative tolerance of the reference."""
    ok = F.abs(actual - reference) <= F.greatest(absolute, relative * F.abs(reference))
    return F.when(actual.isNull(), "NOT_APPLICABLE").when(ok, "VERIFIED").otherwise("CONFLICTING")


def is_close(a: Column, b: Column, rtol: Column, atol: Column) -> Column:
    """Symmetric closeness."""
    return F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), atol)


def training_estimate(tokens: Column, per_second: Column, cost: Column, useful: float = 0.85) -> Column:
    h = tokens / per_second / useful / 3600
    return F.when((tokens > 0) & (per_second > 0), F.struct(h.alias("hours"), (h / 24).alias("days"), (h * cost).alias("compute_cost")))


# The registry of calculators: name, function and argument names.
CALCULATORS = {
    "axial_stress": (axial_stress, ["force", "area", "strength"]),
    "dc_motor": (dc_motor, ["kt", "current", "speed", "resistance"]),
    "thermal_expansion": (thermal_expansion, ["length", "coefficient", "delta"]),
    "second_order_step": (second_order_step, ["wn", "zeta", "t"]),
    "series_rlc": (series_rlc, ["r", "l", "c"]),
    "quadratic_roots": (quadratic_roots, ["a", "b", "c"]),
    "numeric_claim": (numeric_claim, ["actual", "reference", "absolute", "relative"]),
}


def route(name: str, arguments: dict[str, Column]) -> tuple[Column, Column]:
    """The result column of a calculator and the digest of its inputs; argument names must be exact."""
    if name not in CALCULATORS:
        raise ValueError(f"no calculator {name}")
    f, names = CALCULATORS[name]
    if set(arguments) != set(names):
        raise ValueError(f"{name} takes {', '.join(names)}")
    receipt = F.sha2(F.to_json(F.struct(F.lit(name).alias("tool"), *[arguments[n].alias(n) for n in sorted(names)])), 256)
    return f(**arguments), receipt
