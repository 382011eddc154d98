"""Element types, their Spark types, wrapping integer arithmetic and casts, as expressions safe under ANSI mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSchema

U64 = 1 << 64
LOW = (1 << 32) - 1


@dataclass(frozen=True)
class DType:
    name: str
    kind: str  # u, i, f or c
    bits: int
    sql: str

    @property
    def integer(self) -> bool:
        return self.kind in "ui"

    @property
    def real(self) -> bool:
        return self.kind != "c"

    @property
    def part(self) -> "DType":
        """The real type of a complex one's parts."""
        return DTYPES["f32" if self.bits == 32 else "f64"] if self.kind == "c" else self


DTYPES = {
    d.name: d
    for d in (
        DType("u8", "u", 8, "smallint"),
        DType("u16", "u", 16, "int"),
        DType("u32", "u", 32, "bigint"),
        DType("u64", "u", 64, "decimal(20,0)"),
        DType("i8", "i", 8, "tinyint"),
        DType("i16", "i", 16, "smallint"),
        DType("i32", "i", 32, "int"),
        DType("i64", "i", 64, "bigint"),
        DType("f32", "f", 32, "float"),
        DType("f64", "f", 64, "double"),
        DType("c32", "c", 32, "struct<re:float,im:float>"),
        DType("c64", "c", 64, "struct<re:double,im:double>"),
    )
}


def dtype(name: str | DType) -> DType:
    if isinstance(name, DType):
        return name
    if name not in DTYPES:
        raise InvalidSchema(f"dtype {name}")
    return DTYPES[name]


def is_nan(v: Column) -> Column:
    return F.isnan(v)


def make(re: Column, im: Column, d: DType) -> Column:
    return F.struct(re.cast(d.part.sql).alias("re"), im.cast(d.part.sql).alias("im"))


def literal(value, d: DType) -> Column:
    if d.kind == "c":
        z = complex(value)
        return make(F.lit(float(z.real)), F.lit(float(z.imag)), d)
    if d.integer:
        value = wrap_int(int(value), d)
        return F.lit(str(value)).cast(d.sql) if d.name == "u64" else F.lit(value).cast(d.sql)
    return F.lit(float(value)).cast(d.sql)


def zero(d: DType) -> Column:
    return literal(0, d)


def wrap_int(value: int, d: DType) -> int:
    value &= (1 << d.bits) - 1
    return value - (1 << d.bits) if d.kind == "i" and value >> (d.bits - 1) else value


def not_zero(v: Column, d: DType) -> Column:
    """NaN counts as other than zero."""
    return (v["re"] != 0) | (v["im"] != 0) if d.kind == "c" else v != 0


def _decimal(n: int, digits: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({digits},0)")


def signed64(v: Column) -> Column:
    """A decimal of up to 38 digits by its low 64 bits, as BIGINT. The argument occurs once, so that chains stay short."""
    return (F.pmod(v + _decimal(1 << 63, 20), _decimal(U64, 20)) - _decimal(1 << 63, 20)).cast("bigint")


def wide(v: Column, d: DType) -> Column:
    """As BIGINT; u64 by its bits."""
    return signed64(v) if d.name == "u64" else v.cast("bigint")


def narrow(v: Column, d: DType) -> Column:
    """From a BIGINT, by its low bits."""
    if d.name == "u64":
        return F.pmod(v.cast("decimal(20,0)"), _decimal(U64, 20)).cast(d.sql)
    if d.name == "i64":
        return v
    if d.kind == "u":
        return v.bitwiseAND(F.lit((1 << d.bits) - 1)).cast(d.sql)
    return F.shiftright(F.shiftleft(v, 64 - d.bits), 64 - d.bits).cast(d.sql)


def add64(a: Column, b: Column, carry: int = 0) -> Column:
    """Sum of BIGINTs modulo 2**64, by halves that cannot overflow."""
    low = a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW)) + carry
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def mul64(a: Column, b: Column) -> Column:
    """Product of BIGINTs modulo 2**64: 38 digits hold it."""
    return signed64(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))


def _digits(v: Column, d: DType) -> Column:
    return v if d.name == "u64" else v.cast("decimal(19,0)")


def int_add(a: Column, b: Column, d: DType) -> Column:
    if d.bits == 64:
        return narrow(signed64(_digits(a, d) + _digits(b, d)), d)
    return narrow(wide(a, d) + wide(b, d), d)


def int_sub(a: Column, b: Column, d: DType) -> Column:
    if d.bits == 64:
        return narrow(signed64(_digits(a, d) - _digits(b, d)), d)
    return narrow(wide(a, d) - wide(b, d), d)


def int_mul(a: Column, b: Column, d: DType) -> Column:
    a, b = wide(a, d), wide(b, d)
    return narrow(mul64(a, b) if d.bits == 64 or d.name == "u32" else a * b, d)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def int_div(a: Column, b: Column, d: DType) -> Column:
    """x / 0 = 0; the least number over -1 is itself."""
    if d.name == "u64":
        whole = (a - a % F.when(b == 0, F.lit(1).cast(d.sql)).otherwise(b)) / F.when(b == 0, F.lit(1).cast(d.sql)).otherwise(b)
        return F.when(b == 0, zero(d)).otherwise(whole.cast(d.sql))
    a, b = wide(a, d), wide(b, d)
    minus = F.when(a == F.lit(-(1 << 63)), a).otherwise(-F.when(a == F.lit(-(1 << 63)), F.lit(0)).otherwise(a))
    safe = F.when((b == 0) | (b == -1), F.lit(1).cast("bigint")).otherwise(b)
    return narrow(F.when(b == 0, F.lit(0).cast("bigint")).when(b == -1, minus).otherwise(_div(a, safe)), d)


def int_rem(a: Column, b: Column, d: DType) -> Column:
    """x % 0 = 0; the sign is the dividend's."""
    if d.name == "u64":
        return F.when(b == 0, zero(d)).otherwise((a % F.when(b == 0, F.lit(1).cast(d.sql)).otherwise(b)).cast(d.sql))
    a, b = wide(a, d), wide(b, d)
    safe = F.when((b == 0) | (b == -1), F.lit(1).cast("bigint")).otherwise(b)
    return narrow(F.when((b == 0) | (b == -1), F.lit(0).cast("bigint")).otherwise(a % safe), d)


def int_abs(a: Column, d: DType) -> Column:
    if d.kind == "u":
        return a
    return F.when(a < 0, int_sub(zero(d), a, d)).otherwise(a)


def cast(v: Column, source: DType, target: DType) -> Column:
    """Between any two types. Integers reach floats through f32; a change of sign is a reinterpretation at the
    source's width; floats reach integers by saturation at 64 bits of the target's sign, then by low bits;
    complex numbers give their real part."""
    if source == target:
        return v
    if source.kind == "c":
        if target.kind == "c":
            return make(v["re"], v["im"], target)
        return cast(v["re"], source.part, target)
    if target.kind == "c":
        return make(cast(v, source, target.part), F.lit(0.0), target)
    if source.integer and target.kind == "f":
        # Adding zero keeps Catalyst from folding the two casts into one.
        single = v.cast("float") + F.lit(0.0).cast("float")
        return single if target.name == "f32" else single.cast("double")
    if source.integer:
        bits = wide(v, source)
        if source.kind != target.kind and source.bits < 64:
            same = DTYPES[target.kind + str(source.bits)]
            bits = wide(narrow(bits, same), same)
        return narrow(bits, target)
    if target.kind == "f":
        return v.cast(target.sql)
    x = v.cast("double")
    if target.kind == "i":
        bits = F.when(F.isnan(x), F.lit(0)).when(x >= 2.0**63, F.lit((1 << 63) - 1)).when(x <= -(2.0**63), F.lit(-(1 << 63)))
        inside = F.when(F.isnan(x) | (x >= 2.0**63) | (x <= -(2.0**63)), F.lit(0.0)).otherwise(x)
        return narrow(bits.otherwise(inside.cast("bigint")), target)
    small = F.when(F.isnan(x) | (x >= 2.0**63) | (x < 0), F.lit(0.0)).otherwise(x)
    large = F.when((x >= 2.0**63) & (x < 2.0**64), x - 2.0**63).otherwise(F.lit(0.0))
    top = F.lit(-(1 << 63))
    bits = F.when(F.isnan(x) | (x <= 0), F.lit(0)).when(x >= 2.0**64, F.lit(-1)).when(x >= 2.0**63, top + large.cast("bigint")).otherwise(small.cast("bigint"))
    return narrow(bits.cast("bigint"), target)
