"""Elementwise functions as column expressions, with IEEE results where SQL gives nulls or errors, and their
plain Python versions for single values (the implicit zero)."""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dtypes as D
from . import kernels
from .dtypes import DType

NAN, INF = float("nan"), float("inf")


def _f(value: float) -> Column:
    return F.lit(value)


def ieee_ln(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), NAN).when(x < 0, NAN).when(x == 0, -INF).otherwise(F.ln(F.when(x > 0, x).otherwise(1.0)))


def ieee_div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def ieee_rem(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def half_away(x: Column) -> Column:
    """Rounded half away from zero, with the sign of zero kept; large and non-finite values as they are."""
    big = F.isnan(x) | (F.abs(x) >= 2.0**52)
    whole = F.floor(F.abs(F.when(big, 0.0).otherwise(x)))
    near = whole.cast("double") + F.when(F.abs(F.when(big, 0.0).otherwise(x)) - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(big, x).when(x < 0, near * -1.0).otherwise(near)


def _py_div(a: float, b: float) -> float:
    if b == 0:
        return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1, b)
    return a / b


def _py_ln(x: float) -> float:
    return NAN if math.isnan(x) or x < 0 else -INF if x == 0 else math.log(x)


def _py_pow(a: float, b: float) -> float:
    try:
        out = math.pow(a, b)
    except OverflowError:
        return INF
    except ValueError:
        return INF if a == 0 else NAN
    return out


@dataclass(frozen=True)
class Unary:
    """column: expression; value: of one Python number; out: dtype of the result; on: kinds of dtypes."""

    name: str
    column: Callable[[Column, DType], Column]
    value: Callable
    out: Callable[[DType], DType] = lambda d: d
    on: str = "fc"


def _floats(name: str, real: Callable[[Column], Column], value: Callable, complex_value: Callable) -> Unary:
    def column(v: Column, d: DType) -> Column:
        return kernels.complex_unary(name, v, d) if d.kind == "c" else real(v.cast("double")).cast(d.sql)

    def one(z):
        return complex_value(z) if isinstance(z, complex) else value(z)

    return Unary(name, column, one)


_U8 = D.DTYPES["u8"]


def _mask(c: Column) -> Column:
    return c.cast("smallint")


def _abs(v: Column, d: DType) -> Column:
    if d.kind == "c":
        return F.hypot(v["re"].cast("double"), v["im"].cast("double")).cast(d.part.sql)
    return D.int_abs(v, d) if d.integer else F.abs(v)


def _any_part(test: Callable[[Column], Column]) -> Callable[[Column, DType], Column]:
    return lambda v, d: _mask(test(v["re"]) | test(v["im"]) if d.kind == "c" else test(v))


def _is_inf(v: Column, d: DType) -> Column:
    inf = lambda x: F.abs(x) == INF
    if d.kind == "c":
        return _mask((inf(v["re"]) | inf(v["im"])) & ~F.isnan(v["re"]) & ~F.isnan(v["im"]))
    return _mask(inf(v))


def _angle(v: Column, d: DType) -> Column:
    re, im = v["re"].cast("double"), v["im"].cast("double")
    # atan2 loses the sign of a zero imaginary part on the negative axis.
    minus = (im == 0) & (F.pow(im, F.lit(-1.0)) < 0)
    return F.when(minus & (re < 0), F.lit(-math.pi)).otherwise(F.atan2(im, re)).cast(d.part.sql)


UNARY = {
    u.name: u
    for u in (
        _floats("exp", F.exp, lambda x: math.exp(x), cmath.exp),
        _floats("ln", ieee_ln, _py_ln, lambda z: complex(-INF, 0) if z == 0 else cmath.log(z)),
        _floats("sin", F.sin, math.sin, cmath.sin),
        _floats("asin", F.asin, math.asin, cmath.asin),
        _floats("sinh", F.sinh, math.sinh, cmath.sinh),
        _floats("cos", F.cos, math.cos, cmath.cos),
        _floats("acos", F.acos, math.acos, cmath.acos),
        _floats("cosh", F.cosh, math.cosh, cmath.cosh),
        _floats("tan", F.tan, math.tan, cmath.tan),
        _floats("atan", F.atan, math.atan, cmath.atan),
        _floats("tanh", F.tanh, math.tanh, cmath.tanh),
        Unary("round", lambda v, d: half_away(v.cast("double")).cast(d.sql), lambda x: 0.0, on="f"),
        Unary("abs", _abs, abs, out=lambda d: d.part, on="uifc"),
        Unary("not", lambda v, d: _mask(~D.not_zero(v, d)), lambda x: int(x == 0), out=lambda d: _U8, on="uifc"),
        Unary("is_nan", _any_part(F.isnan), lambda x: 0, out=lambda d: _U8),
        Unary("is_inf", _is_inf, lambda x: 0, out=lambda d: _U8),
        Unary("conj", lambda v, d: D.make(v["re"], -v["im"], d), lambda z: z.conjugate(), on="c"),
        Unary("re", lambda v, d: v["re"], lambda z: z.real, out=lambda d: d.part, on="c"),
        Unary("im", lambda v, d: v["im"], lambda z: z.imag, out=lambda d: d.part, on="c"),
        Unary("angle", _angle, lambda z: cmath.phase(z), out=lambda d: d.part, on="c"),
    )
}


@dataclass(frozen=True)
class Binary:
    name: str
    column: Callable[[Column, Column, DType], Column]
    value: Callable  # of two Python numbers and the dtype
    out: Callable[[DType], DType] = lambda d: d
    on: str = "uifc"


def _complex_mul(a: Column, b: Column, d: DType) -> Column:
    ar, ai, br, bi = (x.cast("double") for x in (a["re"], a["im"], b["re"], b["im"]))
    return D.make(ar * br - ai * bi, ar * bi + ai * br, d)


def _arith(name: str, ints: Callable, floats: Callable, complexes: Callable | None, value: Callable, on: str = "uifc") -> Binary:
    def column(a: Column, b: Column, d: DType) -> Column:
        if d.kind == "c":
            return complexes(a, b, d)
        return ints(a, b, d) if d.integer else floats(a, b).cast(d.sql)

    return Binary(name, column, value, on=on)


def _both(f: Callable[[Column, Column], Column]) -> Callable:
    return lambda a, b, d: D.make(f(a["re"].cast("double"), b["re"].cast("double")), f(a["im"].cast("double"), b["im"].cast("double")), d)


def _value_div(a, b, d: DType):
    if d.integer:
        return 0 if b == 0 else D.wrap_int(int(math.copysign(abs(a) // abs(b), 1)) * (1 if (a < 0) == (b < 0) else -1), d)
    if d.kind == "c":
        return complex(NAN, NAN) if b == 0 else a / b
    return _py_div(a, b)


def _value_rem(a, b, d: DType):
    if d.integer:
        return 0 if b == 0 else D.wrap_int(abs(a) % abs(b) * (-1 if a < 0 else 1), d)
    return NAN if b == 0 or math.isnan(b) or math.isinf(a) else math.fmod(a, b)


def int_pow(a: int, b: int, d: DType) -> int:
    if b < 0:
        return {1: 1, -1: 1 if b % 2 == 0 else -1}.get(a, 0)
    return D.wrap_int(pow(a, b, 1 << d.bits), d)


def _value_pow(a, b, d: DType):
    if d.integer:
        return int_pow(int(a), int(b), d)
    if d.kind == "c":
        try:
            return a**b
        except ZeroDivisionError:
            return complex(NAN, NAN)
    return _py_pow(a, b)


def _value_log(a, b, d: DType):
    if d.kind == "c":
        return complex(NAN, NAN) if a == 0 or b in (0, 1) else cmath.log(a) / cmath.log(b)
    return _py_div(_py_ln(a), _py_ln(b))


ARITHMETIC = {
    b.name: b
    for b in (
        _arith("add", D.int_add, lambda a, b: a + b, _both(lambda x, y: x + y), lambda a, b, d: a + b),
        _arith("sub", D.int_sub, lambda a, b: a - b, _both(lambda x, y: x - y), lambda a, b, d: a - b),
        _arith("mul", D.int_mul, lambda a, b: a * b, _complex_mul, lambda a, b, d: a * b),
        _arith("div", D.int_div, ieee_div, lambda a, b, d: kernels.complex_binary("div", a, b, d), _value_div),
        _arith("pow", kernels.int_pow, lambda a, b: F.pow(a.cast("double"), b.cast("double")), lambda a, b, d: kernels.complex_binary("pow", a, b, d), _value_pow),
        _arith("log", None, lambda a, b: ieee_div(ieee_ln(a), ieee_ln(b)), lambda a, b, d: kernels.complex_binary("log", a, b, d), _value_log, on="fc"),
        _arith("rem", D.int_rem, ieee_rem, None, _value_rem, on="uif"),
    )
}


def _compare(name: str, op: Callable, value: Callable, on: str) -> Binary:
    def column(a: Column, b: Column, d: DType) -> Column:
        if d.kind == "c":
            same = (a["re"] == b["re"]) & (a["im"] == b["im"]) & ~F.isnan(a["re"]) & ~F.isnan(a["im"])
            return _mask(same if name == "eq" else ~same)
        out = op(a, b)
        if d.kind == "f":  # IEEE: NaN is unequal to all, and neither less nor greater
            out = (out | F.isnan(a) | F.isnan(b)) if name == "ne" else (out & ~F.isnan(a) & ~F.isnan(b))
        return _mask(out)

    return Binary(name, column, lambda a, b, d: int(value(a, b)), out=lambda d: _U8, on=on)


def _logic(name: str, op: Callable, value: Callable) -> Binary:
    return Binary(name, lambda a, b, d: _mask(op(D.not_zero(a, d), D.not_zero(b, d))), lambda a, b, d: int(value(a != 0, b != 0)), out=lambda d: _U8)


PREDICATES = {
    b.name: b
    for b in (
        _compare("eq", lambda a, b: a == b, lambda a, b: a == b, "uifc"),
        _compare("ne", lambda a, b: a != b, lambda a, b: a != b, "uifc"),
        _compare("gt", lambda a, b: a > b, lambda a, b: a > b, "uif"),
        _compare("ge", lambda a, b: a >= b, lambda a, b: a >= b, "uif"),
        _compare("lt", lambda a, b: a < b, lambda a, b: a < b, "uif"),
        _compare("le", lambda a, b: a <= b, lambda a, b: a <= b, "uif"),
        _logic("and", lambda a, b: a & b, lambda a, b: a and b),
        _logic("or", lambda a, b: a | b, lambda a, b: a or b),
        _logic("xor", lambda a, b: a != b, lambda a, b: a != b),
    )
}

BINARY = ARITHMETIC | PREDICATES
