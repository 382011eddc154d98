"""One query for each operator of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes as D
from .. import geometry as G
from ..geometry import At, In, Of, StorageGeometry
from ..operators import fourier
from ..operators.reduce import reduce, reduce_sets, truth_frame
from ..session import scratch_path
from ..sources import frames, store
from ..sources.views import View
from ..streaming import batches
from ..tensor import Tensor, flat_index, fold
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Decimals to which inexact values are compared.
DIGITS = 6


def shown(df: DataFrame, digits: int | None = None) -> DataFrame:
    return df if digits is None else df.withColumn("v", F.round("v", digits) + F.lit(0.0))


def add(name: str, body: str | None, digits: int | None = None):
    """Register a function that returns a tensor or a frame, with its SQL over the tables' expressions."""

    def keep(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            out = f(spark, d)
            return shown(out.rows() if isinstance(out, Tensor) else out, digits)

        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if body is not None:
            ORACLE[name] = T.sql(body)
        return f

    return keep


def _rounded(expression: str, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) + 0.0"


def query(name: str, body: str | None, f, digits: int | None = None) -> None:
    add(name, body, digits)(f)


#: Every nation and region.
_NGRID = "(SELECT a.range AS c0, b.range AS c1, coalesce(n.v, 0) AS v FROM range(25) a CROSS JOIN range(5) b LEFT JOIN n ON n.c0 = a.range AND n.c1 = b.range)"
E, Q, R, L, U, N = T.embeddings, T.quantity, T.returned, T.lines, T.events, T.nations


# Unary functions

for _i, _name in enumerate(("exp", "ln", "round", "abs", "sin", "asin", "sinh", "cos", "acos", "cosh", "tan", "atan", "tanh"), 1):
    if _name == "ln":
        query("u02_ln", f"SELECT c0, c1, {_rounded('ln(abs(v))')} AS v FROM e", lambda s, d: E(s, d).abs().ln(), DIGITS)
    elif _name == "round":
        query("u03_round", "SELECT c0, c1, round(v * 8) + 0.0 AS v FROM e", lambda s, d: shown(E(s, d).mul_scalar(8).round().rows(), 0))
    else:
        query(f"u{_i:02}_{_name}", f"SELECT c0, c1, {_rounded(f'{_name}(v)')} AS v FROM e", lambda s, d, n=_name: E(s, d).unary(n), DIGITS)
query("u14_not_nations", f"SELECT c0, c1, (v = 0)::SMALLINT AS v FROM {_NGRID}", lambda s, d: N(s, d).into_dense().not_())
query("u15_is_nan", "SELECT c0, c1, isnan(x)::SMALLINT AS v FROM (SELECT c0, c1, CASE WHEN v > 0.2 THEN 'nan'::DOUBLE ELSE v END AS x FROM e)", lambda s, d: _with_special(E(s, d), float("nan")).is_nan())
query("u16_is_inf", "SELECT c0, c1, (v > 0.2)::SMALLINT AS v FROM e", lambda s, d: _with_special(E(s, d), float("inf")).is_inf())
query("u17_cast_f64_i32", "SELECT c0, c1, trunc(v * 1000)::INTEGER AS v FROM e", lambda s, d: E(s, d).mul_scalar(1000).cast("i32"))
query("u17_cast_f64_u8", "SELECT c0, c1, (CASE WHEN v <= 0 THEN 0 ELSE trunc(v * 1000)::BIGINT % 256 END)::SMALLINT AS v FROM e", lambda s, d: E(s, d).mul_scalar(1000).cast("u8"))
query("u17_cast_i32_i8", "SELECT c0, c1, (((v::BIGINT + 128) % 256) - 128)::TINYINT AS v FROM q WHERE ((v::BIGINT + 128) % 256) <> 128", lambda s, d: Q(s, d).cast("i32").cast("i8"))


def _wrapped(x: str, kind: str, bits: int) -> str:
    """An integer by its low bits."""
    low, half = f"(({x}) % {1 << bits}::HUGEINT + {1 << bits}::HUGEINT) % {1 << bits}::HUGEINT", 1 << (bits - 1)
    return f"({low})" if kind == "u" else f"((({low}) + {half}::HUGEINT) % {1 << bits}::HUGEINT - {half}::HUGEINT)"


def _cast_sql(x: str, a: D.DType, b: D.DType) -> str:
    """What a whole number of type a is as type b (a HUGEINT, or a DOUBLE where a float takes part)."""
    if a == b or not (a.integer or b.integer):
        return f"({x})::DOUBLE"
    if a.integer and b.integer:
        return f"{_wrapped(_wrapped(x, b.kind, a.bits) if a.kind != b.kind and a.bits < 64 else x, b.kind, b.bits)}::DOUBLE"
    if a.integer:
        return f"({x})::FLOAT::DOUBLE"
    return f"(CASE WHEN {x} < 0 THEN {0 if b.kind == 'u' else _wrapped(x, 'i', b.bits)} ELSE {_wrapped(x, b.kind, b.bits)} END)::DOUBLE"


_BASE = "(c0 * 37 - 300)"
_PAIRS = [(a, b) for a in D.DTYPES.values() for b in D.DTYPES.values()]
_CASTS = " UNION ALL ".join(
    f"SELECT '{a.name}' AS a, '{b.name}' AS b, c0, c1, {_cast_sql(_wrapped(f'{_BASE}::HUGEINT', a.kind, a.bits) if a.integer else f'{_BASE}::HUGEINT', a, b)} AS v FROM n" for a, b in _PAIRS
)


def _cast_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every dtype to every other: the nations' numbers, some below 0 and some past a byte."""
    t = N(s, d)
    t = t.like(t.frame, (F.col("c0") * 37 - 300).cast("long"), dtype="i64")
    columns = []
    for a, b in _PAIRS:
        v = t.cast(a).cast(b).value
        v = v["re"] if b.kind == "c" else v
        columns.append(F.struct(F.lit(a.name).alias("a"), F.lit(b.name).alias("b"), v.cast("double").alias("v")))
    return t.frame.select("c0", "c1", F.explode(F.array(*columns)).alias("x")).select("x.a", "x.b", "c0", "c1", "x.v")


query("u17_cast_pairs_nations", _CASTS, _cast_pairs)


def _with_special(t: Tensor, value: float) -> Tensor:
    return t.like(t.frame, F.when(t.value > 0.2, F.lit(value)).otherwise(t.value))


def _complex(t: Tensor, im=None) -> Tensor:
    im = F.lit(0.0) if im is None else im
    return t.like(t.frame, D.make(t.value, im, D.DTYPES["c64"]), dtype="c64")


def _parts(t: Tensor, digits: int = DIGITS) -> DataFrame:
    df = t.rows()
    return df.select(*t.axes, *(((F.round(F.col(f"v.{p}"), digits)) + F.lit(0.0)).alias(p) for p in ("re", "im")))


def Z(s: SparkSession, d: str) -> Tensor:
    """Complex: the embeddings, with their tripled values minus a tenth as imaginary parts."""
    return E(s, d).map(lambda v: D.make(v, v * 3 - 0.1, D.DTYPES["c64"]), "c64")


_Z = "(SELECT c0, c1, v AS re, v * 3 - 0.1 AS im FROM e)"
query("u18_conj", f"SELECT c0, c1, {_rounded('re')} AS re, {_rounded('-im')} AS im FROM {_Z}", lambda s, d: _parts(Z(s, d).conj()))
query("u19_re", f"SELECT c0, c1, {_rounded('re')} AS v FROM {_Z}", lambda s, d: Z(s, d).re(), DIGITS)
query("u20_im", f"SELECT c0, c1, {_rounded('im')} AS v FROM {_Z}", lambda s, d: Z(s, d).im(), DIGITS)
query("u21_angle", f"SELECT c0, c1, {_rounded('atan2(im, re)')} AS v FROM {_Z}", lambda s, d: Z(s, d).angle(), DIGITS)
query("u04_abs_complex", f"SELECT c0, c1, {_rounded('sqrt(re * re + im * im)')} AS v FROM {_Z}", lambda s, d: Z(s, d).abs(), DIGITS)
query("u01_exp_complex", f"SELECT c0, c1, {_rounded('exp(re) * cos(im)')} AS re, {_rounded('exp(re) * sin(im)')} AS im FROM {_Z}", lambda s, d: _parts(Z(s, d).exp()))

# Binary arithmetic

_TWO = "(SELECT c0, c1, coalesce(q.v, 0) AS a, coalesce(r.v, 0) AS b FROM q FULL JOIN r USING (c0, c1))"
_FLIP = "(SELECT x.c0, x.c1, x.v AS a, y.v AS b FROM e x JOIN e y ON y.c0 = (SELECT count(*) FROM embeddings) - 1 - x.c0 AND y.c1 = x.c1)"


def _sparse_pair(s, d):
    return Q(s, d), R(s, d)


def _dense_pair(s, d):
    t = E(s, d)
    return t, t.flip(0)


for _i, (_name, _sign) in enumerate((("add", "+"), ("sub", "-"), ("mul", "*")), 1):
    query(f"b{_i}_{_name}_sparse", f"SELECT c0, c1, a {_sign} b AS v FROM {_TWO} WHERE a {_sign} b <> 0", lambda s, d, n=_name: (lambda p: p[0].binary(n, p[1]))(_sparse_pair(s, d)))
    query(f"b{_i}_{_name}_dense", f"SELECT c0, c1, {_rounded(f'a {_sign} b')} AS v FROM {_FLIP}", lambda s, d, n=_name: (lambda p: p[0].binary(n, p[1]))(_dense_pair(s, d)), DIGITS)
for _i, _name, _sql in (
    (4, "div", "a / b"),
    (5, "pow", "pow(a, b)"),
    (6, "log", "ln(a) / ln(b)"),
    (7, "rem", "a % b"),
):
    _digits = 4 if _name == "log" else DIGITS
    query(
        f"b{_i}_{_name}",
        f"SELECT c0, c1, {_rounded(_sql, _digits)} AS v FROM (SELECT c0, c1, abs(a) + 1.5 AS a, abs(b) + 1.25 AS b FROM {_FLIP})",
        lambda s, d, n=_name: (lambda p: p[0].abs().add_scalar(1.5).binary(n, p[1].abs().add_scalar(1.25)))(_dense_pair(s, d)),
        _digits,
    )
query("b1_add_mixed_nations", f"SELECT c0, c1, (v + 1)::INTEGER AS v FROM {_NGRID}", lambda s, d: frames.fill(frames.create(s, (25, 5), "i32"), 1).add(N(s, d)))
query("b4_div_int", "SELECT c0, c1, (a // b)::INTEGER AS v FROM (SELECT c0, c1, a::BIGINT AS a, b::BIGINT AS b FROM " + _TWO + ") WHERE b <> 0 AND a // b <> 0", lambda s, d: Q(s, d).cast("i32").div(R(s, d).cast("i32")))
query("b7_rem_int", "SELECT c0, c1, (a % b)::INTEGER AS v FROM (SELECT c0, c1, a::BIGINT AS a, b::BIGINT AS b FROM " + _TWO + ") WHERE b <> 0 AND a % b <> 0", lambda s, d: Q(s, d).cast("i32").rem(R(s, d).cast("i32")))
query(
    "b3_mul_wrap_i64",
    "SELECT c0, c1, ((w + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS v FROM (SELECT c0, c1, v::HUGEINT * 1152921504606846983::HUGEINT AS w FROM q)",
    lambda s, d: Q(s, d).cast("i64").mul_scalar(1152921504606846983),
)
query("b5_pow_u8", "SELECT c0, c1, ((v::BIGINT % 256) * (v::BIGINT % 256) % 256 * (v::BIGINT % 256) % 256)::SMALLINT AS v FROM q WHERE (v::BIGINT % 256) * (v::BIGINT % 256) % 256 * (v::BIGINT % 256) % 256 <> 0", lambda s, d: Q(s, d).cast("u32").cast("u8").pow_scalar(3))

# Scalars

for _i, (_name, _sql, _value) in enumerate(
    (("add", "v + 2.5", 2.5), ("sub", "v - 2.5", 2.5), ("mul", "v * 2.5", 2.5), ("div", "v / 2.5", 2.5), ("pow", "pow(v, 3)", 3.0), ("log", "ln(abs(v)) / ln(2.5)", 2.5), ("rem", "v % 0.125", 0.125)), 1
):
    query(f"a{_i}_{_name}_scalar", f"SELECT c0, c1, {_rounded(_sql)} AS v FROM e", lambda s, d, n=_name, x=_value: (E(s, d).abs() if n == "log" else E(s, d)).scalar(n, x), DIGITS)

# Predicates and conditions

for _i, (_name, _sign) in enumerate((("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")), 1):
    query(f"p{_i:02}_{_name}", f"SELECT c0, c1, (a {_sign} b)::SMALLINT AS v FROM {_FLIP}", lambda s, d, n=_name: (lambda p: p[0].binary(n, p[1]))(_dense_pair(s, d)))
    query(f"p{_i + 9}_{_name}_scalar_nations", f"SELECT c0, c1, (v {_sign} 1)::SMALLINT AS v FROM {_NGRID}", lambda s, d, n=_name: N(s, d).into_dense().scalar(n, 1))
query("p03_gt_sparse", f"SELECT c0, c1, 1::SMALLINT AS v FROM {_TWO} WHERE a > b", lambda s, d: Q(s, d).gt(R(s, d)))
for _i, (_name, _sql) in enumerate((("and", "a <> 0 AND b <> 0"), ("or", "a <> 0 OR b <> 0"), ("xor", "(a <> 0) <> (b <> 0)")), 7):
    query(f"p{_i:02}_{_name}", f"SELECT c0, c1, 1::SMALLINT AS v FROM {_TWO} WHERE {_sql}", lambda s, d, n=_name: (lambda p: p[0].binary(n, p[1]))(_sparse_pair(s, d)))
    query(f"p{_i + 9}_{_name}_scalar", "SELECT c0, c1, 1::SMALLINT AS v FROM q" if _name != "and" else "SELECT c0, c1, 1::SMALLINT AS v FROM q WHERE v <> 0", lambda s, d, n=_name: Q(s, d).scalar(n, 3.0 if n == "and" else 0.0))
query("p19_cond", f"SELECT c0, c1, {_rounded('CASE WHEN v > 0 THEN v ELSE 0 END')} AS v FROM e", lambda s, d: (lambda t: t.gt_scalar(0.0).cond(t, t.mul_scalar(0.0)))(E(s, d)), DIGITS)
query("p19_cond_sparse", f"SELECT c0, c1, CASE WHEN b <> 0 THEN b ELSE a END AS v FROM {_TWO}", lambda s, d: (lambda q, r: r.ne_scalar(0.0).cond(r, q))(*_sparse_pair(s, d)))

# Reductions

_ALL = {
    "sum": "sum(v)",
    "min": "min(v)",
    "max": "max(v)",
    "mean": _rounded("avg(v)"),
    "std": _rounded("stddev_pop(v)"),
    "norm": _rounded("sqrt(sum(v * v))"),
}
for _i, _name in ((1, "sum"), (3, "min"), (4, "max"), (7, "mean"), (8, "std"), (9, "norm")):
    _digits = None if _i < 5 else DIGITS
    query(f"r{_i:02}_{_name}_all", f"SELECT 0::BIGINT AS c0, {_ALL[_name]} AS v FROM grid", lambda s, d, n=_name: reduce(Q(s, d), n).df, _digits)
    _k = _i + 9 if _i < 5 else _i + 7
    if _name == "min":
        continue
    query(f"r{_k}_{_name}_{'axis' if _name != 'sum' else 'axis_shown'}", f"SELECT c0, {_ALL[_name]} AS v FROM grid GROUP BY c0 HAVING {_ALL[_name]} <> 0", lambda s, d, n=_name: (lambda t: t.where("v <> 0"))(shown(reduce(Q(s, d), n, [1]).rows(), DIGITS if n in ("mean", "std", "norm") else None)))
    query(
        f"r{_k}_{_name}_rank3",
        f"SELECT 0::BIGINT AS c0, c1, 0::BIGINT AS c2, {_ALL[_name]} AS v FROM (SELECT c0, c1, c2, coalesce(v, 0) AS v FROM (SELECT range AS c0 FROM range((SELECT max(user_id) + 1 FROM events))) CROSS JOIN (SELECT DISTINCT c1 FROM u) CROSS JOIN (SELECT range AS c2 FROM range((SELECT max(c2) + 1 FROM u))) LEFT JOIN u USING (c0, c1, c2)) GROUP BY c1 HAVING {_ALL[_name]} <> 0",
        lambda s, d, n=_name: reduce(U(s, d), n, [0, 2], keepdims=True),
        _digits,
    )
query("r12_min_axis", "SELECT c0, min(-v) AS v FROM q GROUP BY c0", lambda s, d: reduce(Q(s, d).mul_scalar(-1.0), "min", [1]))
query("r12_min_rank3", "SELECT 0::BIGINT AS c0, c1, 0::BIGINT AS c2, min(-v) AS v FROM u GROUP BY c1", lambda s, d: reduce(U(s, d).mul_scalar(-1.0), "min", [0, 2], keepdims=True))
query("r12_min_dense", f"SELECT c0, {_rounded('min(v)')} AS v FROM e GROUP BY c0", lambda s, d: reduce(E(s, d), "min", [1]), DIGITS)
query("r10_sum_axis", "SELECT c0, sum(v) AS v FROM q GROUP BY c0", lambda s, d: reduce(Q(s, d), "sum", [1]))
query("r02_product_all_nations", f"SELECT 0::BIGINT AS c0, {_rounded('product(1 + v / 100)', 4)} AS v FROM {_NGRID}", lambda s, d: reduce(N(s, d).cast("f64").div_scalar(100.0).into_dense().add_scalar(1.0), "product").df, 4)
query("r11_product_axis", f"SELECT c0, {_rounded('product(1 + v)', 4)} AS v FROM e GROUP BY c0", lambda s, d: reduce(E(s, d).add_scalar(1.0), "product", [1]), 4)
query(
    "r11_product_wrap",
    "SELECT c0, v::SMALLINT AS v FROM (SELECT c0, list_reduce(list(v::BIGINT % 256), lambda x, y: x * y % 256) AS v FROM l GROUP BY c0 HAVING count(*) = 7) WHERE v <> 0",
    lambda s, d: reduce(L(s, d).cast("u32").cast("u8"), "product", [1]),
)
query(
    "r11_product_wrap_i64",
    "SELECT c0, ((v + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS v FROM (SELECT c0, list_reduce(list(v::HUGEINT * 1000003), lambda x, y: x * y % 18446744073709551616::HUGEINT) AS v FROM l GROUP BY c0 HAVING count(*) = 7) WHERE v <> 0",
    lambda s, d: reduce(L(s, d).cast("i64").mul_scalar(1000003), "product", [1]),
)
query("r05_all", "SELECT bool_and(v <> 0) AS v FROM grid", lambda s, d: truth_frame(Q(s, d), "all"))
query("r06_any", "SELECT bool_or(v <> 0) AS v FROM grid", lambda s, d: truth_frame(Q(s, d), "any"))
query("r01_sum_wrap_u8", "SELECT 0::BIGINT AS c0, (sum(v::BIGINT % 256) % 256)::SMALLINT AS v FROM q", lambda s, d: reduce(Q(s, d).cast("u32").cast("u8"), "sum").df)
query("r01_sum_wrap_i64", "SELECT 0::BIGINT AS c0, ((w + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS v FROM (SELECT sum(v::HUGEINT * 4611686018427387) AS w FROM q)", lambda s, d: reduce(Q(s, d).cast("i64").mul_scalar(4611686018427387), "sum").df)

# Geometric transforms

query("g01_slice_at", "SELECT c1 AS c0, v FROM q WHERE c0 = 7", lambda s, d: Q(s, d).slice(At(7)))
query("g02_slice_in", "SELECT (c0 - 1200) // 3 AS c0, c1 - 2 AS c1, v FROM l WHERE c0 BETWEEN 1200 AND 2999 AND (c0 - 1200) % 3 = 0 AND c1 BETWEEN 2 AND 5", lambda s, d: L(s, d).slice(In(1200, 3000, 3), In(2, 6)))
query("g03_slice_of", "SELECT p.n AS c0, c1, v FROM q JOIN (VALUES (5::BIGINT, 0::BIGINT), (3, 1), (5, 2)) p(i, n) ON c0 = p.i", lambda s, d: Q(s, d).slice(Of(5, 3, 5)))
query("g04_transpose", "SELECT c2 AS c0, c0 AS c1, c1 AS c2, v FROM u", lambda s, d: U(s, d).transpose([2, 0, 1]))
query("g05_reshape", "SELECT (c0 * 64 + c1) // 128 AS c0, (c0 * 64 + c1) % 128 AS c1, v FROM e", lambda s, d: (lambda t: t.reshape((t.shape[0] // 2, 128)))(E(s, d)))
query("g06_broadcast_nations", "SELECT range AS c0, c0 AS c1, c1 AS c2, v FROM n CROSS JOIN range(3)", lambda s, d: N(s, d).broadcast((3, 25, 5)))
query("g07_flip", "SELECT c0, 6 - c1 AS c1, v FROM l", lambda s, d: L(s, d).flip(1))
query("g08_squeeze", "SELECT c1 AS c0, v FROM q WHERE c0 = 11", lambda s, d: Q(s, d).slice(In(11, 12)).squeeze([0]))
query("g09_unsqueeze_nations", "SELECT 0::BIGINT AS c0, c0 AS c1, 0::BIGINT AS c2, c1 AS c3, v FROM n", lambda s, d: N(s, d).unsqueeze([0, 1]))
query("g12_into_dense_nations", f"SELECT c0, c1, v FROM {_NGRID}", lambda s, d: N(s, d).into_dense())
query("g10_write_through", "SELECT * FROM (VALUES ('base', true, true), ('slice', false, true), ('gather', false, false), ('expansion', false, false)) t(view, base, writable)", lambda s, d: (lambda t: s.createDataFrame([(k, x.is_base_tensor, x.supports_write_through) for k, x in (("base", t), ("slice", t.slice(In(0, 24, 2))), ("gather", t.slice(Of(3, 1))), ("expansion", t.broadcast((2, 25, 5))))], "view string, base boolean, writable boolean"))(N(s, d)))
query("g11_shape_algebra", "SELECT '4 3 5' AS both, '0 1' AS reduced, '2 6 7' AS product", lambda s, d: s.createDataFrame([tuple(" ".join(map(str, x)) for x in (G.broadcast_shape((3, 1), (4, 1, 5)), G.broadcast_reduce_axes((1, 5), (4, 3, 5)), G.matmul_output_shape((2, 6, 4), (2, 4, 7))))], "both string, reduced string, product string"))
query("g02_g07_g04_mixed", "SELECT 6 - c1 AS c0, (c0 - 10) // 3 AS c1, v FROM l WHERE c0 >= 10 AND (c0 - 10) % 3 = 0", lambda s, d: L(s, d).slice(In(10, 4000, 3)).flip(1).transpose())

# Matrices and Fourier transforms

query("m1_matmul_sparse", "SELECT x.c1 AS c0, y.c1 AS c1, sum(x.v * y.v) AS v FROM q x JOIN q y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mt().matmul(t))(Q(s, d)))
query("m1_matmul_dense", f"SELECT x.c1 AS c0, y.c1 AS c1, {_rounded('sum(x.v * y.v)')} AS v FROM e x JOIN e y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mt().matmul(t))(E(s, d)), DIGITS)
query("m1_matmul_tiles", f"SELECT x.c1 AS c0, y.c1 AS c1, {_rounded('sum(x.v * y.v)')} AS v FROM e x JOIN e y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mt().matmul(t, "tiles"))(E(s, d)), DIGITS)
query("m1_matmul_int_nations", "SELECT x.c1 AS c0, y.c1 AS c1, sum(x.v * y.v)::INTEGER AS v FROM n x JOIN n y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mt().matmul(t))(N(s, d)))
query("m1_matmul_batched", "SELECT x.c0, x.c1, y.c1 AS c2, sum(x.v * y.v) AS v FROM u x JOIN u y ON x.c0 = y.c0 AND x.c2 = y.c2 GROUP BY 1, 2, 3", lambda s, d: (lambda t: t.matmul(t.mt()))(U(s, d)))
query("m3_mt", "SELECT c0, c2 AS c1, c1 AS c2, v FROM u", lambda s, d: U(s, d).mt())
query("m4_diag", f"SELECT c1 AS c0, {_rounded('sum(v * v)')} AS v FROM e GROUP BY 1", lambda s, d: (lambda t: t.mt().matmul(t).diag())(E(s, d)), DIGITS)
query("m5_mh", f"SELECT c1 AS c0, c0 AS c1, {_rounded('re')} AS re, {_rounded('-im')} AS im FROM {_Z}", lambda s, d: _parts(Z(s, d).mh()))


def _dft(sign: str, rows: str = "e") -> str:
    turn = f"{sign}2 * pi() * ((c1 * f) % 64) / 64"
    return (
        f"SELECT c0, f AS c1, {_rounded(f'sum(re * cos({turn}) - im * sin({turn}))', 4)} AS re, {_rounded(f'sum(re * sin({turn}) + im * cos({turn}))', 4)} AS im "
        f"FROM {_Z} CROSS JOIN (SELECT range AS f FROM range(64)) GROUP BY 1, 2"
    )


query("f1_fft", _dft("-"), lambda s, d: _parts(Z(s, d).fft(), 4))
query("f1_fft_join", _dft("-"), lambda s, d: _parts(fourier.dft_join(Z(s, d)), 4))
query("f2_ifft", _dft(""), lambda s, d: _parts(Z(s, d).ifft(), 4))


def _dft2(sign: str) -> str:
    t = f"(SELECT c0 AS a, c1 AS b, v * 2 AS re, v * 6 - 0.1 AS im FROM {_NGRID})"
    turn = f"{sign}2 * pi() * (((a * f) % 25) / 25.0 + ((b * g) % 5) / 5.0)"
    return (
        f"SELECT f AS c0, g AS c1, {_rounded(f'sum(re * cos({turn}) - im * sin({turn}))', 4)} AS re, {_rounded(f'sum(re * sin({turn}) + im * cos({turn}))', 4)} AS im "
        f"FROM {t} CROSS JOIN (SELECT range AS f FROM range(25)) CROSS JOIN (SELECT range AS g FROM range(5)) GROUP BY 1, 2"
    )


def _nations_complex(s: SparkSession, d: str) -> Tensor:
    t = N(s, d).cast("f64").into_dense().mul_scalar(2.0)
    return _complex(t, t.value * 3 - 0.1)


query("f3_fft2_nations", _dft2("-"), lambda s, d: _parts(_nations_complex(s, d).fft2(), 4))
query("f4_ifft2_nations", _dft2(""), lambda s, d: _parts(_nations_complex(s, d).ifft2(), 4))

# Sources, sinks and storage


def _path(s: SparkSession) -> str:
    return scratch_path(s, "tensor")


def _validated(t: store.Stored) -> Tensor:
    t.validate()
    store.sync_all([t])
    return t


def _every_second(s: SparkSession, d: str) -> tuple[View, Tensor]:
    """Every second embedding with its components from last to first, and the doubled embeddings to write there."""
    t = E(s, d)
    part = In(0, t.shape[0], 2)
    return View(t).flip(1).slice(part), t.slice(part).mul_scalar(2.0)


def _visited(s: SparkSession, d: str) -> DataFrame:
    """The sums of some blocks, one block at a time."""
    out = []
    store.visit_blocks(store.write(N(s, d), _path(s), capacity=1), range(0, 125, 6), lambda block, values: out.append((block, sum(values))), 1)
    return s.createDataFrame(out, "block long, total long")


_QROWS = "SELECT c0, c1, v FROM q"
query("s01_create", "SELECT a.range AS c0, b.range AS c1, 0::DOUBLE AS v FROM range(30) a CROSS JOIN range(40) b", lambda s, d: frames.create(s, (30, 40)))
query("s02_create_with_geometry", "SELECT a.range AS c0, b.range AS c1, 0::INTEGER AS v FROM range(9) a CROSS JOIN range(11) b", lambda s, d: store.create_with_geometry(s, _path(s), (9, 11), "i32", capacity=7))
query("s08_validate", _QROWS, lambda s, d: _validated(store.write(Q(s, d), _path(s))))
query("s19_visit_blocks", f"SELECT c0 * 5 + c1 AS block, v::BIGINT AS total FROM {_NGRID} WHERE (c0 * 5 + c1) % 6 = 0", _visited)
query("s20_occupied_stored", "SELECT DISTINCT (c0 * 7 + c1) AS block FROM l WHERE c0 BETWEEN 500 AND 1500 AND c1 IN (1, 4)", lambda s, d: store.occupied_blocks(store.write(L(s, d), _path(s)), [In(500, 1501), Of(4, 1)]))
query("s22_updates_from", f"SELECT c0, 63 - c1 AS c1, {_rounded('2 * v')} AS v, (c0 * 64 + 63 - c1) // 4096 AS block, (c0 * 64 + 63 - c1) % 4096 AS \"offset\" FROM e WHERE c0 % 2 = 0", lambda s, d: (lambda x: x[0].updates_from(x[1]))(_every_second(s, d)), DIGITS)
query("s22_write_from", f"SELECT c0, 63 - c1 AS c1, {_rounded('2 * v')} AS v FROM e WHERE c0 % 2 = 0 UNION ALL SELECT c0, c1, {_rounded('v')} FROM e WHERE c0 % 2 = 1", lambda s, d: (lambda x: x[0].write(x[1]).source)(_every_second(s, d)), DIGITS)
query("s23_logical_block_range", "SELECT 6::BIGINT AS first, 13::BIGINT AS stop", lambda s, d: s.createDataFrame([View(E(s, d)).slice(In(10, 20)).logical_block_range(100)], "first long, stop long"))
query("s24_resolve_base_coord", "SELECT 4 - c0 AS c0, c1, c0 AS b1, c1 AS b0 FROM (SELECT a.range AS c0, b.range AS c1 FROM range(5) a CROSS JOIN range(25) b)", lambda s, d: (lambda x: s.createDataFrame([(*c, *reversed(x.resolve_base_coord(c))) for c in G.row_major_coords(x.tensor.shape)], "c0 long, c1 long, b1 long, b0 long"))(View(N(s, d)).transpose().flip(0)))
query("s29_metadata", "SELECT 'i32' AS dtype, 25::BIGINT AS rows, 5::BIGINT AS columns, true AS sparse, 4096::BIGINT AS capacity, 'parquet' AS format", lambda s, d: (lambda m: s.createDataFrame([(m["dtype"], *m["shape"], m["sparse"], m["capacity"], m["format"])], "dtype string, rows long, columns long, sparse boolean, capacity long, format string"))(store.write(N(s, d), _path(s)).meta))
query("s03_from_values", "SELECT range // 10 AS c0, range % 10 AS c1, (range * 7 % 11)::INTEGER AS v FROM range(100)", lambda s, d: frames.from_values(s, (10, 10), [i * 7 % 11 for i in range(100)], "i32"))
query("s04_from_sparse_elements", "SELECT range AS c0, range * 2 AS c1, (range + 1)::DOUBLE AS v FROM range(50)", lambda s, d: frames.from_sparse_elements(s, (50, 100), [((i, 2 * i), i + 1) for i in range(50)]))
query("s05_copy_from", _QROWS, lambda s, d: store.copy_from(Q(s, d), _path(s), sparse=True))
query("s06_copy_from_values_nations", f"SELECT c0, c1, v FROM {_NGRID}", lambda s, d: store.copy_from_values(N(s, d), _path(s)))
query("s06_dense_to_sparse", "SELECT c0, c1, CASE WHEN v > 0.1 THEN v ELSE 0 END AS v FROM e WHERE v > 0.1", lambda s, d: store.copy_from_values((lambda t: t.gt_scalar(0.1).cond(t, t.mul_scalar(0.0)))(E(s, d)), _path(s), sparse=True))
query("s07_load", _QROWS, lambda s, d: store.load(s, store.write(Q(s, d), _path(s)).path))
query("s10_read_value", "SELECT coalesce((SELECT v FROM q WHERE c0 = 3 AND c1 = 5), 0) AS v", lambda s, d: s.createDataFrame([(Q(s, d).read_value((3, 5)),)], "v double"))
query("s11_read_blocks_nations", f"SELECT c0 * 5 + c1 AS at, v FROM {_NGRID}", lambda s, d: s.createDataFrame(list(enumerate(v for b in batches.read_blocks(N(s, d)) for v in b)), "at long, v int"))
query("s12_read_coordinate_blocks", f"SELECT c0, c1, v FROM {_NGRID}", lambda s, d: s.createDataFrame([(*c, v) for b in batches.read_coordinate_blocks(N(s, d)) for c, v in b], "c0 long, c1 long, v int"))
query("s14_into_blocks", "SELECT c0, c1, v FROM n", lambda s, d: s.createDataFrame([(*c, v) for b in batches.into_sparse_elements(N(s, d)) for c, v in b], "c0 long, c1 long, v int"))
query("s13_sparse_elements", "SELECT c0, c1, v FROM q WHERE c0 IN (3, 9, 40) AND c1 BETWEEN 2 AND (SELECT count(*) FROM supplier) // 2", lambda s, d: (lambda t: batches.sparse_elements_frame(t, [Of(9, 3, 9, 40), In(2, t.shape[1] // 2 + 1)]))(Q(s, d)))
query("s15_write_value", "SELECT c0, c1, CASE WHEN c0 = 2 AND c1 = 3 THEN 77 ELSE v END AS v FROM grid WHERE (c0 = 2 AND c1 = 3) OR v <> 0", lambda s, d: store.write_value(Q(s, d), (2, 3), 77.0))
query("s16_write_values", "SELECT c0, c1, CASE c0 WHEN 5 THEN 7.0 WHEN 1 THEN 4.0 ELSE v END AS v FROM grid WHERE c1 = 0 AND (v <> 0 OR c0 IN (1, 5))", lambda s, d: store.write_values(Q(s, d), [Of(5, 1, 5), At(0)], [3.0, 4.0, 7.0]).slice(In(0, Q(s, d).shape[0]), In(0, 1)))
query("s17_fill", "SELECT a.range AS c0, b.range AS c1, 2.5::DOUBLE AS v FROM range(25) a CROSS JOIN range(5) b", lambda s, d: frames.fill(N(s, d).cast("f64"), 2.5))
query("s18_replace_block", "SELECT c0, c1, CASE WHEN c0 = 0 THEN 9 ELSE v END AS v FROM n WHERE c0 <> 0 UNION ALL SELECT 0::BIGINT, range, 9 FROM range(5)", lambda s, d: store.replace_logical_block(N(s, d).into_sparse(0), 0, [9] * 5))
query("s19_read_block", "SELECT (c0 * 64 + c1) // 4096 AS block, (c0 * 64 + c1) % 4096 AS \"offset\", v FROM e WHERE (c0 * 64 + c1) // 4096 IN (1, 3)", lambda s, d: store.read_logical_blocks(E(s, d), [1, 3]))
query("s20_occupied_blocks", "SELECT DISTINCT (c0 * 7 + c1) AS block FROM l", lambda s, d: store.occupied_blocks(L(s, d)))
query("s21_block_position", "SELECT c0, c1, (c0 * 7 + c1) // 7 AS block, (c0 * 7 + c1) % 7 AS \"offset\" FROM l", lambda s, d: (lambda t: t.rows().select("c0", "c1", *(c.alias(n) for c, n in zip(store.block_columns(StorageGeometry(t.shape, True, 0)), ("block", "offset")))))(L(s, d)))
query("s22_flat_index", "SELECT c0 * 7 + c1 AS flat, v FROM l", lambda s, d: (lambda t: t.rows().select(flat_index(t.shape).alias("flat"), "v"))(L(s, d)))
query("s26_row_major_coords", "SELECT range // 20 AS c0, range // 5 % 4 AS c1, range % 5 AS c2 FROM range(60)", lambda s, d: frames.create(s, (3, 4, 5)).grid())
query("s27_from_dataframe", "SELECT n_nationkey::BIGINT AS c0, n_regionkey::BIGINT AS c1, 1 AS v FROM nation", N)
query("s28_orc", _QROWS, lambda s, d: store.write(Q(s, d), _path(s), kind="orc"))
query("s28_json", _QROWS, lambda s, d: store.write(Q(s, d), _path(s), kind="json"))

# The same operators over larger tables.

query("u14_not", "SELECT c0, c1, (v = 0)::SMALLINT AS v FROM grid", lambda s, d: Q(s, d).into_dense().not_())
query("b1_add_mixed", "SELECT c0, c1, v + 1 AS v FROM grid", lambda s, d: (lambda t: frames.fill(frames.create(s, t.shape), 1.0).add(t))(Q(s, d)))
for _i, (_name, _sign) in enumerate((("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")), 10):
    query(f"p{_i}_{_name}_scalar", f"SELECT c0, c1, (v {_sign} 10)::SMALLINT AS v FROM grid", lambda s, d, n=_name: Q(s, d).into_dense().scalar(n, 10.0))
query("r02_product_all", f"SELECT 0::BIGINT AS c0, {_rounded('product(1 + v / 100)', 4)} AS v FROM e", lambda s, d: reduce(E(s, d).div_scalar(100.0).add_scalar(1.0), "product").df, 4)
query("g12_into_dense", "SELECT c0, c1, v FROM grid", lambda s, d: Q(s, d).into_dense())
query("m1_matmul_tiles_rows", f"SELECT x.c0 AS c0, y.c0 AS c1, {_rounded('sum(x.v * y.v)')} AS v FROM e x JOIN e y ON x.c1 = y.c1 GROUP BY 1, 2", lambda s, d: (lambda t: t.matmul(t.mt(), "tiles"))(E(s, d)), DIGITS)
query("s06_copy_from_values", "SELECT c0, c1, v FROM grid", lambda s, d: store.copy_from_values(Q(s, d), _path(s)))
query("s11_read_blocks", "SELECT c0, c1, v FROM grid", lambda s, d: Q(s, d).row_major())


def _planes(t: Tensor) -> Tensor:
    """All rows as planes [n / k, k, 64]; k is the largest divisor of n up to 16."""
    n, width = t.shape
    k = max(k for k in range(1, 17) if n % k == 0)
    return t.reshape((n // k, k, width))


def _dft2_planes(sign: str) -> str:
    k = "(SELECT max(range) FROM range(1, 17) WHERE (SELECT count(*) FROM embeddings) % range = 0)"
    rows = f"(SELECT c0 // k AS p, c0 % k AS a, c1 AS b, k, v AS re, v * 3 - 0.1 AS im FROM e CROSS JOIN (SELECT {k} AS k))"
    turn = f"{sign}2 * pi() * (((a * f) % k) / k::DOUBLE + ((b * g) % 64) / 64.0)"
    return (
        f"SELECT p AS c0, f AS c1, g AS c2, {_rounded(f'sum(re * cos({turn}) - im * sin({turn}))', 4)} AS re, {_rounded(f'sum(re * sin({turn}) + im * cos({turn}))', 4)} AS im "
        f"FROM {rows} JOIN (SELECT range AS f FROM range(16)) ON f < k CROSS JOIN (SELECT range AS g FROM range(64)) GROUP BY 1, 2, 3"
    )


query("f3_fft2", _dft2_planes("-"), lambda s, d: _parts(_planes(Z(s, d)).fft2(), 4))
query("f4_ifft2", _dft2_planes(""), lambda s, d: _parts(_planes(Z(s, d)).ifft2(), 4))


def _casts_counted(s: SparkSession, d: str) -> DataFrame:
    """Every dtype to every other: days and lines as numbers, some below 0 and some past two bytes; bounds, number and sum of each pair's values."""
    t = L(s, d)
    t = t.like(t.frame, (F.col("c0") * 37 - F.col("c1") * 20000 - 300).cast("long"), dtype="i64")
    out = None
    for a in D.DTYPES.values():  # the generated code of one of them at a time; the tables' exchange is shared
        columns = []
        for b in D.DTYPES.values():
            v = t.cast(a).cast(b).value
            columns.append(F.struct(F.lit(b.name).alias("b"), (v["re"] if b.kind == "c" else v).cast("double").alias("v")))
        some = t.frame.select(F.lit(a.name).alias("a"), F.explode(F.array(*columns)).alias("x"))
        out = some if out is None else out.union(some)
    small = F.abs("v") < 9e12  # whose sums are exact
    return out.select("a", "x.b", "x.v").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("v").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.when(small, F.col("v")).otherwise(0.0)).alias("small"))


_LINES = "(c0 * 37 - c1 * 20000 - 300)"
_CASTS_COUNTED = " UNION ALL ".join(
    f"SELECT '{a.name}' AS a, '{b.name}' AS b, {_cast_sql(_wrapped(f'{_LINES}::HUGEINT', a.kind, a.bits) if a.integer else f'{_LINES}::HUGEINT', a, b)} AS v FROM l" for a, b in _PAIRS
)
query("u17_cast_pairs", f"SELECT a, b, count(*) AS cells, count(DISTINCT v) AS values, min(v) AS low, max(v) AS high, sum(CASE WHEN abs(v) < 9e12 THEN v ELSE 0 END) AS small FROM ({_CASTS_COUNTED}) GROUP BY a, b", _casts_counted)
query("g06_broadcast", "SELECT range AS c0, c0 AS c1, c1 AS c2, v FROM l CROSS JOIN range(3)", lambda s, d: (lambda t: t.broadcast((3, *t.shape)))(L(s, d)))
query("g06_broadcast_sub", f"SELECT c0, c1, {_rounded('v - m')} AS v FROM e JOIN (SELECT c1, avg(v) AS m FROM e GROUP BY c1) AS x USING (c1)", lambda s, d: (lambda t: t.sub(t.mean([0]).broadcast(t.shape)))(E(s, d)), DIGITS)
query("g06_broadcast_cond", f"SELECT c0, c1, {_rounded('CASE WHEN v > m THEN v ELSE w END')} AS v FROM e JOIN (SELECT c0, avg(v) AS m FROM e GROUP BY c0) AS x USING (c0) JOIN (SELECT c1, max(v) AS w FROM e GROUP BY c1) AS y USING (c1)", lambda s, d: (lambda t: t.gt(t.mean([1], True).broadcast(t.shape)).cond(t, t.max([0]).broadcast(t.shape)))(E(s, d)), DIGITS)
query("g06_broadcast_sparse", "SELECT c0, c1, v * w AS v FROM q JOIN (SELECT c1, sum(v) AS w FROM q GROUP BY c1) AS x USING (c1)", lambda s, d: (lambda t: t.mul(t.sum([0]).broadcast(t.shape)))(Q(s, d)))
query("g09_unsqueeze", "SELECT 0::BIGINT AS c0, c0 AS c1, 0::BIGINT AS c2, c1 AS c3, v FROM q", lambda s, d: Q(s, d).unsqueeze([0, 1]))
_I64 = lambda w: f"(({w} + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT"
query("m1_matmul_int", f"SELECT x.c1 AS c0, y.c1 AS c1, {_wrapped('sum(x.v::HUGEINT * y.v::HUGEINT)', 'i', 32)}::INTEGER AS v FROM l x JOIN l y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mt().matmul(t))(L(s, d).cast("i32")))
query("m1_matmul_split", "SELECT x.c1 AS c0, y.c1 AS c1, sum(x.v * y.v) AS v FROM q x JOIN q y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mt().matmul(t, "split"))(Q(s, d)))
query("m1_matmul_tiles_i64", f"SELECT x.c1 AS c0, y.c1 AS c1, {_I64('(sum(x.w * y.w) % 18446744073709551616::HUGEINT)')} AS v FROM (SELECT c0, c1, {_I64('(v::HUGEINT * 1152921504606846983::HUGEINT) % 18446744073709551616::HUGEINT')}::HUGEINT % 4294967296 AS w FROM q) x JOIN (SELECT c0, c1, v::HUGEINT AS w FROM q) y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: t.mul_scalar(1152921504606846983).rem_scalar(4294967296).mt().matmul(t, "tiles").into_sparse())(Q(s, d).cast("i64")))
query("m1_matmul_tiles_c64", f"SELECT x.c1 AS c0, y.c1 AS c1, {_rounded('sum(x.re * y.re - x.im * y.im)')} AS re, {_rounded('sum(x.re * y.im + x.im * y.re)')} AS im FROM {_Z} x JOIN {_Z} y ON x.c0 = y.c0 GROUP BY 1, 2", lambda s, d: (lambda t: _parts(t.mt().matmul(t, "tiles")))(Z(s, d)))
query("m4_diag_sparse", "SELECT c0, sum(v * v) AS v FROM q GROUP BY 1", lambda s, d: (lambda t: t.matmul(t.mt()).diag())(Q(s, d)))
query("b1_add_four", "SELECT c0, c1, sum(v) AS v FROM (SELECT * FROM q UNION ALL SELECT * FROM r UNION ALL SELECT l_partkey, l_suppkey, sum(l_quantity) FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2 UNION ALL SELECT l_partkey, l_suppkey, sum(l_quantity) FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) GROUP BY 1, 2", lambda s, d: fold("add", [Q(s, d), *(T.returned(s, d, flag) for flag in "RAN")]))
_SETS = [[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]
_KEPT = [", ".join(f"c{i}" for i in range(3) if i not in over) for over in _SETS]
query("r10_sum_sets", f"SELECT list_position([{', '.join(str(sum(4 >> i for i in over)) for over in _SETS)}], grouping(c0, c1, c2)) - 1 AS \"set\", c0, c1, c2, sum(v) AS v FROM u GROUP BY GROUPING SETS ({', '.join(f'({k})' for k in _KEPT)})", lambda s, d: reduce_sets(U(s, d), "sum", _SETS))
query("r07_mean_sets", f"SELECT list_position([{', '.join(str(sum(4 >> i for i in over)) for over in _SETS)}], grouping(c0, c1, c2)) - 1 AS \"set\", c0, c1, c2, round(sum(v) / (CASE grouping(c0) WHEN 1 THEN (SELECT max(user_id) + 1 FROM events) ELSE 1 END * CASE grouping(c1) WHEN 1 THEN (SELECT count(DISTINCT event_type) FROM events) ELSE 1 END * CASE grouping(c2) WHEN 1 THEN (SELECT max(c2) + 1 FROM u) ELSE 1 END), 9) + 0.0 AS v FROM u GROUP BY GROUPING SETS ({', '.join(f'({k})' for k in _KEPT)})", lambda s, d: shown(reduce_sets(U(s, d), "mean", _SETS), 9))

# Updates in the files


def _banded(t: Tensor, blocks: int) -> store.Stored:
    return store.write(t, _path(t.spark), band_blocks=blocks)


query("s15_write_value_stored", "SELECT c0, c1, CASE WHEN c0 = 2 AND c1 = 3 THEN 77 ELSE v END AS v FROM grid WHERE (c0 = 2 AND c1 = 3) OR v <> 0", lambda s, d: store.load(s, _banded(Q(s, d), 4096).write_value((2, 3), 77.0).path))
query("s16_write_values_stored", f"SELECT c0, c1, CASE WHEN c0 = 5 AND c1 = 8 THEN 7.0 WHEN c0 = 1 AND c1 = 8 THEN 4.0 WHEN c0 = 5 AND c1 = 9 THEN 8.0 WHEN c0 = 1 AND c1 = 9 THEN 5.0 ELSE {_rounded('v')} END AS v FROM e", lambda s, d: store.load(s, _banded(E(s, d), 2).write_values([Of(5, 1, 5), In(8, 10)], [3.0, 3.0, 4.0, 5.0, 7.0, 8.0]).path), DIGITS)
query("s18_replace_block_stored", f"SELECT c0, c1, CASE WHEN c0 * 64 + c1 < 4096 THEN 9.0 ELSE {_rounded('v')} END AS v FROM e", lambda s, d: store.load(s, _banded(E(s, d), 2).replace_block(0, [9.0] * 4096).path), DIGITS)
query("s22_write_through_stored", f"SELECT c0, 63 - c1 AS c1, {_rounded('2 * v')} AS v FROM e WHERE c0 % 2 = 0 UNION ALL SELECT c0, c1, {_rounded('v')} FROM e WHERE c0 % 2 = 1", lambda s, d: (lambda t: store.load(s, _banded(t, 2).write_through([("flip", (1,)), ("slice", (In(0, t.shape[0], 2),))], t.slice(In(0, t.shape[0], 2)).mul_scalar(2.0)).path))(E(s, d)), DIGITS)
query("s05_copy_chain", f"SELECT c0, c1, {_rounded('(v + 1) * v')} AS v FROM e", lambda s, d: (lambda t: store.copy_from(t.add_scalar(1.0).mul(t), _path(s)))(E(s, d)), DIGITS)
