"""Tensor arithmetic on array columns, inside the JVM.

A tensor is struct<shape, dtype, data>; a vector is a plain array.  Integer types
keep their type: division truncates, results saturate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range of each integer type.
RANGE = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1)}
FLOATS = ("float16", "float32", "float64")
_SPARK = {"uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "int32": "int", "int64": "bigint", "float16": "float", "float32": "float", "float64": "double"}


def zeros(n: Column | int) -> Column:
    return full(n, 0.0)


def full(n: Column | int, value: float) -> Column:
    return F.array_repeat(F.lit(value), n if isinstance(n, Column) else F.lit(n))


def arange(start: int, end: int, step: int = 1) -> Column:
    """start, start + step, ... before end."""
    n = max(0, -(-(end - start) // step))
    return F.array(*[]) if not n else F.sequence(F.lit(start), F.lit(start + (n - 1) * step), F.lit(step))


def half_up(x: Column) -> Column:
    """Rounding half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def round_to(x: Column, places: int) -> Column:
    """Half away from zero to decimal places; what rounds to zero keeps its sign (-0.0), as in SQL."""
    return F.signum(x) * F.round(F.abs(x), places)


UNARY = {"round": half_up, "ceil": lambda x: F.ceil(x), "floor": lambda x: F.floor(x), "abs": lambda x: F.abs(x), "minus": lambda x: -x}
BINARY = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b}


def unary(x: Column, op: str) -> Column:
    return F.transform(x, UNARY[op])


def clip(x: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError("clip needs low <= high")
    return F.transform(x, lambda v: F.least(F.lit(high), F.greatest(F.lit(low), v)))


def binary(a: Column, b: Column | float, op: str, dtype: str = "float64") -> Column:
    """Element by element; b may be a number.  Of integer types a quotient is cut towards zero."""
    f = BINARY[op]

    def g(x: Column, y: Column) -> Column:
        return f(x, y) if dtype in FLOATS else cast_one(f(x.cast("double"), y), dtype)

    return F.zip_with(a, b, g) if isinstance(b, Column) else F.transform(a, lambda x: g(x, F.lit(b)))


def cast_one(x: Column, dtype: str) -> Column:
    if dtype in FLOATS:
        return x.cast(_SPARK[dtype])
    low, high = RANGE[dtype]
    return F.least(F.lit(high), F.greatest(F.lit(low), F.signum(x) * F.floor(F.abs(x)))).cast(_SPARK[dtype]) if dtype != "int64" else x.cast("long")


def cast(x: Column, dtype: str) -> Column:
    """To another type, saturated."""
    return F.transform(x, lambda v: cast_one(v, dtype))


def slice_(x: Column, start: int, end: int, step: int = 1) -> Column:
    """Elements start, start + step, ... before end."""
    part = F.slice(x, start + 1, end - start)
    return part if step == 1 else F.filter(part, lambda _, i: i % step == 0)


def select(x: Column, index: int, shape: tuple[int, int], dim: int = 0) -> Column:
    """One row (dim 0) or column (dim 1) of a matrix."""
    rows, cols = shape
    return F.slice(x, index * cols + 1, cols) if dim == 0 else F.filter(x, lambda _, i: i % cols == index)


def reshape(x: Column, shape: tuple[int, int]) -> Column:
    """Rows of a matrix; one side may be -1."""
    rows, cols = shape
    n = F.size(x)
    c = F.floor(n / rows).cast("int") if cols == -1 else F.lit(cols)
    r = F.floor(n / c).cast("int")
    return F.transform(F.sequence(F.lit(0), r - 1), lambda k: F.slice(x, k * c + 1, c))


def flatten(rows: Column) -> Column:
    return F.flatten(rows)


def transpose(x: Column, shape: tuple[int, int]) -> Column:
    """The data of the transposed matrix."""
    rows, cols = shape
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.element_at(x, ((k % rows) * cols + F.floor(k / rows) + 1).cast("int")))


def permute(x: Column, shape: list[int], axes: list[int]) -> Column:
    """The data with its axes in another order."""
    strides = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        strides[k] = strides[k + 1] * shape[k + 1]
    new = [shape[a] for a in axes]
    total = strides[0] * shape[0]

    def source(k: Column) -> Column:
        at, rest = F.lit(0), k
        for size, a in reversed(list(zip(new, axes))):
            at, rest = at + (rest % size) * strides[a], F.floor(rest / size)
        return F.element_at(x, (at + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), source)


def squeeze(shape: list[int], dim: int | None = None) -> list[int]:
    """The shape without its sides of 1, or without side ``dim`` if that is 1; the data stays."""
    if dim is not None:
        dim %= len(shape)
    return [n for k, n in enumerate(shape) if n != 1 or (dim is not None and k != dim)]


def unsqueeze(shape: list[int], dim: int) -> list[int]:
    """The shape with a side of 1 at ``dim``; the data stays."""
    dim = dim if dim >= 0 else dim + len(shape) + 1
    return [*shape[:dim], 1, *shape[dim:]]


def as_strided(x: Column, shape: list[int], strides: list[int], offset: int = 0) -> Column:
    """The data of a view: element (i, j, ...) is the source's at offset + sum of index * stride."""
    total = 1
    for n in shape:
        total *= n

    def source(k: Column) -> Column:
        at, rest = F.lit(offset), k
        for n, stride in reversed(list(zip(shape, strides))):
            at, rest = at + (rest % n) * stride, F.floor(rest / n)
        return F.element_at(x, (at + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), source) if total else F.slice(x, 1, 0)


def expand(x: Column, shape: list[int], new: list[int]) -> Column:
    """The data with sides of 1 repeated to those of ``new``."""
    if len(shape) != len(new) or any(a not in (1, b) for a, b in zip(shape, new)):
        raise ValueError(f"{shape} does not expand to {new}")
    strides, step = [], 1
    for a, b in reversed(list(zip(shape, new))):
        strides.append(0 if a != b else step)
        step *= a
    return as_strided(x, new, strides[::-1])


def vstack(*parts: Column) -> Column:
    """Matrices of equal width, one above the other."""
    return F.concat(*parts)


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def stack(*parts: Column) -> Column:
    return F.array(*parts)


def hstack(a: Column, b: Column, rows: int, cols_a: int, cols_b: int) -> Column:
    """Two matrices side by side."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.concat(F.slice(a, k * cols_a + 1, cols_a), F.slice(b, k * cols_b + 1, cols_b))))


def normalize(x: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean[c]) / std[c] with the channel c innermost."""
    n = len(mean)
    m, s = (F.array(*map(F.lit, v)) for v in (mean, std))
    return F.transform(x, lambda v, i: (v - F.get(m, i % n)) / F.get(s, i % n))


def blend(a: Column, b: Column, alpha: float | Column) -> Column:
    """a * (1 - alpha) + b * alpha."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def linear(a: Column, b: Column, ka: float, kb: float, c: float) -> Column:
    """a * ka + b * kb + c, held to 0..1."""
    return F.zip_with(a, b, lambda x, y: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x * ka + y * kb + c)))


def gamma(x: Column, g: float, top: float = 255.0) -> Column:
    return F.transform(x, lambda v: F.pow(v / top, F.lit(g)) * top)


def mirror(x: Column, width: int, axis: str = "horizontal") -> Column:
    """An image's data reversed along each row, along each column, or both."""
    n = F.size(x)
    rows = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int") - 1), lambda k: F.slice(x, k * width + 1, width))
    if axis in ("horizontal", "both"):
        rows = F.transform(rows, lambda r: F.reverse(r))
    return F.flatten(F.reverse(rows) if axis in ("vertical", "both") else rows)


def nchw_to_nhwc(x: Column, c: int, h: int, w: int) -> Column:
    return permute(x, [c, h, w], [1, 2, 0])


def nhwc_to_nchw(x: Column, h: int, w: int, c: int) -> Column:
    return permute(x, [h, w, c], [2, 0, 1])


def tensor(data: Column, shape: list[int], dtype: str = "float32") -> Column:
    return F.struct(F.array(*map(F.lit, shape)).alias("shape"), F.lit(dtype).alias("dtype"), data.alias("data"))


def echo(x: Column, delay: int, gain: float) -> Column:
    """x plus itself ``delay`` samples later."""
    return F.transform(x, lambda v, i: v + F.when(i >= delay, F.get(x, i - delay)).otherwise(0.0) * gain)


def low_frequency_gain(x: Column, rate: float, hz: float, depth: float) -> Column:
    """Amplitude modulation by a slow sine."""
    return F.transform(x, lambda v, i: v * (1 - depth + depth * (F.sin(i * (2 * 3.141592653589793 * hz / rate)) + 1) / 2))


def peak_normalised(x: Column, peak: float = 1.0) -> Column:
    top = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.when(top > 0, F.element_at(F.transform(F.array(top), lambda t: F.transform(x, lambda v: v * (peak / t))), 1)).otherwise(x)


def robot_voice(x: Column, rate: float, hz: float = 30.0, limit: float = 0.5, echo_ms: int = 100) -> Column:
    """Modulation, hard clipping, echo and peak normalisation (no pitch shift)."""
    return peak_normalised(echo(clip(low_frequency_gain(x, rate, hz, 0.5), -limit, limit), int(rate * echo_ms / 1000), 0.5))
