"""Index maps and coordinates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def floor_div(i: Column, n: int | Column) -> Column:
    """Integer division towards minus infinity."""
    return F.floor((i - F.pmod(i, _c(n))) / _c(n)).cast("long")


def shift_mod(i: Column, k: int, n: int) -> Column:
    """i+k, wrapped into [0, n)."""
    return F.pmod(i + k, _c(n))


def shift_bump(i: Column, k: int, n: int) -> Column:
    """i+k, clamped into [0, n)."""
    return F.least(F.greatest(i + k, _c(0)), _c(n - 1))


def inverse_shift(i: Column, k: int, n: int) -> Column:
    """i-k, null outside [0, n)."""
    return F.when((i - k >= 0) & (i - k < n), i - k)


def shift_to(i: Column, first: Column | int, target: int) -> Column:
    """i rebased so that ``first`` becomes ``target``."""
    return i - _c(first) + target


def spread(i: Column, n: int) -> Column:
    """The block of ``n`` indices that i blows up to, as an array."""
    return F.sequence(i * n, i * n + (n - 1))


def pair_of(i: Column) -> Column:
    """[2i, 2i+1], as an array."""
    return F.array(2 * i, 2 * i + 1)


def contiguous_divide(first: Column, last: Column, stride: Column, n: int) -> Column:
    """A strided range divided by ``n``: (first, last, stride) of the result."""
    small = F.greatest(floor_div(stride, n), _c(1))
    return F.struct(floor_div(first, n).alias("first"), (floor_div(last + stride, n) - small).alias("last"), small.alias("stride"))


def linear(coords: list[Column], shape: list[int]) -> Column:
    """The row-major linear index of coordinates."""
    return reduce(lambda at, x: at * x[1] + x[0], zip(coords[1:], shape[1:], strict=True), coords[0])


def delinear(at: Column, shape: list[int]) -> list[Column]:
    """The coordinates of a row-major linear index."""
    out: list[Column] = []
    for n in reversed(shape[1:]):
        out.append(F.pmod(at, _c(n)))
        at = floor_div(at, n)
    return [at, *reversed(out)]


def span(shape: list[Column]) -> Column:
    """The product of coordinates."""
    return reduce(lambda a, b: a * b, shape)


def block(i: Column, n: int, p: int) -> Column:
    """The block of i when bounds are floor(b*n/p)."""
    return floor_div((i + 1) * p - 1, n)


def block_first_larger(i: Column, n: int, p: int) -> Column:
    """The block of i when sizes differ by one at most and the first are larger."""
    size, rest = divmod(n, p)
    head = rest * (size + 1)
    return F.when(i < head, floor_div(i, size + 1)).otherwise(rest + floor_div(i - head, max(size, 1)))


def cyclic(i: Column, p: int) -> Column:
    return F.pmod(i, _c(p))


def block_cyclic(i: Column, size: int, p: int) -> Column:
    return F.pmod(floor_div(i, size), _c(p))


def on_face(coords: list[Column], shape: list[int]) -> Column:
    """Whether a coordinate lies on any face of its box."""
    return reduce(lambda a, b: a | b, [(c == 0) | (c == n - 1) for c, n in zip(coords, shape, strict=True)])


def split_points(n: int, p: int, first: int = 0) -> list[int]:
    """The p+1 bounds of an even split."""
    return [first + b * n // p for b in range(p + 1)]


def process_grid(p: int, d: int) -> list[int]:
    """``p`` factored into ``d`` sizes as equal as its prime factors allow, largest first."""
    grid, rest, f, primes = [1] * d, p, 2, []
    while rest > 1:
        while rest % f == 0:
            primes.append(f)
            rest //= f
        f += 1
    for f in sorted(primes, reverse=True):
        grid[grid.index(min(grid))] *= f
    return sorted(grid, reverse=True)
