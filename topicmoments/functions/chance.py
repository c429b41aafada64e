"""Random numbers that depend only on a key and a seed, so that any partitioning gives the same ones.

Each function returns a SQL expression; keys are SQL expressions too (a column name, a number).
"""

from __future__ import annotations

import hashlib
import math

_BITS = 52
# Attempts of the rejection sampler; fewer than one in twenty fails, so hardly any draw needs the last one.
ATTEMPTS = 16


def uniform(seed: int, *keys: str | int) -> str:
    """Uniform in (0, 1) from the MD5 of `seed:key:key...`."""
    text = "concat_ws(':', " + ", ".join(f"cast({k} as string)" for k in (seed, *keys)) + ")"
    digits = f"conv(substring(md5({text}), 1, {_BITS // 4}), 16, 10)"
    return f"((cast({digits} as bigint) + 0.5D) / {float(2 ** _BITS)!r}D)"


def gaussian(seed: int, *keys: str | int) -> str:
    """Standard normal by the Box-Muller rule."""
    radius = f"sqrt(-2.0D * ln({uniform(seed, *keys, 0)}))"
    return f"({radius} * cos({2.0 * math.pi!r}D * {uniform(seed, *keys, 1)}))"


def uniform_np(seed: int, *keys: str | int) -> float:
    """The same number for one key, in a task."""
    digits = hashlib.md5(":".join(str(k) for k in (seed, *keys)).encode()).hexdigest()[:_BITS // 4]
    return (int(digits, 16) + 0.5) / 2 ** _BITS


def gaussian_np(seed: int, *keys: str | int) -> float:
    return math.sqrt(-2.0 * math.log(uniform_np(seed, *keys, 0))) * math.cos(2.0 * math.pi * uniform_np(seed, *keys, 1))


def gamma(seed: int, shape: float, *keys: str | int) -> str:
    """Gamma of any positive shape and mean 1.

    Whole shapes are means of exponentials. Others come from a normal number x, cubed as (1 + c x)³, that is kept or
    rejected; the number of the attempt is part of the key, so any partitioning draws the same. A shape below one
    is one more, times a power of a uniform number.
    """
    if float(shape).is_integer():
        return gamma_integer(seed, int(shape), *keys)
    high = shape if shape > 1 else shape + 1
    d = high - 1 / 3
    c = 1 / math.sqrt(9 * d)
    x, u = gaussian(seed, *keys, "attempt", "'x'"), uniform(seed, *keys, "attempt", "'u'")
    kept = (f"transform(array(named_struct('x', {x}, 'v', power(1.0D + {c!r}D * {x}, 3), 'u', {u})), s -> case when s.v > 0 and"
            f" ln(s.u) < 0.5D * s.x * s.x + {d!r}D * (1.0D - s.v + ln(greatest(s.v, 1e-300D))) then s.v end)[0]")
    # an attempt is only made when all before it were rejected
    drawn = f"coalesce(aggregate(sequence(0, {ATTEMPTS - 1}), cast(null as double), (found, attempt) -> coalesce(found, {kept})), 1.0D) * {d!r}D"
    power = "" if shape > 1 else f" * power({uniform(seed, *keys, chr(39) + 'power' + chr(39))}, {1 / shape!r}D)"
    return f"({drawn}{power} / {float(shape)!r}D)"


def gamma_np(seed: int, shape: float, *keys: str | int) -> float:
    """The same number for one key, in a task."""
    if float(shape).is_integer():
        return gamma_integer_np(seed, int(shape), *keys)
    high = shape if shape > 1 else shape + 1
    d = high - 1 / 3
    c = 1 / math.sqrt(9 * d)
    found = 1.0
    for attempt in range(ATTEMPTS):
        x, u = gaussian_np(seed, *keys, attempt, "x"), uniform_np(seed, *keys, attempt, "u")
        v = (1 + c * x) ** 3
        if v > 0 and math.log(u) < 0.5 * x * x + d * (1 - v + math.log(v)):
            found = v
            break
    drawn = found * d
    return (drawn if shape > 1 else drawn * uniform_np(seed, *keys, "power") ** (1 / shape)) / shape


def gamma_integer(seed: int, shape: int, *keys: str | int) -> str:
    """Gamma of an integer shape and mean 1: the mean of `shape` exponentials."""
    draws = [f"ln({uniform(seed, *keys, i)})" for i in range(shape)]
    return f"(-({' + '.join(draws)}) / {float(shape)!r}D)"


def gamma_integer_np(seed: int, shape: int, *keys: str | int) -> float:
    """The same number for one key, in a task."""
    total = 0.0
    for i in range(shape):
        text = ":".join(str(k) for k in (seed, *keys, i))
        digits = hashlib.md5(text.encode()).hexdigest()[:_BITS // 4]
        total += math.log((int(digits, 16) + 0.5) / 2 ** _BITS)
    return -total / shape
