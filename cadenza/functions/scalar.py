"""Decibels, pitch, clamps and rounding as Column expressions. NULL stands for a missing number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def power_db(x: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(EPS)))


def amplitude_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(EPS)))


def from_power_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def loudness(mean_square: Column) -> Column:
    """Loudness units of a mean square; minus infinity for silence."""
    return F.when(mean_square > 0, -0.691 + 10 * F.log10(mean_square)).otherwise(F.lit(float("-inf")))


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def midi(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440)


def hz(note: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (note - 69) / 12)


def note_name(note: Column) -> Column:
    n = half_up(note)
    names = F.array(*map(F.lit, NOTE_NAMES))
    return F.concat(F.element_at(names, (F.pmod(n, F.lit(12)) + 1).cast("int")), (F.floor(n / 12) - 1).cast("string"))


def bell(x: Column, lo: Column | float, hi: Column | float, soft: float) -> Column:
    """1 inside [lo, hi], Gaussian skirts of width `soft` outside."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    off = F.when(x < lo, lo - x).otherwise(x - hi) / soft
    return F.when((x >= lo) & (x <= hi), 1.0).otherwise(F.exp(-0.5 * off * off))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def upper_median(values: Column) -> Column:
    """sorted[n div 2] of an array, which differs from the interpolated median for even n."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minute_second(seconds: Column) -> Column:
    whole = half_up(seconds).cast("long")
    return F.concat((whole / 60).cast("long").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def rotated(profile: list[float], k: Column) -> Column:
    """profile shifted right by k places, circularly."""
    arr = F.array(*map(F.lit, profile))
    n = len(profile)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(arr, F.pmod(i - k, F.lit(n)).cast("int")))


def hann(i: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / n)


def biquad(kind: Column, freq: Column, q: Column, gain: Column, fs: float) -> dict[str, Column]:
    """Coefficients b0 b1 b2 a1 a2 (a0 = 1) of the audio-EQ-cookbook filters, as one expression per coefficient."""
    f = F.least(F.greatest(freq, F.lit(1.0)), F.lit(fs * 0.499))
    a = F.pow(F.lit(10.0), F.coalesce(gain, F.lit(0.0)) / 40)
    w0 = 2 * math.pi * f / fs
    c, alpha = F.cos(w0), F.sin(w0) / (2 * F.coalesce(q, F.lit(math.sqrt(0.5))))
    s = 2 * F.sqrt(a) * alpha
    zero, one = F.lit(0.0), F.lit(1.0)
    high, low = 1 + c, 1 - c
    up, down = (a + 1) + (a - 1) * c, (a + 1) - (a - 1) * c
    table = {
        "lowpass": (low / 2, low, low / 2, 1 + alpha, -2 * c, 1 - alpha),
        "highpass": (high / 2, -high, high / 2, 1 + alpha, -2 * c, 1 - alpha),
        "bandpass": (alpha, zero, -alpha, 1 + alpha, -2 * c, 1 - alpha),
        "notch": (one, -2 * c, one, 1 + alpha, -2 * c, 1 - alpha),
        "peaking": (1 + alpha * a, -2 * c, 1 - alpha * a, 1 + alpha / a, -2 * c, 1 - alpha / a),
        "lowshelf": (a * (down + s), 2 * a * ((a - 1) - (a + 1) * c), a * (down - s), up + s, -2 * ((a - 1) + (a + 1) * c), up - s),
        "highshelf": (a * (up + s), -2 * a * ((a - 1) + (a + 1) * c), a * (up - s), down + s, 2 * ((a - 1) - (a + 1) * c), down - s),
    }
    pick = lambda k: F.coalesce(*(F.when(kind == name, row[k]) for name, row in table.items()))
    a0 = pick(3)
    return {"b0": pick(0) / a0, "b1": pick(1) / a0, "b2": pick(2) / a0, "a1": pick(4) / a0, "a2": pick(5) / a0}


def response_db(k: dict[str, Column], f: Column, fs: float) -> Column:
    """Magnitude of a biquad at frequency f, in dB."""
    w = 2 * math.pi * f / fs
    c1, c2, s1, s2 = F.cos(w), F.cos(2 * w), F.sin(w), F.sin(2 * w)
    num = F.pow(k["b0"] + k["b1"] * c1 + k["b2"] * c2, F.lit(2)) + F.pow(k["b1"] * s1 + k["b2"] * s2, F.lit(2))
    den = F.pow(1 + k["a1"] * c1 + k["a2"] * c2, F.lit(2)) + F.pow(k["a1"] * s1 + k["a2"] * s2, F.lit(2))
    return 10 * F.log10(F.greatest(num / den, F.lit(EPS)))


# Factor, step and seed of the 32-bit congruential generator.
LCG_FACTOR, LCG_STEP, LCG_SEED = 1664525, 1013904223, 22222


def lcg(n: Column, bits: int = 32) -> Column:
    """The n-th state after the seed (n below 2**bits), as a long of 32 bits.

    One step is the map s -> a * s + c; steps of 2, 4, 8, ... are maps of the same form, and those of n's bits are
    applied in turn. Products are made of 16-bit halves, which fit a long.
    """
    modulus, a, c, maps = 1 << 32, LCG_FACTOR, LCG_STEP, []
    long = lambda v, name: F.lit(v).cast("long").alias(name)
    for k in range(bits):
        maps.append(F.struct(long(1 << k, "p"), long(a >> 16, "high"), long(a & 0xFFFF, "low"), long(c, "c")))
        a, c = a * a % modulus, (a * c + c) % modulus

    def step(s: Column, m: Column) -> Column:
        moved = F.pmod(s * m.low + F.pmod(s * m.high, F.lit(1 << 16)) * (1 << 16) + m.c, F.lit(modulus))
        return F.when(F.floor(n / m.p) % 2 == 1, moved).otherwise(s)

    return F.aggregate(F.array(*maps), F.lit(LCG_SEED).cast("long"), step)


# The step of the 32-bit additive generator and its two odd masks.
MULBERRY_STEP, MULBERRY_MASKS = 0x6D2B79F5, (1, 61)


def _times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two unsigned 32-bit longs, by halves that fit a long."""
    high = F.shiftright(a, 16) * b
    return F.pmod(F.pmod(high, F.lit(1 << 16)) * (1 << 16) + F.pmod(a, F.lit(1 << 16)) * b, F.lit(1 << 32))


def mulberry(n: Column, seed: Column) -> Column:
    """The n-th number (from 0, below 2**31) in [0, 1) after a seed of 32 bits. The state is a sum, so each number is
    made on its own."""
    xor = lambda a, b: a.bitwiseXOR(b)
    t = F.pmod(seed + (n + 1) * F.lit(MULBERRY_STEP).cast("long"), F.lit(1 << 32))
    # a lambda's argument is computed once
    named = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    t = named(t, lambda s: _times32(xor(s, F.shiftright(s, 15)), s.bitwiseOR(F.lit(MULBERRY_MASKS[0]).cast("long"))))
    mix = lambda s: F.pmod(s + _times32(xor(s, F.shiftright(s, 7)), s.bitwiseOR(F.lit(MULBERRY_MASKS[1]).cast("long"))), F.lit(1 << 32))
    t = named(t, lambda s: xor(s, mix(s)))
    return named(t, lambda s: xor(s, F.shiftright(s, 14)) / F.lit(2.0**32))
