"""Zero-phase low-pass filter and spectral smoothness as expressions over an array of samples."""

from __future__ import annotations

from math import pi, sin, tan

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 15


def biquads(cutoff: float, rate: float) -> list[tuple[float, float, float, float, float]]:
    """(b0, b1, b2, a1, a2) of the two second-order parts of a fourth-order Butterworth low-pass, by the bilinear transform."""
    k, out = tan(pi * cutoff / rate), []
    for j in range(2):
        q = 1 / (2 * sin(pi * (2 * j + 1) / 8))
        norm = 1 + k / q + k * k
        b = k * k / norm
        out.append((b, 2 * b, b, 2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm))
    return out


def _run(samples: Column, part: tuple[float, ...], first: Column) -> Column:
    """One part over the samples, starting in the steady state of ``first``."""
    b0, b1, b2, a1, a2 = map(F.lit, part)
    start = F.struct((first * (1 - b0)).alias("p"), (first * (b2 - a2)).alias("q"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y = b0 * x + s["p"]
        return F.struct((b1 * x - a1 * y + s["q"]).alias("p"), (b2 * x - a2 * y).alias("q"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.aggregate(samples, start, step, lambda s: s["out"])


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def lowpass(v: Column, cutoff: float, rate: float) -> Column:
    """Forward and backward over an oddly extended signal; a signal of fewer than 16 samples, or a cutoff outside (0, rate / 2), leaves it as it is."""
    if not 0 < cutoff < rate / 2:
        return v
    parts = biquads(cutoff, rate)

    def both(x: Column) -> Column:
        return _let(x, lambda s: _let(_run(s, parts[0], s[0]), lambda y: _run(y, parts[1], s[0])))

    def filtered(s: Column) -> Column:
        n = F.size(s)
        head = F.transform(F.sequence(F.lit(PAD), F.lit(1), F.lit(-1)), lambda i: 2 * s[0] - F.get(s, i))
        tail = F.transform(F.sequence(n - 2, n - 1 - PAD, F.lit(-1)), lambda i: 2 * F.get(s, n - 1) - F.get(s, i))
        return F.slice(F.reverse(both(F.reverse(both(F.concat(head, s, tail))))), F.lit(PAD + 1), n)

    return F.when(F.size(v) < PAD + 1, v).otherwise(_let(v, filtered))


def spectral_arc_length(v: Column, rate: float, least: float = 0.05, highest: float = 20.0) -> Column:
    """Minus the length of the normalised spectrum's curve up to the last bin of at least ``least``, no padding; null for
    fewer than four finite samples or none beyond 1e-12 on either side."""

    def of(s: Column) -> Column:
        n = F.size(s)
        index = F.sequence(F.lit(0), n - 1)

        def magnitude(k: Column) -> Column:
            part = lambda f: F.aggregate(index, F.lit(0.0), lambda a, t: a + F.get(s, t) * f(F.lit(2 * pi) * k * t / n))
            return F.sqrt(F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0)))

        raw = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), magnitude)

        def length(m: Column) -> Column:
            norm = F.when(m[0] > 1e-12, m[0]).otherwise(F.array_max(m))
            share = F.transform(m, lambda x: x / F.nullif(norm, F.lit(0.0)))

            def curve(h: Column) -> Column:
                fit = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: (F.get(h, k) >= least) & (k * rate / n <= highest))
                last = F.greatest(F.lit(1), F.coalesce(F.array_max(fit), F.lit(1)))
                return _let(last, lambda c: -F.aggregate(F.sequence(F.lit(1), c), F.lit(0.0), lambda a, k: a + F.sqrt(1.0 / (c * c) + F.pow(F.get(h, k) - F.get(h, k - 1), F.lit(2.0)))))

            return _let(share, curve)

        return _let(raw, length)

    clean = F.filter(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when((F.size(clean) < 4) | (F.array_max(F.transform(clean, F.abs)) <= 1e-12), F.lit(None).cast("double")).otherwise(_let(clean, of))


def arc_length(v: np.ndarray, rate: float, least: float = 0.05, highest: float = 20.0) -> float | None:
    """``spectral_arc_length`` of one long signal, in n log n."""
    s = v[np.isfinite(v)]
    if len(s) < 4 or np.abs(s).max() <= 1e-12:
        return None
    m = np.abs(np.fft.rfft(s))
    share = m / (m[0] if m[0] > 1e-12 else m.max())
    fit = np.flatnonzero((share >= least) & (np.arange(len(m)) * rate / len(s) <= highest))
    last = max(1, int(fit[-1]) if len(fit) else 1)
    return -float(np.sqrt(1.0 / last**2 + np.diff(share[: last + 1]) ** 2).sum())
