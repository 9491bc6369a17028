"""Punycode (RFC 3492)."""

from __future__ import annotations

# Fixed values of the published algorithm.
BASE, TMIN, TMAX, SKEW, DAMP, BIAS, START = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
VALUE = {c: i for i, c in enumerate(DIGITS)} | {c.upper(): i for i, c in enumerate(DIGITS)}


class PunycodeError(ValueError):
    pass


def _next_bias(delta: int, points: int, first: bool) -> int:
    delta = delta // DAMP if first else delta // 2
    delta += delta // points
    k = 0
    while delta > (BASE - TMIN) * TMAX // 2:
        delta //= BASE - TMIN
        k += BASE
    return k + (BASE - TMIN + 1) * delta // (delta + SKEW)


def _threshold(k: int, bias: int) -> int:
    return min(max(k - bias, TMIN), TMAX)


def encode(text: str) -> str:
    basic = [c for c in text if ord(c) < START]
    out = basic + ["-"] * bool(basic)
    done, bias, delta, point = len(basic), BIAS, 0, START
    first = True
    for target in sorted({ord(c) for c in text if ord(c) >= START}):
        delta += (target - point) * (done + 1)
        point = target
        for c in text:
            if ord(c) < point:
                delta += 1
            elif ord(c) == point:
                q, k = delta, BASE
                while q >= (t := _threshold(k, bias)):
                    q, digit = divmod(q - t, BASE - t)
                    out.append(DIGITS[t + digit])
                    k += BASE
                out.append(DIGITS[q])
                bias = _next_bias(delta, done + 1, first)
                delta, first, done = 0, False, done + 1
        delta, point = delta + 1, point + 1
    return "".join(out)


def decode(text: str) -> str:
    head, dash, tail = text.rpartition("-")
    if any(ord(c) >= START for c in text):
        raise PunycodeError("not ASCII")
    out = list(head) if dash else []
    digits = iter(tail)
    point, i, bias, first = START, 0, BIAS, True
    for c in digits:
        before, weight, k = i, 1, BASE
        while True:
            if (d := VALUE.get(c)) is None:
                raise PunycodeError(f"invalid digit {c!r}")
            i += d * weight
            if d < (t := _threshold(k, bias)):
                break
            weight *= BASE - t
            k += BASE
            if (c := next(digits, None)) is None:
                raise PunycodeError("ends within a number")
        bias = _next_bias(i - before, len(out) + 1, first)
        first = False
        step, i = divmod(i, len(out) + 1)
        point += step
        if point > 0x10FFFF or 0xD800 <= point < 0xE000:
            raise PunycodeError("beyond Unicode")
        out.insert(i, chr(point))
        i += 1
    return "".join(out)
