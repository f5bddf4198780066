"""Time stamps, price windows, costs and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_length

#: Prices for a million tokens: cached prompt, other prompt, completion.
PRICES = (0.02, 1.0, 2.0)
#: Peak windows in hours at UTC+8, half open.
PEAKS = ((9, 12), (14, 18))
WORD_CAP_MS, SPLIT_CHARS, OVER_S = 1200, 6, 0.5


def stamp_to_ms(minutes: Column, seconds: Column, mode: str = "round") -> Column:
    """``round`` half-even as the item parser, ``trunc`` as the index parser."""
    ms = (minutes.cast("long") * 60 + seconds.cast("double")) * 1000
    return (F.bround(ms) if mode == "round" else ms).cast("long")


def ms_to_stamp(ms: Column) -> Column:
    """``[mm:ss.cc]``, half up to centiseconds, never negative."""
    cs = F.floor((F.greatest(ms.cast("long"), F.lit(0)) + 5) / 10)
    return F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000), F.floor(cs % 6000 / 100), (cs % 100).cast("long"))


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 to a billion with so many decimals, rounded by its binary value, exact halves to even.

    Where the shortest decimal form lies half-way, the part of the product that a double cannot hold tells
    on which side the number is.
    """
    scaled = x.cast("decimal(27,18)") * F.lit(10**digits).cast("decimal(7,0)")
    down = F.floor(scaled)
    rest, ten, factor = scaled - down, (down * 10 + 5).cast("double"), float(10 ** (digits + 1))
    c = x * 134217729.0
    high = c - (c - x)
    side = (high * factor - ten) + (x - high) * factor
    up = (rest > 0.5) | ((rest == 0.5) & ((side > 0) | ((side == 0) & (down % 2 == 1))))
    q, unit = down.cast("long") + up.cast("long"), 10**digits
    return F.concat(F.floor(q / unit).cast("string"), F.lit("."), F.lpad((q % unit).cast("string"), digits, "0"))


def ms_to_float_stamp(ms: Column) -> Column:
    """``[mm:ss.ss]`` with rounded seconds, which may show 60.00 (Q2)."""
    seconds = ms / 1000.0
    return F.concat(F.format_string("[%02d:", F.floor(seconds / 60).cast("long")), F.lpad(fixed(seconds % 60, 2), 5, "0"), F.lit("]"))


def beijing(ts: Column) -> Column:
    """F16: wall-clock time at UTC+8 of a UTC time stamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit("+08:00"), ts.cast("timestamp_ntz"))


def is_peak(ts: Column) -> Column:
    """Inside a peak window; idle is the contrary."""
    h = F.hour(beijing(ts))
    out = F.lit(False)
    for a, b in PEAKS:
        out = out | ((h >= a) & (h < b))
    return out


def next_idle(ts: Column) -> Column:
    """when the current peak window ends (wall clock at UTC+8), or now outside of one."""
    now = beijing(ts)
    out = now
    for a, b in PEAKS:
        out = F.when((F.hour(now) >= a) & (F.hour(now) < b), F.date_trunc("day", now).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(b))).otherwise(out)
    return out


def seconds_until_idle(ts: Column) -> Column:
    """whole seconds to the end of the current peak window, 0 outside."""
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", beijing(ts), next_idle(ts)))


def hms(seconds: Column, units: tuple[str, str, str] = ("h", "m", "s")) -> Column:
    """hours only if not zero, minutes only if they or the hours are not zero."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat(
        F.when(h > 0, F.concat(h.cast("string"), F.lit(units[0]))).otherwise(""),
        F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit(units[1]))).otherwise(""), (s % 60).cast("string"), F.lit(units[2]),
    )


def cost(hit: Column, miss: Column, completion: Column, prices: tuple[float, float, float] = PRICES) -> Column:
    """A2: tokens over a million times price, summed in this order."""
    return hit / 1_000_000.0 * prices[0] + miss / 1_000_000.0 * prices[1] + completion / 1_000_000.0 * prices[2]


def hit_rate(hit: Column, miss: Column) -> Column:
    """A3: cached share of the prompt in percent, 0 without a prompt."""
    total = hit + miss
    return F.when(total > 0, hit / total * 100.0).otherwise(0.0)


def show_tokens(n: Column) -> Column:
    """thousands separators from 10,000 on."""
    return F.when(n >= 10000, F.format_number(n, 0)).otherwise(n.cast("string"))


def show_cost(x: Column) -> Column:
    """six, four or two decimals by magnitude."""
    return F.concat(F.lit("¥"), F.when(x < 0.0001, fixed(x, 6)).when(x < 0.01, fixed(x, 4)).otherwise(fixed(x, 2)))


def speech_ms(words: Column, cap: int = WORD_CAP_MS) -> Column:
    """A10: spoken time of word structs (start, end, word), each word capped, silence left out."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.least(F.greatest((w["end"] - w["start"]).cast("long"), F.lit(0)), F.lit(cap)))


def is_too_long(text: Column, words: Column, max_seconds: float = 8.0, max_chars: int = 40) -> Column:
    """More characters than allowed, or enough of them and too much speech."""
    n = compact_length(text)
    return F.when(n <= 0, False).when(n > max_chars, True).when(n < SPLIT_CHARS, False).otherwise(speech_ms(words) / 1000.0 > max_seconds + OVER_S)
