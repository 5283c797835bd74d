"""A compact binary form of sampled series.

Layout: the magic, a version byte, a byte whose bits say which channels are there, the number of samples, then for each
channel in order the zigzag differences of its scaled, rounded samples. Numbers are LEB128. Writing is built-in
expressions; reading is an Arrow-batched function, since a running sum has no built-in one that is linear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magic and version in hexadecimal; channels in their order, each with the scale that sets its precision.
MAGIC, VERSION = b"MDL1", 1
HEAD = MAGIC.hex().upper() + f"{VERSION:02X}"
SCALES = {"timeS": 1, "depthM": 1000, "tempC": 100, "pressureBar": 100, "ndlS": 1, "cnsPercent": 100}


def _leb128(v: Column) -> Column:
    """Hexadecimal digits of a number below 2^35."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(v, 7 * k).bitwiseAND(127) + F.when(v >= 1 << (7 * k + 7), 128).otherwise(0)), 2, "0")
    return F.concat(byte(0), *[F.when(v >= 1 << (7 * k), byte(k)).otherwise("") for k in range(1, 5)])


def _deltas(samples: Column, scale: int) -> Column:
    whole = F.transform(samples, lambda v: F.floor(v.cast("double") * scale + 0.5).cast("long"))
    return F.transform(whole, lambda v, i: v - F.when(i > 0, F.get(whole, i - 1)).otherwise(0))


def encode(channels: dict[str, Column]) -> Column:
    """Binary form of channels of equal length; null where one is null, holds a null or differs in length."""
    unknown = set(channels) - set(SCALES)
    if unknown or not channels:
        raise ValueError(f"channels must be among {list(SCALES)}")
    names = [n for n in SCALES if n in channels]
    mask = sum(1 << k for k, n in enumerate(SCALES) if n in channels)
    zigzag = lambda d: F.when(d < 0, -2 * d - 1).otherwise(2 * d)
    body = [F.array_join(F.transform(_deltas(channels[n], SCALES[n]), lambda d: _leb128(zigzag(d))), "") for n in names]
    n = F.size(channels[names[0]])
    sound = F.lit(True)
    for name in names:
        sound = sound & channels[name].isNotNull() & (F.size(channels[name]) == n) & ~F.exists(channels[name], lambda v: v.isNull())
    return F.when(sound, F.unhex(F.concat(F.lit(f"{HEAD}{mask:02X}"), _leb128(n.cast("long")), *body)))


def _numbers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers after the head, and how many bytes each takes; what the end cuts off is left out."""
    tail = np.frombuffer(blob, np.uint8, offset=6).astype(np.int64)
    last = np.flatnonzero(tail < 128)
    if not len(last):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate([[0], last[:-1] + 1])
    used = last[-1] + 1
    digit = np.arange(used) - np.repeat(begin, last - begin + 1)
    # a number that is too long is told by its length; its value does not matter
    return np.add.reduceat((tail[:used] & 127) << (7 * np.minimum(digit, 5)), begin), last - begin + 1


def damage_of(blob: bytes | None) -> str | None:
    """What is wrong with a blob: bad magic, unsupported version, varint too long, or truncated; None for a sound one. Bytes
    after the last sample are no damage."""
    if blob is None:
        return None
    if blob[:4] != MAGIC[: len(blob)]:
        return "bad magic"
    if len(blob) < 5:
        return "truncated"
    if blob[4] != VERSION:
        return f"unsupported version {blob[4]}"
    if len(blob) < 7:
        return "truncated"
    numbers, sizes = _numbers(blob)
    wanted = 1 + bin(blob[5]).count("1") * int(numbers[0]) if len(numbers) else 1
    if (sizes[:wanted] > 5).any() or len(numbers) < wanted and len(blob) - 6 - sizes.sum() > 5:
        return "varint too long"
    return "truncated" if len(numbers) < wanted else None


def samples_of(blob: bytes | None, channel: str) -> list[float] | None:
    """Samples of one channel of one blob; None as decode() gives null."""
    place = list(SCALES).index(channel)
    if blob is None or damage_of(blob) is not None or not blob[5] >> place & 1:
        return None
    numbers, _ = _numbers(blob)
    n, before = int(numbers[0]), bin(blob[5] & ((1 << place) - 1)).count("1")
    own = numbers[1 + before * n : 1 + (before + 1) * n]
    return (np.cumsum(np.where(own & 1, -(own + 1) // 2, own // 2)) / SCALES[channel]).tolist()


def damage(blob: Column) -> Column:
    """What is wrong with a blob, in words; null for a sound one and for none."""

    @F.pandas_udf("string")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(damage_of)

    return run(blob)


def decode(blob: Column, channel: str) -> Column:
    """Samples of one channel; null where it is not there or the blob is damaged (see damage())."""
    list(SCALES).index(channel)

    @F.pandas_udf("array<double>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: samples_of(b, channel))

    return run(blob)
