"""Reading of tensor files: a JSON header that names tensors, then their bytes; 16-bit numbers become 32-bit ones."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which embedding tables are looked for, in this order.
TABLE_NAMES = ["embeddings", "embedding.weight", "embeddings.weight", "weight"]
_WIDTHS = {"F32": 4, "F16": 2, "BF16": 2}


def decode(data: bytes, kind: str) -> np.ndarray:
    """Little-endian F32, F16 or BF16 as 32-bit floats. ValueError for other kinds and broken lengths."""
    if kind not in _WIDTHS:
        raise ValueError(f"{kind} isn't read")
    if len(data) % _WIDTHS[kind]:
        raise ValueError("the length is no multiple of the width")
    if kind == "F32":
        return np.frombuffer(data, "<f4")
    if kind == "F16":
        return np.frombuffer(data, "<f2").astype(np.float32)
    return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)


def table(path: str) -> np.ndarray:
    """The embedding table of a tensor file: of the first known name, else the first of two dimensions."""
    raw = np.memmap(path, np.uint8, "r")
    if len(raw) < 8:
        raise ValueError("no header")
    size = int(raw[:8].view("<u8")[0])
    if size > len(raw) - 8:
        raise ValueError("the header is longer than the file")
    header = json.loads(raw[8 : 8 + size].tobytes())
    header.pop("__metadata__", None)
    names = [n for n in TABLE_NAMES if n in header] or [n for n, t in header.items() if len(t["shape"]) == 2]
    if not names:
        raise ValueError("no table of two dimensions")
    t = header[names[0]]
    start, stop = (8 + size + x for x in t["data_offsets"])
    if not 8 + size <= start <= stop <= len(raw):
        raise ValueError("a tensor lies outside the file")
    out = decode(raw[start:stop].tobytes(), t["dtype"])
    if out.size != int(np.prod(t["shape"])):
        raise ValueError("a tensor's bytes don't fit its shape")
    return out.reshape(t["shape"])


def pixels(rgb: np.ndarray, mean: tuple[float, ...], deviation: tuple[float, ...]) -> np.ndarray:
    """Height x width x 3 bytes as 3 x height x width floats, normalised by channel."""
    scaled = rgb.astype(np.float32) / 255
    return ((scaled - np.array(mean, np.float32)) / np.array(deviation, np.float32)).transpose(2, 0, 1)


def half(bits: Column) -> Column:
    """The number that 16 bits stand for as a half-precision float: subnormal ones, infinities and NaN included."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    power, rest = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    special = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(power == 31, sign * special).when(power == 0, sign * rest * 2.0**-24).otherwise(sign * (rest / 1024 + 1) * F.pow(F.lit(2.0), power - 15))


def brain(bits: Column) -> Column:
    """The same for 16 bits that are the upper half of a single-precision float."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    power, rest = F.shiftright(bits, 7).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(127))
    special = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(power == 255, sign * special).when(power == 0, sign * rest * 2.0**-133).otherwise(sign * (rest / 128 + 1) * F.pow(F.lit(2.0), power - 127))
