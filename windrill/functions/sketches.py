"""Estimates from the count-min sketches that cms() gives."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .aggregates import CMS

#: rows and columns of a sketch's table, as Spark sets them
DEPTH, WIDTH = math.ceil(-math.log1p(-CMS[1]) / math.log(2)), math.ceil(2 / CMS[0])


def cms_counts(sketch: bytes, items: np.ndarray) -> np.ndarray:
    """How often each whole number was counted, at least: never too few, too many by eps times the total with the confidence asked for."""
    version, _, depth, width = struct.unpack(">iqii", sketch[:20])
    if version != 1:
        raise ValueError("unknown sketch")
    a = np.frombuffer(sketch, ">i8", depth, 20).astype(np.int64)
    table = np.frombuffer(sketch, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width)
    with np.errstate(over="ignore"):
        h = a[:, None] * items.astype(np.int64)[None, :]
        h += h >> 32
    at = (h & 0x7FFFFFFF).astype(np.int32).astype(np.int64) % width
    return table[np.arange(depth)[:, None], at].min(0).astype(np.int64)


def cms_cells(sketch: Column | str) -> Column:
    """A sketch's numbers: the total, each row's multiplier, the rows of the table.

    Read once a sketch, before it is joined to the items: an estimate then looks up a few numbers in place, and the hundred
    kilobytes of a sketch are neither copied nor given to Python for each item."""
    digits = F.hex(sketch)
    words = F.concat(F.substring(digits, 9, 16), F.substring(digits, 41, 16 * DEPTH * (WIDTH + 1)))
    known = (F.substring(digits, 1, 8) == f"{1:08X}") & (F.substring(digits, 25, 16) == f"{DEPTH:08X}{WIDTH:08X}")
    read = F.transform(F.regexp_extract_all(words, F.lit(".{16}"), 0), lambda w: F.conv(w, 16, 10).cast("long"))
    return F.when(known, read).when(digits.isNotNull(), F.raise_error(F.lit("unknown sketch")).cast("array<long>"))


def cms_total(cells: Column | str) -> Column:
    """How many items were counted; NULL isn't one."""
    return F.get(cells, 0)


def cms_estimate(cells: Column | str, item: Column | str) -> Column:
    """(cells of a sketch, whole number) -> what cms_counts gives; NULL for NULL."""
    item = (F.col(item) if isinstance(item, str) else item).cast("long")
    low, high = item.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(item, 32)
    cut = lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    found = []
    for k in range(DEPTH):
        a = F.get(cells, 1 + k)  # below 2^31, so that no product here overflows
        h = cut(cut(a * low) + cut(F.shiftright(a * low, 32)) + cut(a * high))
        found.append(F.get(cells, (h % WIDTH).cast("int") + (1 + DEPTH + k * WIDTH)))
    return F.when(item.isNotNull(), F.least(*found))
