"""Packed rows: fixed-width columns one after the other without padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..types import Field


def dtype(fields: list[Field]) -> np.dtype:
    kinds = {"int": "<i4", "long": "<i8", "dec": "<f8", "date": "<u8"}
    return np.dtype([(f"c{i}", kinds.get(f.kind) or f"S{f.width}") for i, f in enumerate(fields)])


#: Bits of a packed date from the lowest: microsecond, millisecond, second, minute, hour, day, month, year (fixed values)
DATE_BITS = (10, 10, 6, 6, 5, 5, 4, 18)


def _shifts() -> list[int]:
    return [sum(DATE_BITS[:i]) for i in range(len(DATE_BITS))]


def pack_dates(stamps: np.ndarray) -> np.ndarray:
    """datetime64 as packed date fields, to the second."""
    day = stamps.astype("datetime64[D]")
    month = stamps.astype("datetime64[M]")
    year = month.astype("datetime64[Y]").astype(int) + 1970
    seconds = (stamps.astype("datetime64[s]") - day.astype("datetime64[s]")).astype(int)
    parts = (0, 0, seconds % 60, seconds // 60 % 60, seconds // 3600, (day - month).astype(int) + 1, month.astype(int) % 12 + 1, year)
    out = np.zeros(len(stamps), np.uint64)
    for value, shift in zip(parts, _shifts()):
        out |= np.asarray(value, np.uint64) << np.uint64(shift)
    return out


def unpack_dates(packed: np.ndarray) -> np.ndarray:
    _, _, second, minute, hour, day, month, year = ((packed >> np.uint64(s)) & np.uint64((1 << b) - 1) for s, b in zip(_shifts(), DATE_BITS))
    months = (year.astype(int) - 1970) * 12 + month.astype(int) - 1
    seconds = (day.astype(int) - 1) * 86400 + hour.astype(int) * 3600 + minute.astype(int) * 60 + second.astype(int)
    return months.astype("datetime64[M]").astype("datetime64[s]") + seconds


def pack(batch: pa.RecordBatch, fields: list[Field]) -> np.ndarray:
    """The rows of a batch as (rows, width) bytes; nulls are zeros."""
    kind = dtype(fields)
    out = np.zeros(batch.num_rows, kind)
    for i, f in enumerate(fields):
        col = batch.column(i)
        if f.kind == "char":
            out[f"c{i}"] = [(x or "").encode()[: f.width - 1] for x in col.to_pylist()]
        elif f.kind == "date":
            out[f"c{i}"] = pack_dates(np.array(col.cast(pa.timestamp("us")).fill_null(0).to_numpy(zero_copy_only=False), "datetime64[us]"))
        else:
            out[f"c{i}"] = col.fill_null(0).to_numpy(zero_copy_only=False)
    return out.view(np.uint8).reshape(batch.num_rows, kind.itemsize)


def unpack(rows: pa.Array, fields: list[Field]) -> list[pa.Array]:
    """The columns of a binary column of packed rows."""
    _, ends, data = rows.cast(pa.large_binary()).buffers()
    first = int(np.frombuffer(ends, np.int64, 1, rows.offset * 8)[0])
    raw = np.frombuffer(data, dtype(fields), len(rows), first)
    out = []
    for i, f in enumerate(fields):
        col = raw[f"c{i}"]
        if f.kind == "char":
            out.append(pa.array([x.decode(errors="replace") for x in col.tolist()], pa.string()))
        elif f.kind == "date":
            out.append(pa.array(unpack_dates(col).astype("datetime64[us]"), pa.timestamp("us", tz="UTC")))
        else:
            out.append(pa.array(col.copy()))
    return out


def xor_words(rows: np.ndarray) -> int:
    """XOR of all whole 4-byte words of all rows, as a signed int."""
    words = rows.shape[1] // 4
    if not words or not len(rows):
        return 0
    every = np.ascontiguousarray(rows[:, : words * 4]).view(np.uint32)
    return int(np.bitwise_xor.reduce(every.ravel()).astype(np.int32))
