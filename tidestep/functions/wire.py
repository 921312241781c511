"""Little-endian wire codecs, as Arrow-batched functions.

f32, f64, i32, i64, u32, u64 and bool are their bytes, f64x3 is 24 bytes, vec_f64 and string have a u32 length first.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

#: Numpy type and Spark type of each scalar.
SCALARS = {"f32": ("<f4", "float"), "f64": ("<f8", "double"), "i32": ("<i4", "int"), "i64": ("<i8", "long"), "u32": ("<u4", "long"), "u64": ("<u8", "decimal(20,0)"), "bool": ("?", "boolean")}


def pack(kind: str, value) -> bytes | None:
    if value is None:
        return None
    if kind in SCALARS:
        return np.array(int(value) if kind == "u64" else value, dtype=SCALARS[kind][0]).tobytes()
    if kind == "f64x3":
        return np.asarray(value, dtype="<f8").tobytes()
    if kind == "vec_f64":
        return struct.pack("<I", len(value)) + np.asarray(value, dtype="<f8").tobytes()
    if kind == "string":
        raw = value.encode()
        return struct.pack("<I", len(raw)) + raw
    raise ValueError(f"no codec for {kind}")


def unpack(kind: str, raw: bytes | None):
    if raw is None:
        return None
    if kind in SCALARS:
        return np.frombuffer(raw, dtype=SCALARS[kind][0])[0].item()
    if kind == "f64x3":
        return np.frombuffer(raw, dtype="<f8").tolist()
    body = raw[4 : 4 + struct.unpack_from("<I", raw)[0] * (8 if kind == "vec_f64" else 1)]
    return np.frombuffer(body, dtype="<f8").tolist() if kind == "vec_f64" else body.decode()


def spark_type(kind: str) -> str:
    return SCALARS[kind][1] if kind in SCALARS else "string" if kind == "string" else "array<double>"


def _binary(lengths: np.ndarray, data: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of bytes that stand one after another; those that aren't valid are null."""
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.compute.if_else(pa.array(valid), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _bytes(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's bytes begin, and the last end; the bytes), nulls being empty."""
    held = raw.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    return at, np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 ... of so many each, one stretch after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def encode(kind: str, values: pa.Array) -> pa.Array:
    """A batch's values as bytes, made in one buffer."""
    valid = np.asarray(values.is_valid())
    n = len(values)
    if kind in SCALARS:
        if kind == "u64":
            own = np.array([int(v or 0) for v in values.to_pylist()], dtype="<u8")  # Arrow has no cast from its decimals
        else:
            own = values.fill_null(False if kind == "bool" else 0).to_numpy(zero_copy_only=False).astype(SCALARS[kind][0])
        return _binary(np.full(n, own.dtype.itemsize), own.view(np.uint8), valid)
    if kind == "string":
        at, data = _bytes(values.cast(pa.large_string()).cast(pa.large_binary()))
        count, size, data = np.diff(at), np.diff(at), data[at[0] : at[-1]]
    else:
        held = values.cast(pa.large_list(pa.float64()))
        count = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        data = held.flatten().to_numpy(zero_copy_only=False).astype("<f8").view(np.uint8)
        size = count * 8
    if kind == "f64x3":
        return _binary(size, data, valid)
    begin = np.cumsum(size + 4) - size - 4
    out = np.empty(int((size + 4).sum()), dtype=np.uint8)
    out[(begin[:, None] + np.arange(4)).ravel()] = count.astype("<u4").view(np.uint8)
    out[_stretches(begin + 4, size)] = data
    return _binary(size + 4, out, valid)


def decode(kind: str, raw: pa.Array) -> pa.Array:
    """A batch's bytes as values, read from one buffer."""
    valid = pa.array(np.asarray(raw.is_valid()))
    at, data = _bytes(raw)
    begin, size = at[:-1], np.diff(at)
    if kind in SCALARS:
        width = np.dtype(SCALARS[kind][0]).itemsize
        size = np.where(size, width, 0)
        own = np.zeros((len(raw), width), dtype=np.uint8)
        own[size > 0] = data[_stretches(begin, size)].reshape(-1, width)
        found = pa.array(own.reshape(-1).view(SCALARS[kind][0]))
        found = found.cast(pa.decimal128(20, 0)) if kind == "u64" else found.cast(pa.int64()) if kind == "u32" else found
        return pa.compute.if_else(valid, found, pa.scalar(None, found.type))
    skip = 0 if kind == "f64x3" else 4
    size = np.maximum(size - skip, 0)
    body = data[_stretches(begin + skip, size)]
    if kind == "string":
        return _binary(size, body, np.asarray(raw.is_valid())).cast(pa.string())
    ends = np.r_[0, np.cumsum(size // 8)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(body.view("<f8")), mask=pa.array(~np.asarray(raw.is_valid())))


def encoder(kind: str):
    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return encode(kind, values)

    return run


def decoder(kind: str):
    @F.arrow_udf(spark_type(kind))
    def run(raw: pa.Array) -> pa.Array:
        return decode(kind, raw)

    return run
