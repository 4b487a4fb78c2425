"""Row sets in the portable Roaring layout, as deletion vectors keep them: 64-bit arrays of 32-bit bitmaps, in files or as text in the log."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np

# Fixed values of the formats.
ARRAY_MAGIC = 1681511377
NO_RUNS, WITH_RUNS = 12346, 12347
ARRAY_MOST = 4096
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"


class RoaringError(ValueError):
    """Bytes that aren't a row set."""


def z85_encode(data: bytes) -> str:
    """Five characters for four bytes; the last four are filled up with zeros."""
    data += bytes(-len(data) % 4)
    out = []
    for (n,) in struct.iter_unpack(">I", data):
        part = []
        for _ in range(5):
            n, r = divmod(n, 85)
            part.append(Z85[r])
        out += part[::-1]
    return "".join(out)


def z85_decode(text: str, size: int) -> bytes:
    if len(text) % 5:
        raise RoaringError("base 85 text of a wrong length")
    out = []
    for at in range(0, len(text), 5):
        n = 0
        for c in text[at : at + 5]:
            n = n * 85 + Z85.index(c)
        out.append(struct.pack(">I", n))
    return b"".join(out)[:size]


def encode_32(values: np.ndarray) -> bytes:
    """Sorted, distinct values below 2**32."""
    keys, starts = np.unique(values >> 16, return_index=True)
    ends = np.append(starts[1:], len(values))
    bodies = []
    for a, b in zip(starts, ends, strict=True):
        low = (values[a:b] & 0xFFFF).astype("<u2")
        if b - a <= ARRAY_MOST:
            bodies.append(low.tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    head = struct.pack("<II", NO_RUNS, len(keys)) + b"".join(struct.pack("<HH", k, n - 1) for k, n in zip(keys.tolist(), (ends - starts).tolist(), strict=True))
    at = len(head) + 4 * len(keys)
    offsets = at + np.cumsum([0, *map(len, bodies)])[:-1]
    return head + offsets.astype("<u4").tobytes() + b"".join(bodies)


def decode_32(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Values, and where the bitmap ends."""
    (cookie,) = struct.unpack_from("<I", data, at)
    runs, many = b"", 0
    if cookie == NO_RUNS:
        (many,) = struct.unpack_from("<I", data, at + 4)
        at += 8
    elif cookie & 0xFFFF == WITH_RUNS:
        many = (cookie >> 16) + 1
        runs = data[at + 4 : at + 4 + (many + 7) // 8]
        at += 4 + (many + 7) // 8
    else:
        raise RoaringError("no Roaring bitmap")
    keys = [struct.unpack_from("<HH", data, at + 4 * k) for k in range(many)]
    at += 4 * many
    if not runs or many >= 4:  # places of the containers; they lie in order
        at += 4 * many
    out = []
    for k, (key, less) in enumerate(keys):
        if runs and runs[k // 8] >> (k % 8) & 1:
            (n,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data, "<u2", 2 * n, at + 2).reshape(-1, 2).astype(np.int64)
            low = np.concatenate([np.arange(s, s + more + 1) for s, more in pairs]) if n else np.zeros(0, np.int64)
            at += 2 + 4 * n
        elif less + 1 <= ARRAY_MOST:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append(low + (key << 16))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


def encode(rows: np.ndarray) -> bytes:
    """A set of non-negative 64-bit numbers."""
    rows = np.unique(np.asarray(rows, np.int64))
    high = rows >> 32
    keys = np.unique(high).tolist()
    return struct.pack("<iq", ARRAY_MAGIC, len(keys)) + b"".join(struct.pack("<i", k) + encode_32(rows[high == k] & 0xFFFFFFFF) for k in keys)


def decode(data: bytes) -> np.ndarray:
    magic, many = struct.unpack_from("<iq", data, 0)
    if magic != ARRAY_MAGIC:
        raise RoaringError("no array of Roaring bitmaps")
    at, out = 12, [np.zeros(0, np.int64)]
    for _ in range(many):
        (key,) = struct.unpack_from("<i", data, at)
        low, at = decode_32(data, at + 4)
        out.append(low + (key << 32))
    return np.concatenate(out)


def vector_path(text: str) -> str:
    """Path, below the table, of the file that a log entry names: a prefix and a base-85 UUID."""
    prefix, own = text[:-20], uuid.UUID(bytes=z85_decode(text[-20:], 16))
    return f"{prefix}/deletion_vector_{own}.bin" if prefix else f"deletion_vector_{own}.bin"


def vector_file(data: bytes) -> bytes:
    """A file of one vector, which begins at offset 1."""
    return b"\1" + struct.pack(">i", len(data)) + data + struct.pack(">I", zlib.crc32(data))


def read_vector(file: bytes, offset: int, size: int) -> np.ndarray:
    """The vector at an offset of a file."""
    (own,) = struct.unpack_from(">i", file, offset)
    data = file[offset + 4 : offset + 4 + own]
    if own != size or len(data) != own or struct.unpack_from(">I", file, offset + 4 + own)[0] != zlib.crc32(data):
        raise RoaringError("deletion vector with a wrong size or checksum")
    return decode(data)
