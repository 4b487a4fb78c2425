"""Exact substring dedup: the equal groups of a suffix order that is radix-sorted no deeper than the threshold.

A suffix array that is ordered only through its first `length` bytes has, as its runs of equal suffixes, exactly the
repeated windows. The sort runs most significant digit first, and a suffix leaves it as soon as a digit settles it:

* Digit 1 is the 64-bit hash of the window's minimizer, the least of its `gram`-byte substrings. Neighbouring windows
  share it, so windows go as bundles: a bundle is the run of windows that one minimizer place answers for. Equal windows
  have equal minimizers at equal offsets, so no equal windows are parted.
* Digit 2 is the hash of the bundle's whole text. Bundles that agree in both digits hold the same windows in the same
  order; all but the first occurrence are removed, and none goes on.
* Bundles alone under their minimizer are unique and drop out. Where different bundles share one, they are cut into
  blocks of up to BLOCK windows at fixed distances from the minimizer. Digit 3 is the hash of the bytes that all windows
  of a block have in common, digit 4 that of all its text: unique and equal blocks leave as bundles do.
* The last digit is the hash of the single window, inside the blocks that still differ.

Only bundles of the last kind need their text again. What repeats inside some megabytes of text is settled there before any
shuffle, so a text copied into every document costs one row per such part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import materialize, slices

#: Bytes that one pass of the hashing handles; places in it fit POS_BITS.
POS_BITS = 18
PIECE = 1 << POS_BITS
#: Layout of a place: start of the first window, windows, distance from it to the minimizer.
START_BITS, COUNT_BITS, OFF_BITS = 30, 7, 7
LAST_ID = (1 << 63) - 1
BLOCK = 16
#: Bytes of text whose entries are settled together before any shuffle.
SETTLED = 8 << 20
ROWS = "dkey long, th long, a long, b long, place long"


class Roller:
    """Polynomial hashes modulo 2**64 of all substrings of a piece, from prefix sums."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self._up = self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            rows = max(n, 1 << 12) - 1
            self._up, self._down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(rows, x, np.uint64)])) for x in (self.base, pow(self.base, -1, 1 << 64)))
        return self._up[:n], self._down[:n]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers(len(data))[0], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self.powers(len(prefix))[1]
        return mix((prefix[end] - prefix[start]) * down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@cache
def rollers() -> tuple[Roller, Roller]:
    return Roller(11), Roller(12)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def bundles(data: np.ndarray, segments: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """segments: (start, end) rows in data, which windows don't cross. Returns first window, windows, distance to the minimizer, minimizer hash and text hash of each bundle."""
    n, w = len(data), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    roll = rollers()[0]
    prefix = roll.prefix(data)
    at = np.arange(n - gram + 1)
    grams = roll.spans(prefix, at, at + gram)
    # the least hash, and of equal ones the leftmost place
    least = sliding_min((grams & ~np.uint64(PIECE - 1)) | at.astype(np.uint64), w)
    inside = np.zeros(n + 1, np.int32)
    fits = segments[segments[:, 1] - segments[:, 0] >= length]
    np.add.at(inside, fits[:, 0], 1)
    np.add.at(inside, fits[:, 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    place = (least[windows] & np.uint64(PIECE - 1)).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    start, count = windows[new], np.diff(np.append(new, len(windows)))
    text = roll.spans(prefix, start, start + count + length - 1)
    off = place[new] - start
    return start, count, off, grams[place[new]], shaped(text, off, count)


def shaped(text: np.ndarray, off: np.ndarray, count: np.ndarray) -> np.ndarray:
    return mix(text ^ off.astype(np.uint64) ^ (count.astype(np.uint64) << np.uint64(32)))


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges by owner; touching ranges join."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order].astype(np.int64), start[order], end[order]
    reach = np.maximum.accumulate((owner << 32) + end)
    first = np.flatnonzero(np.concatenate([[True], ((owner[1:] << 32) + start[1:]) > reach[:-1]]))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - (owner[first] << 32)


def text_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def range_rows(dkey: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges travel beside bundles: a spreads them over partitions, place is negative."""
    b = (start << 32) | end
    return dkey, th, mix((dkey ^ th).astype(np.uint64) * np.uint64(3) ^ b.astype(np.uint64)).view(np.int64), b, np.full(len(b), -1)


def as_batch(parts: list[tuple[np.ndarray, ...]], windows: pa.Array | None) -> pa.RecordBatch:
    columns = {name: pa.array(np.concatenate([p[i].astype(np.int64, copy=False) for p in parts])) for i, name in enumerate(("dkey", "th", "a", "b", "place"))}
    if windows is not None:
        columns["w"] = pa.concat_arrays([windows, pa.nulls(len(columns["a"]) - len(windows), windows.type)])
    return pa.RecordBatch.from_pydict(columns)


def settle(dkey: np.ndarray, th: np.ndarray, found: list[list[np.ndarray]], length: int, windows: pa.Array | None = None) -> pa.RecordBatch:
    """found: owner, start, count, off, a, b. Of the entries of a batch that agree in a and b the first goes on; the others are removed."""
    owner, start, count, off, a, b = map(np.concatenate, found)
    order = np.lexsort((start, owner, b, a))
    again = np.zeros(len(order), bool)
    again[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    first, rest = order[~again], order[again]
    o, s, e = merged(owner[rest], start[rest], start[rest] + count[rest] + length - 1)
    place = ((start[first] << COUNT_BITS | count[first]) << OFF_BITS) | off[first]
    return as_batch([(dkey[owner[first]], th[owner[first]], a[first].view(np.int64), b[first].view(np.int64), place), range_rows(dkey[o], th[o], s, e)], windows and windows.take(pa.array(first)))


def anchor_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SETTLED)):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            keys, first = np.unique(keys, axis=0, return_index=True)  # in order; repeated rows are one document
            texts = text_bytes(batch.column(2).take(pa.array(first)))
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            piece, size = [], 0

            def flush() -> None:
                nonlocal piece, size
                if piece:
                    data = np.frombuffer(b"".join(x for x, _, _ in piece), np.uint8)
                    ends = np.cumsum([len(x) for x, _, _ in piece])
                    starts = np.concatenate([[0], ends[:-1]])
                    s, *others = bundles(data, np.stack([starts, ends], axis=1), length, gram)
                    which = np.searchsorted(ends, s, side="right")
                    owner, base = (np.array([x[i] for x in piece], np.int64) for i in (1, 2))
                    for out, x in zip(parts, (owner[which], s - starts[which] + base[which], *others), strict=True):
                        out.append(x)
                piece, size = [], 0

            for i, text in enumerate(texts):
                for at in range(0, max(1, len(text) - length + 1), PIECE - length + 1):
                    cut = text[at : at + PIECE]
                    if len(cut) < length:
                        continue
                    if size + len(cut) > PIECE:
                        flush()
                    piece.append((cut, i, at))
                    size += len(cut)
            flush()
            if parts[0]:
                yield settle(keys[:, 0], keys[:, 1], parts, length)

    return run


def fields(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place >> (COUNT_BITS + OFF_BITS)) & ((1 << START_BITS) - 1), (place >> OFF_BITS) & ((1 << COUNT_BITS) - 1), place & ((1 << OFF_BITS) - 1)


def block_batches(length: int, many: int):
    """Each asked-for bundle as blocks with digits 3 and 4, and the last digit of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SETTLED)):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            keys, first = np.unique(keys, axis=0, return_index=True)
            batch = batch.take(pa.array(first))
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            singles = []
            for i, (text, asked) in enumerate(zip(text_bytes(batch.column(2)), batch.column(4), strict=True)):
                start, count, off = fields(np.unique(asked.values.to_numpy()))
                which = np.repeat(np.arange(len(start)), count)
                at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]
                block = ((start + off)[which] - at) // many
                new = np.flatnonzero(np.diff(which * 128 + block, prepend=-1) != 0)
                low = int(at.min())
                roll = rollers()[0]
                prefix = roll.prefix(np.frombuffer(text, np.uint8)[low : int(at.max()) + length])
                singles.append(rollers()[1].spans(rollers()[1].prefix(np.frombuffer(text, np.uint8)[low : int(at.max()) + length]), at - low, at - low + length))
                n = np.diff(np.append(new, len(at)))
                core = (start + off)[which[new]] - many * block[new]
                away = (start + off)[which[new]] - at[new]
                a = mix(roll.spans(prefix, core - low, core - many + 1 + length - low) ^ block[new].astype(np.uint64))
                b = shaped(roll.spans(prefix, at[new] - low, at[new] - low + n + length - 1), away, n)
                for out, x in zip(parts, (np.full(len(new), i), at[new], n, away, a, b), strict=True):
                    out.append(x)
            if singles:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(parts[2]))]).astype(np.int32)
                windows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(singles).view(np.int64)))
                yield settle(keys[:, 0], keys[:, 1], parts, length, windows)

    return run


def kept_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts, n_removed, n_spans, sha, kept_texts = text_bytes(batch.column(2)), [], [], [], []
            for text, ranges in zip(texts, batch.column(4), strict=True):
                pieces, last, spans = [], 0, 0
                if ranges.is_valid:
                    x = ranges.values.to_numpy()
                    _, starts, ends = merged(np.zeros(len(x), np.int64), x >> 32, x & 0xFFFFFFFF)
                    spans = len(starts)
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        pieces.append(text[last:s])
                        last = e
                pieces.append(text[last:])
                kept = b"".join(pieces)
                n_removed.append(len(text) - len(kept))
                n_spans.append(spans)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode("utf-8", "ignore"))
            out = {"row": batch.column(3), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if with_text:
                out["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _bits(place: str, low: int, many: int):
    return F.shiftright(place, low).bitwiseAND((1 << many) - 1)


def _digits(rows: DataFrame, length: int) -> DataFrame:
    """One pass of the sort over rows as ROWS. Keeps what is removed (first false; r is its range) and the first
    of each kind of entries if others share its a (first true)."""
    same = Window.partitionBy("a", "b").orderBy("dkey", "th", "place")
    ranked = rows.repartition("a").withColumn("k", F.rank().over(same)).withColumn("n", F.sum((F.col("k") == 1).cast("int")).over(Window.partitionBy("a")))
    start = _bits("place", COUNT_BITS + OFF_BITS, START_BITS)
    end = start + _bits("place", OFF_BITS, COUNT_BITS) + (length - 1)
    moved = F.col("place") < 0
    r = F.when(moved, F.col("b")).otherwise(F.shiftleft(start, 32).bitwiseOR(end))
    kept = ranked.filter("place < 0 or k > 1 or n > 1")
    return kept.select("a", "dkey", "th", r.alias("r"), "place", *(c for c in rows.columns if c == "w"), (~moved & (F.col("k") == 1)).alias("first"))


def dedup(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """Remove every byte that a `length`-byte string covers which also starts earlier: in a smaller doc_id, or earlier
    in the same document. Texts count as UTF-8 bytes, matches don't cross documents, overlaps count, and strings are
    judged on the input.

    docs: doc_id (long), text and any others. Returns per input row: row (a struct of all input columns but text), n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and, if asked for, kept_text (a character cut in two by a removal is
    dropped from it).

    Null texts count as empty. Null ids come after all others. Rows that repeat a doc_id and text are one document,
    reported once per row; rows with the same doc_id (or none) and different texts are ordered by the 64-bit hashes of their texts.
    """
    if not 3 <= length <= 128:
        raise ValueError("length: from 3 to 128")
    gram = max(1, min(32, length // 3))
    rest = [c for c in docs.columns if c != "text"]
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("dkey"), th.alias("th"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("row"))
    found = base.select("dkey", "th", "text").mapInArrow(anchor_batches(length, gram), ROWS)
    settled = materialize(_digits(found, length).drop("a"), "substring")
    asked = settled.filter("first").groupBy("dkey", "th").agg(F.collect_list("place").alias("asked"))
    blocks = base.join(asked.hint("shuffle_hash"), ["dkey", "th"]).select("dkey", "th", "text", "row", "asked").mapInArrow(block_batches(length, min(BLOCK, length // 2)), ROWS + ", w array<long>")
    settled_blocks = _digits(blocks, length)
    # rows that aren't first have no windows to look at, only their range
    looked_at = F.when(F.col("first"), F.col("w")).otherwise(F.array(F.lit(0).cast("long")))
    windows = settled_blocks.select("a", "dkey", "th", "r", "first", F.posexplode(looked_at).alias("i", "x")).withColumn("s", F.shiftright("r", 32) + F.col("i"))
    later = windows.withColumn("k", F.rank().over(Window.partitionBy("a", "first", "x").orderBy("dkey", "th", "s"))).filter("k > 1 or not first")
    later = later.select("dkey", "th", F.when(F.col("first"), F.shiftleft("s", 32).bitwiseOR(F.col("s") + length)).otherwise(F.col("r")).alias("r"))
    ranges = settled.filter("not first").select("dkey", "th", "r").union(later)
    gone = ranges.groupBy("dkey", "th").agg(F.collect_list("r").alias("ranges"))
    out = T.StructType([T.StructField("row", base.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    return base.join(gone.hint("shuffle_hash"), ["dkey", "th"], "left").select("dkey", "th", "text", "row", "ranges").mapInArrow(kept_batches(with_text), out)
