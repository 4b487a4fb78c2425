"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into units: a run of spaces with the word after it, a word that follows a line feed, a line feed. The distinct units of a chunk are
found by hash, and only those that the worker's memo doesn't hold are encoded: all their substrings no longer than the longest
piece are looked up by hash among the pieces, and the edges that match are folded position by position. This is done in numpy, in place;
pieces_relational.py has the same lattice in Spark's own operators.

For a unigram model the fold would be Viterbi's, taking the best sum of scores. The models here are BPE, whose scores
are merge orders: the best sum is not what merging yields. What merging yields is the one path whose neighbours all stay
apart when merged by themselves, so the fold keeps, for each end position, the edge that agrees with its predecessor in that sense.

Hashes have 64 bits. Every encoded text is decoded again, and one that differs from its source is encoded anew without hashes of units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units kept encoded at most (some 30 bytes each), characters that one round of the lattice handles, and those of a chunk of texts.
MEMO, ROUND, CHUNK = 1 << 20, 1 << 17, 1 << 19
#: Pairs of pieces that are remembered to agree.
PAIRS = 1 << 16
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Words longer than this are folded one by one, so that few long ones don't hold up a round.
LONG = 40


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every row, one row after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Memo:
    """Ids of units by hash: sorted keys, and where the ids of each lie in a pool."""

    def __init__(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used, self.pool, self.now = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where they aren't held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def touch(self, places: np.ndarray) -> None:
        self.now += 1
        self.used[places] = self.now

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """New keys, sorted. If there are too many the half that was used longest ago goes, but none that was used this time."""
        size = np.array([len(x) for x in ids], np.int32)
        start = len(self.pool) + np.cumsum(size) - size
        parts = (self.keys, keys), (self.start, start), (self.size, size), (self.used, np.full(len(keys), self.now, np.int32))
        keys, start, size, used = map(np.concatenate, parts)
        pool, by = np.concatenate([self.pool, *ids]), np.argsort(keys, kind="stable")
        if len(keys) > MEMO:
            by = by[used[by] >= min(self.now, int(np.median(used)) + 1)]
        self.keys, self.start, self.size, self.used = keys[by], start[by], size[by], used[by]
        if len(by) < len(keys):
            pool, self.start = pool[ragged(self.start, self.size)], np.cumsum(self.size, dtype=np.int64) - self.size
        self.pool = pool


class Lattice:
    """The piece table of a model, and the fold."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = {bytes([int(sp.id_to_piece(i)[1:-1], 16)])[0]: i for i in range(n) if sp.is_byte(i)}
        table = {sp.id_to_piece(i): i for i in range(n) if not special[i] and not sp.is_byte(i)}
        self.runs = {len(p): i for p, i in sorted(table.items(), key=lambda x: -len(x[0])) if not p.strip(SPACE)}
        for p in [p for p in table if p != SPACE and (not p.strip(SPACE) or SPACE in p[1:])]:
            if p.strip(SPACE):
                raise ValueError(f"piece {p!r} spans words")
            del table[p]  # runs of spaces are laid greedily beside the lattice
        self.table, self.unknown = table, sp.unk_id()
        self.known = frozenset(p for p in table if len(p) == 1)
        self.output = output = [b"" if special[i] else bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.out_size = np.array([len(x) for x in output], np.int64)
        self.out_start, self.out_bytes = np.cumsum(self.out_size) - self.out_size, np.frombuffer(b"".join(output), np.uint8)
        # merge order: single characters are there from the start
        order = {p: (-1 if len(p) == 1 else -sp.get_score(i)) for p, i in table.items()}
        self.rank = np.full(n, -1.0)
        for p, i in table.items():
            self.rank[i] = order[p]
        self.left, self.right = np.arange(n), np.arange(n)
        self.longest = max(map(len, table))
        keys, ranks, reachable = [], [], set(self.known)
        for p, i in sorted(table.items(), key=lambda x: len(x[0])):
            for k in range(1, len(p)):
                a, b = table.get(p[:k]), table.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(order[p])
        by = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[by], np.array(ranks)[by]
        for p, i in table.items():
            if len(p) > 1 and (halves := self._halves(p)):
                self.left[i], self.right[i] = halves
                reachable.add(p)
        self.powers, self.back = self._powers(max(ROUND, CHUNK) + 64)
        self.by_length = []
        for size in range(1, self.longest + 1):
            own = [p for p in reachable if len(p) == size]
            cp = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
            h = (scramble(cp) * self.powers[:size]).sum(axis=1, dtype=np.uint64)
            by = np.argsort(h)
            seen = np.zeros(1 << 18, bool)
            seen[h >> np.uint64(46)] = True
            self.by_length.append((h[by], np.array([table[own[k]] for k in by], np.int64), seen))
        self.newline, self.space = self._bytes("\n"), np.array([self.runs[1]], np.int32).tobytes()
        self.memo = Memo()
        self.agreed: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        base = 0x9E3779B97F4A7C15 | 1
        return np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))

    def _halves(self, piece: str) -> tuple[int, int] | None:
        """The last two parts of a piece when its characters are merged; None if they don't merge into it."""
        parts = [self.table.get(c) for c in piece]
        if None in parts:
            return None
        while len(parts) > 2:
            orders = [self.merge_rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
            k = int(np.argmin(orders))
            if orders[k] == np.inf:
                return None
            parts[k : k + 2] = [self.table[self.text(parts[k]) + self.text(parts[k + 1])]]
        return (parts[0], parts[1]) if self.merge_rank(*parts) < np.inf else None

    def text(self, i: int) -> str:
        return self.output[i].decode().replace(" ", SPACE)

    def merge_rank(self, a: int, b: int) -> float:
        k = int(np.searchsorted(self.pair_keys, a << 32 | b))
        return float(self.pair_ranks[k]) if k < len(self.pair_keys) and self.pair_keys[k] == a << 32 | b else np.inf

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are when all their characters are merged.

        Walks back through both histories. Where the later of the two was made, its inner half stood at the border before: had that half
        merged with the other side earlier than it did with its own, the pieces wouldn't have come about. Of equal orders the left goes first.
        """
        good = np.ones(len(a), bool)
        at, x, y, most = np.arange(len(a)), a, b, np.full(len(a), np.inf)
        while len(at):
            key = (x << 32) | y
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[k] == key) & (self.pair_ranks[k] < most)
            good[at[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joins & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            undo = rx > ry
            most = np.where(undo, rx, np.nextafter(ry, np.inf))
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def fold_one(self, word: str) -> list[int]:
        """The fold for a single long word."""
        last, size = [-1] * len(word), [0] * len(word)
        for end in range(len(word)):
            for k in range(1, min(self.longest, end + 1) + 1):
                piece = self.table.get(word[end + 1 - k : end + 1])
                if piece is None:
                    continue
                before = last[end - k] if k <= end else -1
                if before >= 0:
                    pair = (before, piece)
                    ok = self.agreed.get(pair)
                    if ok is None:
                        if len(self.agreed) > PAIRS:
                            self.agreed.clear()
                        ok = self.agreed[pair] = bool(self.agree(np.array([before]), np.array([piece]))[0])
                    if not ok:
                        continue
                last[end], size[end] = piece, k
                break
        out, end = [], len(word) - 1
        while end >= 0:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def fold(self, words: list[str]) -> list[np.ndarray]:
        """Pieces of each word, all of known characters."""
        out: list[np.ndarray] = [np.array(self.fold_one(w), np.int32) if len(w) > LONG else None for w in words]
        at, batch, room = 0, [], ROUND
        for i, w in enumerate(words):
            if out[i] is None:
                if len(w) > room:
                    self._round(words, batch, out)
                    batch, room = [], ROUND
                batch.append(i)
                room -= len(w)
        if batch:
            self._round(words, batch, out)
        return out

    def _round(self, words: list[str], batch: list[int], out: list) -> None:
        # explode: every start and length; join: look the hash of the substring up among the pieces of that length
        cp = np.frombuffer("".join(words[i] for i in batch).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(words[i]) for i in batch])
        by = np.argsort(-sizes, kind="stable")  # long words first: at each depth the words still going are a prefix
        starts = (np.cumsum(sizes) - sizes)[by]
        n = len(cp)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(scramble(cp) * self.powers[:n])])
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        edges = []
        for k, (hashes, ids, seen) in enumerate(self.by_length, 1):
            found = np.full(n, -1, np.int64)
            i = np.flatnonzero(room >= k)
            h = (prefix[i + k] - prefix[i]) * self.back[i] * self.powers[0]
            maybe = seen[h >> np.uint64(46)]
            i, h = i[maybe], h[maybe]
            if len(hashes) and len(i):
                where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[where] == h
                found[i[hit]] = ids[where[hit]]
            edges.append(found)
        # fold: the edge into each end that agrees with the one before it
        last, step = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        ordered = sizes[by]
        for depth in range(int(ordered[0])):
            live = int(np.searchsorted(-ordered, -depth, side="left"))
            end = starts[:live] + depth
            pieces, lengths, ends = [], [], []
            for k in range(1, min(len(edges), depth + 1) + 1):
                piece = edges[k - 1][end - k + 1]
                some = np.flatnonzero(piece >= 0)
                if k == depth + 1:
                    last[end[some]], step[end[some]] = piece[some], k
                else:
                    pieces.append(piece[some]), lengths.append(np.full(len(some), k)), ends.append(end[some])
            if pieces:
                piece, length, end = map(np.concatenate, (pieces, lengths, ends))
                open_ = step[end] == 0
                piece, length, end = piece[open_], length[open_], end[open_]
                ok = self.agree(last[end - length], piece)
                last[end[ok]], step[end[ok]] = piece[ok], length[ok]
        # walk back from the ends of the words, all at once
        marks = np.zeros(n, bool)
        at = starts + ordered - 1
        while len(at):
            marks[at] = True
            before = at - step[at]
            keep = before >= starts[: len(before)] if len(before) == len(starts) else before >= first
            first = (starts if len(before) == len(starts) else first)[keep]
            at = before[keep]
        where = np.flatnonzero(marks)
        ids = last[where].astype(np.int32)
        cuts = np.searchsorted(where, np.cumsum(sizes)[:-1])
        for i, own in zip(batch, np.split(ids, cuts), strict=True):
            out[i] = own

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encode words; a leading ▁ counts as a character."""
        parts: dict[str, None] = {}
        cuts = {}
        for w in words:
            if self.known.issuperset(w):
                parts[w] = None
            else:
                cuts[w] = own = []
                for known, run in groupby(w, self.known.__contains__):
                    own += ["".join(run)] if known else list(run)
                parts.update(dict.fromkeys(p for p in own if p[0] in self.known))
        parts.pop("", None)
        units = list(parts)
        encoded = {"": b""} | {u: ids.tobytes() for u, ids in zip(units, self.fold(units), strict=True)}
        for w, own in cuts.items():
            encoded[w] = b"".join(encoded[p] if p[0] in self.known else self._bytes(p) for p in own)
        return {w: encoded[w] for w in words}

    def _bytes(self, c: str) -> bytes:
        return np.array([self.byte_ids.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")], np.int32).tobytes()

    def _gap(self, n: int) -> bytes:
        """n spaces in a row, longest runs first."""
        out = []
        for size, piece in self.runs.items():
            out += [piece] * (n // size)
            n %= size
        return np.array(out, np.int32).tobytes()

    def lay(self, unit: str, words: dict[str, bytes]) -> bytes:
        """Ids of a unit, given those of its word: with ▁ in front after a space, bare after a line feed."""
        if unit == "\n":
            return self.newline
        word = unit.lstrip(" ")
        gap = len(unit) - len(word)
        if not gap:
            return words[word]
        if not word:
            return self._gap(gap)
        own = words[SPACE + word]
        if gap > 1 and own[:4] == self.space:  # the word left its space alone, which joins the run
            return self._gap(gap) + own[4:]
        return self._gap(gap - 1) + own

    def laid(self, units: list[str]) -> list[bytes]:
        """Ids of units, encoded afresh."""
        words = self.learn({SPACE + w if w is not u else w for u in units if (w := u.lstrip(" ")) and u != "\n"})
        return [self.lay(u, words) for u in units]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        counts, out = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        parts: list[str] = []
        owners: list[int] = []
        room = CHUNK
        for i, part in self._parts(texts):
            if len(part) > room and parts:
                out.append(self._chunk(parts, owners, counts))
                parts, owners, room = [], [], CHUNK
            parts.append(part)
            owners.append(i)
            room -= len(part)
        if parts:
            out.append(self._chunk(parts, owners, counts))
        return np.concatenate(out), counts

    @staticmethod
    def _parts(texts: list[str | None]) -> Iterator[tuple[int, str]]:
        """Texts with the space that they begin with; long ones in parts that end where units do."""
        for i, text in enumerate(texts):
            if not text:
                continue
            text, at = " " + text.replace(SPACE, " "), 0
            while len(text) - at > CHUNK:
                end = at + CHUNK
                while end > at and not (text[end] == "\n" or text[end] == " " != text[end - 1]):
                    end -= 1
                if end == at:  # one unit fills the chunk
                    end = UNIT.match(text, at).end()
                yield i, text[at:end]
                at = end
            if at < len(text):
                yield i, text[at:]

    def _chunk(self, parts: list[str], owners: list[int], counts: np.ndarray) -> np.ndarray:
        whole = "".join(parts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, sizes = len(cp), np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        space, feed = cp == 32, cp == 10
        first, after = space.copy(), ~space & ~feed
        first[1:] &= ~space[:-1]
        after[1:] &= feed[:-1]
        first |= feed | after
        first[begins] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        powers, back = (self.powers, self.back) if n <= len(self.powers) else self._powers(n)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(cp.astype(np.uint64)) * powers[:n])])
        keys, one, which = np.unique((prefix[ends] - prefix[starts]) * back[starts], return_index=True, return_inverse=True)
        memo = self.memo
        places = memo.find(keys)
        memo.touch(places[places >= 0])
        if len(new := np.flatnonzero(places < 0)):
            units = [whole[starts[k] : ends[k]] for k in one[new]]
            memo.add(keys[new], [np.frombuffer(x, np.int32) for x in self.laid(units)])
            places = memo.find(keys)
        places = places[which]
        many = memo.size[places].astype(np.int64)
        np.add.at(counts, owners, np.add.reduceat(many, np.searchsorted(starts, begins)))
        return memo.pool[ragged(memo.start[places], many)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, counts, _ = self.encode_checked(texts)
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode_checked(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of all texts, how many each has, and whether they decode to it."""
        ids, counts = self.encode_flat(texts)
        size = self.out_size[ids]
        data = self.out_bytes[ragged(self.out_start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        same, fixed = [], {}
        for i, text in enumerate(texts):
            ok = not text or data[ends[i] : ends[i + 1]].tobytes() == b" " + text.encode("utf-8", "surrogatepass")
            if not ok and SPACE not in text:  # equal hashes of unlike units, or characters that the model lacks
                fixed[i] = np.frombuffer(b"".join(self.laid(UNIT.findall(" " + text))), np.int32)
                ok = self.decode(fixed[i]) == text
            same.append(ok)
        if fixed:
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in fixed.items():
                lists[i], counts[i] = x, len(x)
            ids = np.concatenate(lists)
        return ids, counts, same

    def decode(self, ids: np.ndarray) -> str:
        """Ids outside the model add nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.out_size))]
        text = self.out_bytes[ragged(self.out_start[ids], self.out_size[ids])].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def lattice(model: bytes) -> Lattice:
    return Lattice(model)


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """docs: text and any others. Adds ids (array of int), n_tokens and round_trip (whether the ids decode to the text) in a struct
    beside `row`, the other columns: row, ids, n_tokens, round_trip.

    The model file is read on the driver and travels with the tasks. Null and empty texts have no ids; a null text counts as
    empty for round_trip. U+2581, the model's mark for a space, decodes as a space.
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lattice(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts, same = tool.encode_checked(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(counts), pa.array(same)], names=["row", "ids", "n_tokens", "round_trip"])

    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]))


def decode(tokens: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """tokens: ids (array of int) and any others. Returns row (the other columns) and text; null ids give null.
    Null elements and ids outside the model add nothing."""
    with open(model_file, "rb") as f:
        model = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lattice(model.value)
        for batch in batches:
            texts = [None if x is None else tool.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    packed = tokens.select(F.struct(*[c for c in tokens.columns if c != "ids"]).alias("row"), F.col("ids").cast("array<int>").alias("ids"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
