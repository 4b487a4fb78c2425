"""License scans by conditional compression.

Blocks of lines that speak of licenses are compressed once alone and once with each template as zstandard's raw
dictionary. The templates that save bytes are the likely wordings, those that save most first; the winner is confirmed
by its exact word differences from the block, and what is left of the block is classified again.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.license_texts import templates

LEVEL = 12
#: The share of a template's words that must be there; templates of so few words must be there as they are, as prose may hold the words apart.
COVERAGE, COMMON = 0.85, 3
# What a line must hold to start a block.
SIGNS = ("licen", "copyright", "©", "rights reserved", "spdx", "warrant", "permission", "redistribut", "public domain", "creative commons")
SENTENCE = re.compile(r"(?<=[.;!?])\s+")
LONG_LINE = 300
CLOSING = re.compile(r"[.,;:!?)\]\"']*")
WORD = re.compile(r"<[^>]*>|[a-z0-9]+(?:[.'\-/][a-z0-9]+)*")
OUT = "doc_id long, start long, end long, license string, saved int, exact boolean, differences array<string>"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Template:
    license: str
    words: list[str]
    counts: Counter[str]
    needed: int
    packer: zstandard.ZstdCompressor


@cache
def known() -> tuple[list[Template], frozenset[str]]:
    out = []
    for name, text in templates():
        data = zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own = words(text)
        out.append(Template(name, own, Counter(own), sum(w[0] != "<" for w in own), zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)))
    return out, frozenset(w for t in out for w in t.words)


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the lines that aren't blank; long lines sentence by sentence."""
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            if len(line) <= LONG_LINE:
                yield at, end
            else:
                start = at
                for m in SENTENCE.finditer(line):
                    if at + m.start() > start:
                        yield start, at + m.start()
                    start = at + m.end()
                if start < end:
                    yield start, end
        at = end + 1


def lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # a character changed its length; keep offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring pieces around one with a sign, as far as most of their words are license words."""
    low = lowered(text)
    if not any(s in low for s in SIGNS):
        return
    vocabulary = known()[1]
    spans = list(pieces(low))
    signed = [any(s in low[a:b] for s in SIGNS) for a, b in spans]

    def fits(i: int) -> bool:
        own = words(low[slice(*spans[i])])
        return sum(w in vocabulary for w in own) >= 0.7 * len(own) > 0

    last = -1
    for i, sign in enumerate(signed):
        if not sign or i <= last:
            continue
        first = i
        while first - 1 > last and (signed[first - 1] or fits(first - 1)):
            first -= 1
        last = i
        while last + 1 < len(spans) and (signed[last + 1] or fits(last + 1)):
            last += 1
        yield spans[first : last + 1]


def differences(template: Template, matcher: SequenceMatcher) -> tuple[list[int], int, list[str]]:
    """Places of the words shared with the template, how many others differ from its first to its last word, and how.
    Empty words are cut out."""
    changes, shared, others = [], [], 0
    matcher.set_seq1(template.words)
    codes = matcher.get_opcodes()
    for k, (what, a, b, c, d) in enumerate(codes):
        if what == "equal":
            shared += range(c, d)
        elif what == "insert" and k in (0, len(codes) - 1):
            continue  # before or after the notice
        else:
            if what == "replace" and k == 0:
                c = max(c, d - (b - a))
            elif what == "replace" and k == len(codes) - 1:
                d = min(d, c + (b - a))
            old, new = [w for w in template.words[a:b] if w[0] != "<"], [w for w in matcher.b[c:d] if w]
            if old or new and len(old) == b - a:
                changes.append(f"{' '.join(old)} -> {' '.join(new)}")
                others += max(len(old), len(new))
    return shared, others, changes


class Match(NamedTuple):
    """A confirmed template: bytes saved, differences, where its words start and the last one ends, words between them that aren't its own."""

    license: str
    saved: int
    differences: tuple[str, ...]
    at: tuple[int, ...]
    end: int
    between: int
    needed: int


@lru_cache(maxsize=20_000)
def classify(block: str) -> tuple[Match, ...]:
    """Confirmed templates of a block. The one that shares most words, less those that differ, is first; its words are cut out, and so on with the rest."""
    low = lowered(block)
    spans = [m.span() for m in WORD.finditer(low)]
    own, chars, out = [low[a:b] for a, b in spans], list(low), []
    while True:
        there = Counter(own)
        # what no order of the words can reach isn't compared
        able = [(k, t, most) for k, t in enumerate(known()[0]) if (most := (t.counts & there).total()) >= COVERAGE * t.needed]
        if not able:
            return tuple(out)
        data = " ".join("".join(chars).split()).encode("utf-8", "surrogatepass")
        alone = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(data))
        ranked = sorted(((alone - len(t.packer.compress(data)), -k, most, t) for k, t, most in able), key=lambda x: x[:2], reverse=True)
        matcher, best = SequenceMatcher(None, [], own, autojunk=False), None
        for saved, _, most, template in ranked:
            if saved <= 0 or best and most < best[0][0]:
                continue
            shared, others, changes = differences(template, matcher)
            if len(shared) < COVERAGE * template.needed or template.needed <= COMMON and changes:
                continue
            between = sum(map(bool, own[shared[0] : shared[-1] + 1])) - len(shared)
            rank = len(shared) - others, -between
            if best is None or rank > best[0]:
                best = rank, template, saved, shared, changes, between
        if best is None:
            return tuple(out)
        _, template, saved, shared, changes, between = best
        n, same = len(shared), [shared]
        if not changes and shared[-1] - shared[0] + 1 == n:  # the same words elsewhere are as good
            wording, i = own[shared[0] : shared[0] + n], shared[0] + n
            while i <= len(own) - n:
                if own[i] == wording[0] and own[i : i + n] == wording:
                    same.append(list(range(i, i + n)))
                    i += n
                else:
                    i += 1
        for places in same:
            out.append(Match(template.license, saved, tuple(changes), tuple(spans[i][0] for i in places), spans[places[-1]][1], between, template.needed))
            for i in places:
                a, b = spans[i]
                own[i], chars[a:b] = "", " " * (b - a)


def findings(text: str | None) -> list[tuple[int, int, str, int, tuple[str, ...]]]:
    """Confirmed notices in order: start, end, license, saved, differences.

    A notice of a run of lines replaces those of its lines whose words it holds with more of its own. A notice spans its
    whole lines, or its words where a line holds another; a run that holds one wrapped notice only is its span.
    """

    def placed(start: int, end: int) -> list[Match]:
        return [m._replace(at=tuple(start + p for p in m.at), end=start + m.end) for m in classify(text[start:end])]

    out = []
    for spans in runs(text or ""):
        kept = [m for span in spans for m in placed(*span)]
        wrapped = []
        if len(spans) > 1:
            owner = {p: k for k, m in enumerate(kept) for p in m.at}
            dropped = set()
            for m in placed(spans[0][0], spans[-1][1]):
                met = {owner[p] for p in m.at if p in owner}
                if met and m.between <= len(m.at) > sum(len(kept[k].at) for k in met) and set(m.at).issuperset(p for k in met for p in kept[k].at):
                    dropped |= met
                    wrapped.append(m)
                elif sum(p not in owner for p in m.at) >= COVERAGE * m.needed:
                    wrapped.append(m)
            kept = [m for k, m in enumerate(kept) if k not in dropped]
        if len(wrapped) == 1 and not kept:
            out.append((spans[0][0], spans[-1][1], *wrapped[0][:3]))
            continue
        starts, every = [a for a, _ in spans], kept + wrapped
        lines = [sorted({bisect(starts, p) - 1 for p in m.at}) for m in every]
        holds = Counter(i for own in lines for i in own)
        for m, own in zip(every, lines, strict=True):
            start = spans[own[0]][0] if holds[own[0]] == 1 else m.at[0]
            end = spans[own[-1]][1] if holds[own[-1]] == 1 else CLOSING.match(text, m.end).end()
            out.append((start, end, *m[:3]))
    return sorted(out, key=lambda o: o[:2])


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id (long), text and any others. A row per confirmed notice: doc_id, start and end (code points in the text),
    license, saved (compressed bytes), exact, differences ("template words -> words found").

    Whole texts are read; null and empty ones give no rows, and repeated rows give theirs each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, s, e, name, saved, not diff, list(diff)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, e, name, saved, diff in findings(t)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "start", "end", "license", "saved", "exact", "differences"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)
