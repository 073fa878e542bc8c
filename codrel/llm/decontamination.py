"""Benchmark decontamination by pigeonhole edit matching.

A test item is looked for as a whole, and as every passage of ``size`` and of ``WIDE`` words in it,
each with an error budget in proportion to its length; where that is 0, between ends of words. Of budget-plus-one
pieces of it a copy leaves one untouched. Pieces are found by their overlapping grams, which all
passages of an item share: an untouched piece is a row of common grams on one diagonal. Near such
a diagonal k edits leave all but ``GRAM * k`` of a passage's grams as they are, so places with
fewer hold no match. The pieces of passages too short for that are sought as they are, by one
automaton that scans each whole text. The places left are verified with Myers' bit-parallel edit
distance, and overlapping places of an item become one.

Texts and items are compared in lower case with every run of other than letters and digits
as one space. Items are taken in blocks of a bounded number of characters, each block one
pass over the documents, so what is shipped with the tasks has a fixed bound.

Defined results: null or empty texts and items match nothing; very long texts and items are
searched in full; items of fewer than ``least_words`` words are looked for whole and without
errors, and those without words or id not at all; rows that repeat an id give their matches once
(the fewest edits, of ties the first place), and ``clean`` judges each of them by its own text; an
item id that repeats is one item of several texts; empty tables give an empty table.
``contaminated`` ignores extra columns, ``clean`` keeps them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_least, shown_id, text_or_empty

#: Share of a passage's characters that edits may touch; words of a passage and between passage starts.
ERRORS, PASSAGE, STRIDE, LEAST_WORDS = 1 / 12, 13, 1, 6
#: Edits close together are within the budget of wider passages only: words of these.
WIDE = 20
#: Letters of the grams that passages and texts are compared by first.
GRAM = 9
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: ASCII bytes with all but letters and digits as spaces.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str) -> str:
    """In lower case, with every run of other than letters and digits as one space and none at the ends."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "surrogatepass")


def spans(text: str, size: int = PASSAGE, stride: int = STRIDE) -> list[tuple[int, str]]:
    """The passages of a text in normal form with their first characters, in their order; the first is the whole."""
    words = text.split()
    at = [0]
    for word in words:
        at.append(at[-1] + len(word) + 1)
    found = {(0, len(words))} if words else set()
    for n in {size, max(size, WIDE)}:
        if len(words) > n:
            found |= {(s, s + n) for s in (*range(0, len(words) - n, stride), len(words) - n)}
    return [(at[s], text[at[s] : at[e] - 1]) for s, e in sorted(found)]


def passages(text: str, size: int = PASSAGE, stride: int = STRIDE) -> list[str]:
    return [passage for _, passage in spans(normal(text), size, stride)]


def budget(passage: str, errors: float = ERRORS, least_words: int = LEAST_WORDS) -> int:
    return int(errors * len(passage)) if passage.count(" ") + 1 >= least_words else 0


def pieces(passage: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near-equal length with their offsets."""
    n = len(passage)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, passage[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _grams(text: str) -> np.ndarray:
    """A hash of the GRAM (2 * 4 + 1) letters from each character on."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < GRAM:
        return np.zeros(0, np.uint64)
    by = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    two = c[:-1] * by[0] + c[1:]
    four = two[:-2] * by[1] + two[2:]
    eight = four[:-4] * by[2] + four[4:]
    return (eight[:-1] * by[3] + c[8:]) * by[0]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; np.unique is slow on short arrays."""
    x = np.sort(x)
    return x[np.flatnonzero(np.r_[True, x[1:] != x[:-1]])[: len(x)]]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The fewest edits between the pattern and any substring of the text, and where the first such substring ends."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS, size: int = PASSAGE, stride: int = STRIDE, least_words: int = LEAST_WORDS):
        import ahocorasick

        #: Item, first and end character in ``self.text``, budget of every passage: first those of up to ``WIDE`` words in order of the first character, then the longer items as wholes, in order too.
        self.passages: list[tuple[int, int, int, int]] = []
        wholes, texts, at = [], [], 0
        for item_id, text in items:
            text = normal(text or "")
            for offset, passage in spans(text, size, stride):
                whole = len(passage) == len(text) and passage.count(" ") >= max(size, WIDE)
                k = budget(passage, errors, least_words)
                first = at + offset + (k > 0)  # without edits, the spaces around belong to the passage
                (wholes if whole else self.passages).append((item_id, first, first + len(passage) + 2 * (k == 0), k))
            texts.append(f" {text} ")
            at += len(text) + 3
        self.text = "\n".join(texts)
        self.longest = max((e - s for _, s, e, _ in self.passages), default=0)
        self.most = max((k for *_, k in self.passages), default=0)
        self.firsts = [s for _, s, _, _ in self.passages]
        self.windows = len(self.passages)
        self.passages += wholes
        # k edits leave at least this many of a passage's GRAM-letter grams as they are; where it is none, pieces are sought.
        self.least = [e - s - GRAM + 1 - k * GRAM for _, s, e, k in self.passages]
        #: Grams in the shortest of the pieces that pigeonhole leaves untouched.
        self.run = max(1, min(((e - s) // (k + 1) - GRAM + 1 for (_, s, e, k), n in zip(self.passages, self.least, strict=True) if n > 0), default=1))
        self.fewest = min((n for n in self.least if n > 0), default=1)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        need = np.zeros(len(self.text) + 1, np.int64)
        sought = np.zeros(len(need), bool)
        #: For the wholes: first and end characters, fewest grams, and the most edits of any.
        self.whole = [np.array(x, np.int64) for x in ([w[1] for w in wholes], [w[2] for w in wholes], self.least[self.windows :])]
        self.most_whole = max((w[3] for w in wholes), default=0)
        for p, (_, s, e, k) in enumerate(self.passages):
            if self.least[p] > 0:
                sought[s : e - GRAM + 1] = True
            if p >= self.windows and self.least[p] > 0:
                continue
            if self.least[p] > 0:
                part = need[s : e - GRAM + 1]
                need[s : e - GRAM + 1] = np.where(part == 0, self.least[p], np.minimum(part, self.least[p]))
            else:
                for offset, piece in pieces(self.text[s:e], k):
                    places[piece].append((p, offset))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        hashes = _grams(self.text)
        taken = np.flatnonzero(sought[: len(hashes)])
        taken = taken[np.argsort(hashes[taken], kind="stable")]
        self.need, self.places = need, taken
        self.hashes, self.at, self.times = np.unique(hashes[taken], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(16, (16 * len(self.hashes)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hashes >> self.shift] = True

    def _from_grams(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Passages that share enough grams with the text on near diagonals: passage, and between what characters to look."""
        if not len(self.hashes):
            return
        hashes = _grams(text)
        hit = np.flatnonzero(self.bits[hashes >> self.shift])
        found = np.searchsorted(self.hashes, hashes[hit])
        found[found == len(self.hashes)] = 0
        same = self.hashes[found] == hashes[hit]
        hit, found = hit[same], found[same]
        if not len(hit):
            return
        times = self.times[found]
        at = np.repeat(self.at[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        place, diagonal = self.places[at], np.repeat(hit, times) - self.places[at] + len(self.text)
        reach = max(self.most, self.most_whole)
        near = np.sort(diagonal)  # most texts end here: nowhere are enough grams near one diagonal
        if len(near) < self.fewest or (near[self.fewest - 1 :] - near[: len(near) - self.fewest + 1]).min() > reach:
            return
        # Of k + 1 pieces one is untouched: ``run`` grams in a row on one diagonal. Others lie near it, or count for nothing.
        order = np.sort(diagonal * (len(self.text) + 1) + place)
        intact = order[: max(0, len(order) - self.run + 1)]
        intact = intact[order[self.run - 1 :] - intact == self.run - 1] // (len(self.text) + 1)
        if not len(intact):
            return
        by = np.searchsorted(intact, diagonal)
        close = (np.abs(intact[np.minimum(by, len(intact) - 1)] - diagonal) <= reach) | (np.abs(intact[np.maximum(by - 1, 0)] - diagonal) <= reach)
        place, diagonal = place[close], diagonal[close]
        if self.most_whole:
            yield from self._whole_from_grams(place, diagonal, len(text))
        # The grams that edits leave lie on diagonals at most ``most`` apart: in one of two overlapping rows of bands.
        width = self.most + 1
        band = diagonal // width
        key = _distinct(np.concatenate((band, band - 1)) * (len(self.text) + 1) + np.concatenate((place, place)))
        band, place = np.divmod(key, len(self.text) + 1)
        last = np.arange(len(key)) + self.need[place] - 1
        near = last < len(key)
        last = np.minimum(last, len(key) - 1)
        near &= (self.need[place] > 0) & (band[last] == band) & (place[last] - place <= self.longest - GRAM)
        tried = set()
        for i in np.flatnonzero(near).tolist():
            b, c = int(band[i]), int(place[i])
            for p in range(bisect_left(self.firsts, c - self.longest + GRAM), bisect_right(self.firsts, c)):
                _, s, e, k = self.passages[p]
                if c > e - GRAM or self.least[p] <= 0 or (p, b) in tried:
                    continue
                tried.add((p, b))
                base = b * (len(self.text) + 1)
                if np.searchsorted(key, base + e - GRAM, "right") - np.searchsorted(key, base + s) >= self.least[p]:
                    first = s + b * width - len(self.text)
                    yield p, max(0, first - k), min(len(text), first + 2 * width + e - s + k)

    def _whole_from_grams(self, place: np.ndarray, diagonal: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """The same for the items of more than ``WIDE`` words as wholes."""
        firsts, ends, least = self.whole
        item = np.searchsorted(firsts, place, "right") - 1
        inside = (item >= 0) & (place < ends[item])
        width = self.most_whole + 1
        item, place, band = item[inside], place[inside], diagonal[inside] // width
        key = _distinct((np.concatenate((band, band - 1)) * len(firsts) + np.tile(item, 2)) * (len(self.text) + 1) + np.tile(place, 2))
        code = key // (len(self.text) + 1)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])[: len(code)]
        code, grams = code[starts], np.diff(np.r_[starts, len(code)])
        for c in code[grams >= least[code % len(firsts)]].tolist():
            b, i = divmod(c, len(firsts))
            p = self.windows + i
            _, s, e, k = self.passages[p]
            first = s + b * width - len(self.text)
            yield p, max(0, first - k), min(size, first + 2 * width + e - s + k)

    def _from_pieces(self, text: str) -> Iterator[tuple[int, int, int]]:
        if self.automaton is None:
            return
        for end, (length, where) in self.automaton.iter(text):
            for p, offset in where:
                _, s, e, k = self.passages[p]
                first = end + 1 - length - offset
                yield p, max(0, first - k), min(len(text), first + e - s + k)

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item that the text holds: edits, first and end character of its best place in the normal form.

        Overlapping places of an item's passages are one place, with the fewest edits of any of them.
        """
        if not self.passages or not text:
            return {}
        text = f" {normal(text)} "
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, a, b in (*self._from_grams(text), *self._from_pieces(text)):
            windows[p].append((a, b))
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for p, where in windows.items():
            item_id, s, e, k = self.passages[p]
            passage = self.text[s:e]
            where.sort()
            merged: list[list[int]] = []
            for a, b in where:  # overlapping windows are searched together, once
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                at = text.find(passage, a, b)
                edits, end = (0, at - a + len(passage)) if at >= 0 else myers(passage, text[a:b]) if k else (1, 0)
                if edits <= k:
                    ends = int(k == 0)
                    hits[item_id].append((max(0, a + end - len(passage) + ends - 1), max(0, a + end - ends - 1), edits))
        found: dict[int, tuple[int, int, int]] = {}
        for item_id, where in hits.items():
            where.sort()
            places: list[tuple[int, int, int]] = []
            for a, b, edits in where:
                if places and a <= places[-1][2]:
                    old = places[-1]
                    places[-1] = (min(old[0], edits), old[1], max(old[2], b))
                else:
                    places.append((edits, a, b))
            found[item_id] = min(places)
        return found


@lru_cache(maxsize=1)
def _matcher(rows: tuple[tuple[int, str], ...], *options) -> Matcher:
    """One per worker process, kept from task to task."""
    return Matcher(list(rows), *options)


def _places(docs: DataFrame, benchmark: DataFrame, errors: float, size: int, stride: int, least_words: int, block_chars: int) -> DataFrame:
    """doc_id (the smallest long for null), text_hash, item_id, edits, start, end of every row and item that it holds."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    source = docs.select(id_or_least().alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    names = ["doc_id", "text_hash", "item_id", "edits", "start", "end"]

    def one(block: int) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # ``block_chars`` characters, about
        shared = spark.sparkContext.broadcast(tuple((r[0], r[1]) for r in rows))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(shared.value, errors, size, stride, least_words)
            for pdf in batches:
                out = [(d, h, i, *at) for d, h, t in zip(pdf["doc_id"].tolist(), pdf["text_hash"].tolist(), pdf["text"], strict=True) for i, at in matcher.matches(t).items()]
                yield pd.DataFrame(out, columns=names)

        return source.mapInPandas(scan, "doc_id long, text_hash long, item_id long, edits int, start long, end long")

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, size: int = PASSAGE, stride: int = STRIDE, least_words: int = LEAST_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, edits, start, end."""
    best = F.min(F.struct("edits", "start", "end")).alias("best")
    found = _places(docs, benchmark, errors, size, stride, least_words, block_chars)
    return found.groupBy("doc_id", "item_id").agg(best).select(shown_id(F.col("doc_id")).alias("doc_id"), "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, size: int = PASSAGE, stride: int = STRIDE, least_words: int = LEAST_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item."""
    found = _places(docs, benchmark, errors, size, stride, least_words, block_chars).select(F.col("doc_id").alias("_codrel_id"), F.col("text_hash").alias("_codrel_hash")).distinct()
    keyed = docs.withColumns({"_codrel_id": id_or_least(), "_codrel_hash": F.xxhash64(text_or_empty())})
    return keyed.join(found, ["_codrel_id", "_codrel_hash"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
