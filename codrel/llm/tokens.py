"""Whole-text token ids from a byte-level BPE vocabulary file, at a few microseconds a word.

The pre-tokenizer of such a vocabulary never joins a space that has a visible neighbour on
its left to what precedes it. A text can therefore be cut before its spaces, and each piece
encoded once and remembered. Texts for which that cut is not safe (runs of white space,
special tokens in the text) are encoded whole by the library, so ids always equal
``Tokenizer.encode(text, add_special_tokens=False).ids``.

New words are encoded many at a time by the library's merge model alone, without its
pre-tokenizer, parted by a byte that no merge takes. That gives the same ids for a word whose
parts (letters, digits, marks) meet only in pairs of bytes that no token holds, for then no
merge crosses a cut that the pre-tokenizer would have made; other words take the whole way.
Words on either side of a new line, a pair that hardly ever comes again, are encoded apart: the
pre-tokenizer makes a token of a new line between two visible characters and starts anew after it.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np

#: White space around a space, or a space at an end of the text: the cut is not safe there.
_UNSAFE = re.compile(r"\s \s|\s \Z|\A |\A\Z")
#: Runs of letters (and a few number signs, sorted out later), of decimal digits, and of others.
_RUNS = re.compile(r"[^\W\d_]+|\d+|[\W_]+")
#: Words kept per worker process. Words met later are encoded batch by batch and not kept.
WORDS_KEPT = 800_000
#: Marks that the pre-tokenizer cuts from the letters before them, and that start no contraction.
_MARKS = string.punctuation.replace("'", "")
#: Runs of marks, and words after a new line, kept per worker process between batches.
_MARKS_KEPT, _STARTS_KEPT = 100_000, 100_000
#: Words encoded in one call of the library.
_RUN = 300


def _byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is visible in Latin-1, else the next one from 256 on."""
    letters, free = [], 256
    for b in range(256):
        visible = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        letters.append(chr(b) if visible else chr(free))
        free += not visible
    return letters


class Encoder:
    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A byte-level vocabulary writes each byte as one character.
        self.widths = np.zeros(size, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words_kept = words_kept
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self._prepare(Tokenizer, vocabulary)

    def _prepare(self, kind, vocabulary: dict[str, int]) -> None:
        """The merge model alone, its letters, the pairs of bytes inside tokens, and a byte for between words."""
        self.model, letters = None, _byte_letters()
        plan = json.loads(self.tokenizer.to_str())
        cutter = plan["pre_tokenizer"] or {}
        if plan["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or plan["model"]["type"] != "BPE":
            return
        tokens = [t for t in vocabulary if t not in self.special]
        held = set().union(*(t for t in tokens if len(t) > 1))
        free = [letters[b] for b in (0xFF, 0xFE, 0xC0, 0xC1) if letters[b] in vocabulary and letters[b] not in held]  # no byte of UTF-8
        if free:
            self.model, self.between, self.between_id = kind(self.tokenizer.model), free[0], vocabulary[free[0]]
            self.letters = dict(enumerate(letters))
            self.pairs = {t[i : i + 2] for t in tokens for i in range(len(t) - 1)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, word: str) -> bool:
        """Whether merges alone give the word's ids: no merge can cross from one of its parts to the next."""
        if word.isalpha():
            return True
        if "'" in word:
            return False
        parts = _RUNS.findall(word)
        for part in parts:
            if not (part.isalpha() or part.isascii() and (part.isdigit() or sum(map(str.isspace, part)) == 0)):
                if not (part.isascii() and len(part) == 2 and part[1] == "\n" and not part[0].isspace()):  # a mark and a new line
                    return False
        cuts = list(zip(parts, parts[1:], strict=False)) + [(p[0], p[1]) for p in parts if p[-1] == "\n"]
        for a, b in cuts:
            x, y = a[-1].encode()[-1], b[0].encode()[0]
            if self.letters[x] + self.letters[y] in self.pairs:
                return False
        return True

    def _merged(self, words: list[str], before: str = " ") -> dict[str, bytes]:
        """Ids of plain words with a space before each (or nothing), by the merge model."""
        out: dict[str, bytes] = {}
        runs = [words[i : i + _RUN] for i in range(0, len(words), _RUN)]
        mark = self.letters[0]
        made = [(before + f"\0{before}".join(run)).encode().decode("latin-1").translate(self.letters).replace(mark, self.between) for run in runs]
        for run, e in zip(runs, self.model.encode_batch_fast(made, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.between_id)
            raw, at = ids.tobytes(), 0
            for word, end in zip(run, (*(4 * ends).tolist(), len(raw)), strict=True):
                out[word] = raw[at:end]
                at = end + 4
        return out

    def _cut_by_width(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word with a space before it; the words are joined to runs and the ids cut again by their byte widths."""
        out: dict[str, bytes] = {}
        runs = [words[i : i + _RUN] for i in range(0, len(words), _RUN)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(run) for run in runs], add_special_tokens=False)
        for run, e in zip(runs, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([1 + len(w.encode("utf-8")) for w in run])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            raw, at = ids.tobytes(), 0
            for word, cut in zip(run, cuts.tolist(), strict=True):
                out[word] = raw[at : 4 * cut]
                at = 4 * cut
        return out

    def _words(self, words: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of new words with a space before each, and of the letters alone of those that end in marks; apart from them those of words with new lines."""
        if self.model is None:
            return self._cut_by_width(words), {}
        if len(self.marks) > _MARKS_KEPT:
            self.marks.clear()
        if len(self.starts) > _STARTS_KEPT:
            self.starts.clear()
        known, lines = self.known, {}
        for w in words:
            if "\n" in w and all(parts := w.split("\n")) and w.split() == parts:
                lines[w] = parts
        if lines:
            words = {w for w in words if w not in lines}.union(parts[0] for parts in lines.values() if parts[0] not in known)
            self._started(list({p for parts in lines.values() for p in parts[1:]}.difference(self.starts)))
        wanted, marked, other = set(), [], []
        for w in words:
            if w.isalpha():
                wanted.add(w)
                continue
            letters = w.rstrip(_MARKS)
            if letters.isalpha():
                marked.append((w, letters, w[len(letters) :]))
                if letters not in known:
                    wanted.add(letters)
            elif "\0" not in w and self._plain(w):
                wanted.add(w)
            else:
                other.append(w)
        out = self._merged(list(wanted)) | self._cut_by_width(other)
        self._mark({marks for *_, marks in marked})
        for w, letters, marks in marked:
            out[w] = (known.get(letters) or out[letters]) + self.marks[marks]
        starts = self.starts
        return out, {w: (known.get(parts[0]) or out[parts[0]]) + b"".join([starts[p] for p in parts[1:]]) for w, parts in lines.items()}

    def _mark(self, runs: set[str]) -> None:
        new = list(runs.difference(self.marks))
        self.marks.update(zip(new, self._whole(new), strict=True))

    def _started(self, words: list[str]) -> None:
        """Learns the ids of a new line and the word after it."""
        cut = [(w, letters) for w in words if (letters := w.rstrip(_MARKS)).isalpha()]
        rest = list(set(words).difference(w for w, _ in cut))
        letters = self._merged(list({x for _, x in cut}), "")
        self._mark({"\n", *(w[len(x) :] for w, x in cut if len(x) < len(w))})
        line = self.marks["\n"]
        for w, x in cut:
            self.starts[w] = line + letters[x] + (self.marks[w[len(x) :]] if len(x) < len(w) else b"")
        for w, ids in zip(rest, self._whole(rest), strict=True):
            self.starts[w] = line + ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and every collection would go through all known words
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        known = self.known
        whole: list[int] = []
        split: list[tuple[int, str, list[str], list[bytes | None], list[str]]] = []
        missing: set[str] = set()
        for k, text in enumerate(texts):
            first, *rest = text.split(" ")
            if not first or any(s in text for s in self.special):
                whole.append(k)
                continue
            ids = list(map(known.get, rest))
            new = list(compress(rest, map(is_, ids, repeat(None)))) if None in ids else []
            missing.update(new)
            split.append((k, first, rest, ids, new))
        # Words that start or end with white space meet the spaces around them; they are never kept.
        odd = {w for w in missing if not w or len(w.strip()) < len(w)}
        if odd:
            unsafe = {s[0] for s in split if not odd.isdisjoint(s[4]) and _UNSAFE.search(texts[s[0]])}
            whole += sorted(unsafe)
            split = [s for s in split if s[0] not in unsafe]
            missing = set().union(*(s[4] for s in split))
            odd &= missing
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        if split:
            fresh, lines = self._words(list(missing - odd))
            room = self.words_kept - len(known)
            known.update(fresh if room >= len(fresh) else {w: fresh[w] for w in list(fresh)[: max(0, room)]})
            fresh.update(lines)
            fresh.update(zip(odd, self._whole([" " + w for w in odd]), strict=True))
            for (k, _, _, ids, new), head in zip(split, self._whole([s[1] for s in split]), strict=True):
                found = map(fresh.__getitem__, new)
                out[k] = head + b"".join([next(found) if i is None else i for i in ids] if new else ids)
        return out  # type: ignore[return-value]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so that words stay known from task to task."""
    return Encoder(path)
