"""Token ids of a word-level BPE file, memoised by word.

The tokenizer lower-cases, drops white space and never merges across it, so the
ids of a text are those of its blank-separated words. Words are found and hashed
in bulk; only words not seen before by this worker reach the tokenizer. The memo
has a fixed size and starts anew when full.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from ._words import Words

_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Words of printable ASCII and Latin-1 letters are split here; any other goes through the whole tokenizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The usual byte-level alphabet: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordTokens:
    """ids of texts under the file at ``path``; ``words``: entries of the memo at most."""

    def __init__(self, path: str, words: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.most = max(words, 1 << 17)
        words = self.most
        self.mask = np.uint64(4 * words - 1)
        marks = [i for t, i in self.whole.get_vocab().items() if re.fullmatch(r"[^\w\s]*[.!?]+[^\w\s]*</w>", t)]
        #: token ids that end a sentence
        self.enders = np.zeros(self.whole.get_vocab_size() + 1, bool)
        self.enders[marks] = True
        self.comma, self.stop = (self.whole.encode(c, add_special_tokens=False).ids[0] for c in ",.")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.at = np.zeros(int(self.mask) + 1, np.int32)
        self.begin = np.zeros(self.most + 1, np.int64)
        self.ids = np.empty(0, np.int32)
        self.held = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the memo, or -1."""
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & int(self.mask)
        return out

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        slot = (h & self.mask).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.at[slot[won]] = value[won]
            h, value, slot = h[~won], value[~won], (slot[~won] + 1) & int(self.mask)

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        pieces, owner, out = [], [], [[] for _ in words]
        for i, raw in enumerate(words):
            w = raw.decode("utf-8", "surrogatepass")
            if w.isascii() and w.isalpha():
                pieces.append(w)
                owner.append(i)
            elif _PLAIN.fullmatch(w) and "<|" not in w:
                found = _PIECE.findall(unicodedata.normalize("NFC", w).lower())
                pieces += [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in found]
                owner += [i] * len(found)
            else:
                out[i] = self.whole.encode(w.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
        for i, e in zip(owner, self.model.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            out[i] += e.ids
        return out

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, tokens of each text)."""
        w = Words(texts)
        start, end, data = w.start, w.end.copy(), w.data
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        # a last comma or full stop after an ASCII or Latin-1 letter or a digit is a piece of its own
        last, before, third = data[end - 1], data[np.maximum(end - 2, 0)], data[np.maximum(end - 3, 0)]
        plain = (before >= 97) & (before <= 122) | (before >= 48) & (before <= 57)
        latin = (third == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (end - start >= 3)
        tail = ((last == 44) | (last == 46)) & (end - start >= 2) & (plain | latin)
        end -= tail
        h = w.spans(start, end)
        h[h == 0] = 1
        index = self._find(h)
        lost = np.flatnonzero(index < 0)
        if len(lost):
            unique, first = np.unique(h[lost], return_index=True)
            if self.held + len(unique) > self.most:
                self._clear()
                lost = np.arange(len(h))
                unique, first = np.unique(h, return_index=True)
            blob, at = data.tobytes(), lost[first]
            got = self._encode([blob[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._put(unique, np.arange(self.held, self.held + len(unique)))
            self._append(sizes, np.fromiter((i for g in got for i in g), np.int32, int(sizes.sum())))
            index[lost] = self._find(h[lost])
        size = self.begin[index + 1] - self.begin[index]
        total = size + tail
        stop = np.cumsum(total)
        out = np.empty(int(stop[-1]), np.int32)
        here = stop - total
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(here, size) + spread] = self.ids[np.repeat(self.begin[index], size) + spread]
        out[stop[tail] - 1] = np.where(last[tail] == 44, self.comma, self.stop)
        per = np.concatenate([[0], stop])[w.first + w.count] - np.concatenate([[0], stop])[w.first]
        return out, per

    def _append(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds words; the array of ids doubles as it fills."""
        begin = int(self.begin[self.held])
        self.begin[self.held + 1 : self.held + 1 + len(sizes)] = begin + np.cumsum(sizes)
        self.held += len(sizes)
        if begin + len(ids) > len(self.ids):
            grown = np.empty(max(2 * len(self.ids), begin + len(ids), 1 << 16), np.int32)
            grown[:begin] = self.ids[:begin]
            self.ids = grown
        self.ids[begin : begin + len(ids)] = ids


def segments(text: str, most: int) -> list[str]:
    """A long text cut at blanks into parts of about ``most`` characters; a word is never cut."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.rfind(" ", at, at + most)
        cut = cut if cut > at else text.find(" ", at + most)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]
