"""Whole texts to token ids with a public tokenizer file, inside tasks.

A text is cut at places where the tokenizer cuts in any case; equal pieces are encoded once for each
batch, and frequent ones once for each Python worker.  The ids are those of the library over the
whole text.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

#: Pieces that a worker remembers.  More are encoded anew: this bounds memory, not results.
REMEMBERED = 900_000
_ENCODERS: dict[tuple[str, str, int | None], PieceEncoder] = {}


#: White space other than space and line end (the tokenizers' \s).
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def space_pieces(text: str) -> list[str] | None:
    """For byte-level BPE with the usual word pattern: cut before each space and line end that stands
    alone between two other characters.  That pattern looks at longer runs of white space as a
    whole; a text with one isn't cut (None)."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\0" in text or text[-1].isspace() or any(c in text for c in OTHER_SPACE):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def word_pieces(text: str) -> list[str]:
    """For tokenizers that drop white space: cut at spaces and line ends."""
    return text.replace("\n", " ").split(" ")


class PieceEncoder:
    """ids of many texts: one array, and the place of each text in it.  ``remembered`` pieces, by default REMEMBERED."""

    def __init__(self, path: str, cut: str, remembered: int | None = None):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text with the string of a special token gets its id, as by the library, and isn't cut
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        self.kind = cut
        self.cut = {"space": space_pieces, "word": word_pieces}[cut]
        if cut == "space":  # of the pieces that are joined, just the first id has the space or line end
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for token, i in vocab.items() if token.startswith(("\u0120", "\u010a"))]] = True
        else:
            self.mark = self._plain(["\1"])[0]
        self.uses, self.place = np.zeros(0, np.int32), {}
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Forget all pieces, or all but the ``keep`` that were met most often, and more than once."""
        used = np.flatnonzero(self.uses[: len(self.place)] > 1) if keep else np.zeros(0, np.int64)
        if len(used) > keep:
            used = np.sort(used[np.argsort(-self.uses[used], kind="stable")[:keep]])
        if len(used):
            names = list(self.place)
            kept = [names[i] for i in used.tolist()]
            size = self.length[used]
            ids = self.pool[np.repeat(self.start[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.place = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 17, np.int64)
        self.length = np.zeros(1 << 17, np.int64)
        self.uses = np.zeros(1 << 17, np.int32)
        self.used = 0
        if len(used):
            self._add(kept, ids, size)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.place)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while n + len(pieces) > len(self.start):
            self.start, self.length, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length, self.uses))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(pieces)] = self.used + np.cumsum(size) - size
        self.length[n : n + len(pieces)] = size
        self.used += len(ids)
        self.place.update(zip(pieces, range(n, n + len(pieces))))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces that can stand side by side in one text, and the count of each."""
        if self.kind == "space":
            ids = np.array(self._plain(["".join(pieces)])[0], np.uint32)
            first = np.flatnonzero(self.opens[ids])
        else:
            ids = np.array(self._plain([" \1 ".join(pieces)])[0], np.uint32)
            mark = ids == self.mark[0]
            first = np.concatenate(([0], np.flatnonzero(mark) + 1 - np.arange(1, int(mark.sum()) + 1)))
            ids = ids[~mark]
        if len(first) != len(pieces):
            raise AssertionError("pieces and ids don't match")
        return ids, np.diff(np.append(first, len(ids)))

    def _learn(self, pieces: set[str]) -> None:
        """Add pieces that aren't known.  A comma or full stop after a letter is a token of its own,
        so such pieces are made of others."""
        ended = [p for p in pieces if p[-1:] in (",", ".") and p[-2:-1].isalpha()]
        if ended:
            pieces = pieces.difference(ended)
            pieces.update(p[:-1] for p in ended if p[:-1] not in self.place)
            pieces.update({",", "."}.difference(self.place))
        if self.kind == "space":
            side = [p for p in pieces if p[:1] in (" ", "\n") and not p[-1].isspace()]
        else:
            side = [p for p in pieces if p and "\1" not in p] if len(self.mark) == 1 else []
        for at in range(0, len(side), 20_000):
            some = side[at : at + 20_000]
            self._add(some, *self._joined(some))
        rest = list(pieces.difference(side)) if len(side) < len(pieces) else []
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            self._add(some, *self._flat(self._plain(some)))
        if ended:
            of = np.array([(self.place[p[:-1]], self.place[p[-1]]) for p in ended]).reshape(-1)
            size = self.length[of]
            ids = self.pool[np.repeat(self.start[of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            self._add(ended, ids, size[::2] + size[1::2])

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((t for x in ids for t in x), np.uint32, int(size.sum())), size

    def _find(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, -1 if it isn't known."""
        return np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and len(texts) + 1 offsets."""
        whole: list[str] = []
        pieces: list[str] = []
        count = np.zeros(len(texts), np.int64)
        odd = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            cut = (self.cut(text) if not self.special.search(text) else None) if text else []
            if cut is None:
                odd[i] = True
                whole.append(text)
            else:
                pieces += cut
                count[i] = len(cut)
        index = self._find(pieces)
        lacking = np.flatnonzero(index < 0).tolist()
        new = {pieces[i] for i in lacking}
        # a new piece may bring one more, without its full stop
        most = self.remembered or REMEMBERED
        if len(self.place) + 2 * len(new) + 2 > most:
            self.forget(most // 2)
            index = self._find(pieces)
            lacking = np.flatnonzero(index < 0).tolist()
            new = {pieces[i] for i in lacking}
            if len(self.place) + 2 * len(new) + 2 > most:  # more than are remembered: text by text
                return self._join(self._plain(texts))
        if new:
            self._learn(new)
            index[lacking] = [self.place[pieces[i]] for i in lacking]
        used = np.bincount(index)
        self.uses[: len(used)] += used.astype(np.int32)
        size = self.length[index]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[index] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        place = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
        if not whole:
            return ids, place
        rest = iter(self._plain(whole))
        return self._join([np.asarray(next(rest), np.uint32) if odd[i] else ids[place[i] : place[i + 1]] for i in range(len(texts))])

    @staticmethod
    def _join(parts: list) -> tuple[np.ndarray, np.ndarray]:
        off = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=off[1:])
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, np.uint32) for x in parts)]), off


def encoder(path: str, cut: str, remembered: int | None = None) -> PieceEncoder:
    """The encoder of this Python worker, made once."""
    key = path, cut, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]
