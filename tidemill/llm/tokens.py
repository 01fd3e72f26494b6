"""Token ids by a public tokenizer file, with each distinct piece encoded once per worker.

A BPE tokenizer first cuts a text into pieces and then encodes each piece on its own, so the ids
of a text are the ids of its pieces in order. Pieces repeat a great deal: they are looked up in a
bounded table, and only pieces not seen before go to the tokenizers library, many in one call.
The cut is done here for texts of the Latin blocks (where the character classes are written out
below); any other text, and any text that spells a special token, goes to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata

import numpy as np

#: Code points below this are in the Latin blocks.
LATIN_END = 0x250
#: Pieces remembered by one worker; beyond that the table starts anew.
TABLE_PIECES = 1_100_000
#: Pieces that go to the library in one text.
JOINED = 400


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _W = _class("L"), _class("N"), r"\t-\r \x85\xa0"
#: Anything outside the Latin blocks, and control characters on which whitespace classes differ.
_UNUSUAL = re.compile("[^\\t-\\r -~\\xa0-ɏ]")
_WORD_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_W}{_L}{_N}]+")
_BYTE_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_PLAIN = re.compile(f"[{_L}]+")
_SPACED = re.compile(f" [{_L}]+")


class _Index(dict):
    """piece -> its number in the table; -1 for pieces not in it."""

    def __missing__(self, piece: str) -> int:
        return -1


#: What closes a sentence, in UTF-8: marks and line ends, and the full stops of scripts beyond Latin.
_CLOSES = re.compile("|".join(map(re.escape, ".!?\n\u0589\u061f\u06d4\u0964\u0965\u1362\u2026\u3002\uff01\uff0e\uff1f\uff61")).encode())


class Encoder:
    """encode(texts) gives the ids of each text, and where its sentences end.

    path: a tokenizers JSON file. kind: "word" (lower case, white space dropped) or "byte".
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word = kind == "word"
        self.cut = _WORD_CUT if self.word else _BYTE_CUT
        self.widths: np.ndarray | None = None
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.ends_sentence = np.zeros(1 << 16, bool)
        self.used = 0

    def _library(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self, pieces: list[str]) -> None:
        joined, alone = [], []
        if self.word:
            for p in pieces:
                (joined if _PLAIN.fullmatch(p) else alone).append(p)
            groups = [(joined[i : i + JOINED], " ", 1) for i in range(0, len(joined), JOINED)]
        else:
            bare = []
            for p in pieces:
                (joined if _SPACED.fullmatch(p) else bare if _PLAIN.fullmatch(p) else alone).append(p)
            groups = [(joined[i : i + JOINED], "", 1) for i in range(0, len(joined), JOINED)]
            groups += [(bare[i : i + JOINED], "\n", 2) for i in range(0, len(bare), JOINED)]
        for (group, _, step), enc in zip(groups, self.tokenizer.encode_batch([b.join(g) for g, b, _ in groups], add_special_tokens=False), strict=True):
            words = np.fromiter(enc.word_ids, np.int64, len(enc))
            if len(words) and words[-1] == (len(group) - 1) * step:
                ids = np.fromiter(enc.ids, np.int32, len(enc))
                if step == 2:  # without what stands between the pieces
                    ids, words = ids[words % 2 == 0], words[words % 2 == 0]
                self._add(group, ids, np.searchsorted(words, np.arange(len(group)) * step, side="right"))
            else:
                alone += group
        if alone:
            found = [e.ids for e in self._library(alone)]
            self._add(alone, np.fromiter(itertools.chain.from_iterable(found), np.int32), np.cumsum([len(x) for x in found]))
            first = len(self.index) - len(alone)
            for k, p in enumerate(alone):
                self.ends_sentence[first + k] = p[-1:] in (".", "!", "?") or "\n" in p

    def _add(self, pieces: list[str], ids: np.ndarray, upto: np.ndarray) -> None:
        """Pieces not in the table yet, their ids one after another, and where each one's end."""
        k, end = len(self.index), self.used + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while k + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
            self.ends_sentence = np.concatenate([self.ends_sentence, np.zeros(len(self.ends_sentence), bool)])
        self.ids[self.used : end] = ids
        self.starts[k] = self.used
        self.starts[k + 1 : k + 1 + len(pieces)] = self.used + upto
        self.index.update(zip(pieces, range(k, k + len(pieces)), strict=True))
        self.used = end

    def _usual(self, text: str) -> str | None:
        if _UNUSUAL.search(text) or any(s in text for s in self.special):
            return None
        return unicodedata.normalize("NFC", text).lower() if self.word else text

    def _looked_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of pieces, how many each has, and whether it ends a sentence. More distinct pieces than the table holds go in halves."""
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if (missing := np.flatnonzero(at < 0)).size:
            new = sorted({pieces[i] for i in missing.tolist()})
            if len(self.index) + len(new) > TABLE_PIECES:  # the table starts anew
                new = sorted(set(pieces))
                if len(new) > TABLE_PIECES and len(pieces) > 1:
                    half = len(pieces) // 2
                    parts = self._looked_up(pieces[:half]), self._looked_up(pieces[half:])
                    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                self._clear()
                missing = np.arange(len(pieces))
            self._learn(new)
            at[missing] = [self.index[pieces[i]] for i in missing.tolist()]
        begin, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(length)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - length), length)]
        return ids, length, self.ends_sentence[at]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, whether a sentence ends with each, and where each text begins (one more: the end)."""
        plain = [self._usual(t) for t in texts]
        cuts = [[] if p is None else self.cut.findall(p) for p in plain]
        pieces = list(itertools.chain.from_iterable(cuts))
        ids, length, closes = self._looked_up(pieces)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        sentence = np.zeros(total, bool)
        last = ends[closes & (length > 0)] - 1
        sentence[last] = True
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cuts)])]
        if all(p is not None for p in plain):
            return ids, sentence, upto
        whole = iter(self._library([t for t, p in zip(texts, plain, strict=True) if p is None]))
        parts, marks = [], []
        for k, p in enumerate(plain):
            part = ids[upto[k] : upto[k + 1]] if p is not None else np.array(next(whole).ids, np.int32)
            parts.append(part)
            marks.append(sentence[upto[k] : upto[k + 1]] if p is not None else self._closing(texts[k], part))
        return np.concatenate(parts), np.concatenate(marks), np.cumsum([0, *map(len, parts)])

    def _closing(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Which ids of a whole text close a sentence, by the bytes they stand for; none if these aren't the text's."""
        marks = np.zeros(len(ids), bool)
        if self.word or not len(ids):
            return marks
        if self.widths is None:
            own = self.tokenizer.get_added_tokens_decoder()
            sizes = {i: len(t) for t, i in self.tokenizer.get_vocab().items()} | {i: len(t.content.encode()) for i, t in own.items()}
            self.widths = np.zeros(max(sizes) + 1, np.int64)
            self.widths[list(sizes)] = list(sizes.values())
        data, ends = text.encode(), np.cumsum(self.widths[ids])
        if ends[-1] == len(data):
            stops = np.fromiter((m.end() for m in _CLOSES.finditer(data)), np.int64)
            marks[np.searchsorted(ends, stops)] = True  # the id that has the last byte
        return marks

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, kind)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
