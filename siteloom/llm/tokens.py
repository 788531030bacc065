"""Token ids of whole texts from a ``tokenizers`` file, cached by word.

The byte-level and word-end tokenizers supported here never merge across a single
space or newline between two other characters, so a text falls apart there into
pieces that can be encoded alone, and so it does before marks that end a word. Few
pieces are new in a batch: the others come from a bounded cache, which one Python worker
keeps between tasks. A text in which a space or newline touches other white space, of
any script, or its start or end, and a text with the string of an added token, go to the
tokenizer whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siteloom.llm.common import CACHES, in_use

#: Words that one worker keeps; past it the cache starts anew.
CACHED = 800_000
_CHUNK = 4 << 20  # characters that are split at once
#: White space of Unicode, and the separators that some tools count as such.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHOLE = rf"^[ \n]|[ \n]$|[ \n]{_WHITE}|{_WHITE}[ \n]"
_MARKS = r"""(\pL)([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)([ \n])"""


class Encoder:
    """Ids of texts; equal to the tokenizer's own, which adds none to them.

    A text that holds the string of an added token gets its id, as from the library.
    With ``literal`` such a string is text like any other, which is safer for texts of
    unknown origin.
    """

    def __init__(self, path: str, cached: int = CACHED, literal: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached = cached
        #: Whether white space leaves no trace in the ids.
        self.blind = len({tuple(x) for x in self._plain(["a", " a", "\na"])}) == 1
        # New words are encoded many at once, joined by a text with an id that no word has.
        self.head, self.between, self.char = ("", " | ", "|") if self.blind else (" ", "\n", "\n")
        one, two, joint = self._plain([self.head + "a", self.head + "a" + self.between + self.head + "a", self.char])
        self.joint = joint[0] if len(joint) == 1 and two == one + joint + one else None
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}  # a word's number; its ids are flat[start[number]:][:length[number]]
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        for name, need in (("flat", self.used + len(ids)), ("start", len(self.cache) + len(words)), ("length", len(self.cache) + len(words))):
            if need > len(have := getattr(self, name)):
                setattr(self, name, np.resize(have, 2 * need))
        at = len(self.cache)
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[at : at + len(words)] = lengths
        self.start[at : at + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.cache.update(zip(words, range(at, at + len(words)), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Put ids of new words into the cache."""
        alone = new
        if self.joint is not None:
            many = [w for w in new if w.startswith(self.head) and self.char not in w]
            alone = [w for w in new if not w.startswith(self.head) or self.char in w]
            for at in range(0, len(many), 256):
                part = many[at : at + 256]
                ids = np.array(self._plain([self.between.join(part)])[0], np.uint32)
                ends = np.flatnonzero(ids == self.joint)
                if len(ends) != len(part) - 1:
                    alone += part
                    continue
                bounds = np.concatenate([[-1], ends, [len(ids)]])
                self._add(part, ids[ids != self.joint], np.diff(bounds) - 1)
        for at in range(0, len(alone), 1024):
            part = alone[at : at + 1024]
            found = self._plain(part)
            self._add(part, np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _numbers(self, words: list[str]) -> np.ndarray:
        get = self.cache.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if (missing := np.flatnonzero(found < 0)).size:
            if len(self.cache) + len(missing) > self.cached:
                self._clear()
                get, missing = self.cache.get, np.arange(len(words))
            self._learn([words[i] for i in missing])
            found[missing] = np.fromiter((get(words[i]) for i in missing), np.int64, len(missing))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        in_use()
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0
        whole = pc.match_substring_regex(pa.array(texts, pa.large_string()), _WHOLE).to_pylist()
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, np.uint32)
            elif whole[i] or any(a in t for a in self.added):
                out[i] = np.array(self._plain([t])[0], np.uint32)
            else:
                group.append(i)
                size += len(t)
                if size > _CHUNK:
                    self._encode(texts, group, out)
                    group, size = [], 0
        if group:
            self._encode(texts, group, out)
        return out

    def _encode(self, texts: list[str], group: list[int], out: list) -> None:
        """Each text as pieces, split by Arrow: words with the space or newline before them, and
        the ASCII marks, but apostrophes, between a letter and the next space or newline."""
        whole = pa.array([texts[i] for i in group], pa.large_string())
        marked = pc.replace_substring_regex(whole, _MARKS, r"\1" + "\x00" + r"\2\3")
        for space in (" ", "\n"):
            marked = pc.replace_substring(marked, space, "\x00" if self.blind else "\x00" + space)
        parts = pc.split_pattern(marked, "\x00")
        if any("\x00" in texts[i] for i in group):
            clean = [i for i in group if "\x00" not in texts[i]]
            for i in group:
                if "\x00" in texts[i]:
                    out[i] = np.array(self._plain([texts[i]])[0], np.uint32)
            if clean:
                self._encode(texts, clean, out)
            return
        coded = pc.dictionary_encode(parts.flatten())
        words = self._numbers(coded.dictionary.to_pylist())
        index = words[coded.indices.to_numpy()]
        n, begin = self.length[index], self.start[index]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = parts.offsets.to_numpy()
        stops = np.concatenate([[0], ends])[offsets]
        for k, i in enumerate(group):
            out[i] = ids[stops[k] : stops[k + 1]]


@lru_cache(maxsize=4)
def encoder(path: str, cached: int = CACHED, literal: bool = False) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, cached, literal)


CACHES.append(encoder.cache_clear)
