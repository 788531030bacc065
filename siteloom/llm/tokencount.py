"""Token counts of whole texts by the whole-token shortcut.

A byte-level BPE file splits a text into pre-tokens by a fixed pattern and merges inside
each of them alone. Before anything is counted, every string of the vocabulary is put to
the proof: it stands as one pre-token, and the library encodes it alone as one token.
Pre-tokens that are among the proven strings count one each; only the others are merged,
each distinct one once a worker while its place in a bounded table lasts.

The split is made by a pattern whose character classes are those of another Unicode
version than the library's may be. So each character beyond ASCII is held against the
library the first time a worker meets it; texts with a character that the two split
differently, and texts with the string of an added token, go to the library whole.

Defined cases: null text counts as empty, with no bytes and no tokens; repeated rows count
alike, with null ids too; very long texts count whole; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import CACHES

#: Tokens above which a document is over the limit; merged pre-tokens that one worker keeps.
LIMIT, KEPT = 1024, 400_000
#: Fixed value: how byte-level BPE files split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not path.endswith(".json"):
        raise ValueError("the whole-token shortcut needs a tokenizers file of byte-level BPE")
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def proven(tokenizer) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and alone encode as one token."""
    letters = byte_letters()
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # part of a character
            continue
    strings = [s for s in strings if not any(a in s for a in added)]
    alone = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    split = regex.compile(PATTERN).findall
    return frozenset(s for s, e in zip(strings, alone, strict=True) if len(e.ids) == 1 and split(s) == [s] and len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1)


class Counter:
    """Token counts of texts, equal to the library's for every text."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.tokenizer, self.kept = _loaded(path), kept
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        self.whole = proven(self.tokenizer) if self._known() else None
        #: The id of a line feed between two words, where it always stands alone.
        feed = self._ids(["\n", " a", " a\n b", " b"])
        self.feed = feed[0][0] if len(feed[0]) == 1 and feed[2] == feed[1] + feed[0] + feed[3] else None
        self.merged: dict[str, int] = {}
        self.seen: dict[str, bool] = {}

    def _known(self) -> bool:
        """Whether the file splits by the pattern, and does nothing else before merging."""
        import json

        parts = json.loads(self.tokenizer.to_str())
        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        return (
            parts["normalizer"] is None
            and model["type"] == "BPE"
            and not model.get("dropout")
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        )

    def _agrees(self, char: str) -> bool:
        """Whether pattern and library put a character into the same class."""
        ours = self.seen.get(char)
        if ours is None:
            probe = [f"a{char}1", f"!{char}!"]
            ours = self.seen[char] = all([t for t, _ in self._pieces(p)] == self.split(p) for p in probe)
        return ours

    def _pieces(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return [(text[a:b], (a, b)) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> bool:
        if self.whole is None or any(a in text for a in self.added):
            return False
        return text.isascii() or all(self._agrees(c) for c in set(text) if c > "\x7f")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> None:
        """Merge pre-tokens: those of a space and more in lines of many, whose ends show as the token of a line feed."""
        if len(self.merged) + len(words) > self.kept:
            self.merged.clear()
        lined = [w for w in words if self.feed is not None and w[0] == " " and not w[-1].isspace() and "\n" not in w]
        alone = [w for w in words if self.feed is None or not (w[0] == " " and not w[-1].isspace() and "\n" not in w)]
        for at in range(0, len(lined), 256):
            part = lined[at : at + 256]
            ids = np.array(self._ids(["\n".join(part)])[0], np.int64)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(part) - 1:
                self.merged.update(zip(part, (np.diff(ends, prepend=-1, append=len(ids)) - 1).tolist(), strict=True))
            else:
                alone += part
        for at in range(0, len(alone), 256):
            part = alone[at : at + 256]
            self.merged.update(zip(part, map(len, self._ids(part)), strict=True))

    def count(self, text: str) -> tuple[int, int | None]:
        """Number of tokens, and how many of them the shortcut gave (null where the library counted the text)."""
        if not self._plain(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids), None
        pieces = self.split(text)
        rest = [p for p in pieces if p not in self.whole]
        whole = len(pieces) - len(rest)
        total, new = whole, []
        get = self.merged.get
        for p in rest:
            n = get(p)
            if n is None:
                new.append(p)
            else:
                total += n
        if new:
            self._merge(list(dict.fromkeys(new)))
            total += sum(self.merged[p] for p in new)
        return total, whole


@lru_cache(maxsize=2)
def counter(path: str, kept: int = KEPT) -> Counter:
    """The counter of this Python worker."""
    return Counter(path, kept)


CACHES.append(counter.cache_clear)


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, n_whole)`` of every row, the id as it comes; one pass, no shuffle.

    ``n_whole``: tokens that the shortcut gave, null where the library counted the text whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        for batch in batches:
            found = [tool.count(t.as_py()) for t in batch["text"]]
            columns = [batch["id"], batch["n_bytes"], pa.array([n for n, _ in found], pa.int64()), pa.array([n > limit for n, _ in found], pa.bool_()), pa.array([w for _, w in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
