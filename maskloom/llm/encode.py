"""Whole texts to token ids by a public tokenizer, each distinct piece encoded once per worker.

The byte-level pre-tokenizer always cuts between a character that is no white space and ASCII white
space after it, and between an ASCII letter or digit and an ASCII sign. Texts are cut there, distinct
pieces go through the tokenizer, and ids are put together again in order. A text with other white space (or control characters that some engines count as such)
or with the content of an added token stays one piece, so results equal those of encoding it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from maskloom.llm.blocks import SPACE, Block, hash_runs

#: White space beyond ASCII, and control characters near it, as UTF-8.
_OTHER = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8d\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
SIGN = np.zeros(256, dtype=bool)
SIGN[0x21:0x7F] = True
SIGN &= ~ALNUM
_PIECES = 1_200_000
_IDS = 8_000_000
_JOIN = 1 << 16
_WORKER: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for the tokenizer file at `path`, taken as it is."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path, added=True)
    return _WORKER[path]


class Encoder:
    """Ids of texts. With `added`, added tokens in a text get their ids, as the tokenizer file has it; else they are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces come once each
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # one character stands for one byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        contents = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(map(re.escape, contents))) if added and contents else None
        #: Pieces put together could only make an added token out of parts if it holds white space.
        self.joins = self.added is None or not any(SPACE[list(c)].any() for c in contents)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: np.ndarray) -> None:
        """Encode these pieces and remember them. Pieces of white space and a word can share a call, unless they stand apart."""
        joins = SPACE[data[starts]] & ~SPACE[data[ends - 1]] & (ends - starts < _JOIN) & ~apart & self.joins
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        texts, part, size, sizes = [], [], 0, ends - starts
        for i in order[:n]:
            part.append(data[starts[i] : ends[i]].tobytes())
            size += sizes[i]
            if size >= _JOIN:
                texts.append(b"".join(part))
                part, size = [], 0
        if part:
            texts.append(b"".join(part))
        together = self._encode(texts) if texts else []
        alone = self._encode([data[starts[i] : ends[i]].tobytes() for i in order[n:]])
        ids = np.concatenate([np.zeros(0, np.uint32), *together, *alone])
        # the joined ids are cut where the byte widths of tokens reach the ends of pieces
        k = sum(map(len, together))
        until = np.searchsorted(np.cumsum(self.width[ids[:k]]), np.cumsum(sizes[order[:n]])) + 1
        count = np.concatenate([np.diff(until, prepend=0), np.array([len(a) for a in alone], dtype=np.int64)])
        if int(count.sum()) != len(ids):
            raise ValueError("token widths do not add up to the text")
        place = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        new = keys[order]
        at = np.argsort(new)
        where = np.searchsorted(self.keys, new[at])
        self.keys = np.insert(self.keys, where, new[at])
        self.place = np.insert(self.place, where, place[at])
        self.count = np.insert(self.count, where, count[at])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts in order, and each text's number of ids."""
        data = block.data
        n_docs = len(block)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        space = SPACE[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (ALNUM[data[:-1]] & SIGN[data[1:]])
        raw = data.tobytes()
        if _OTHER.search(raw):
            for i in range(n_docs):
                if _OTHER.search(raw, int(block.starts[i]), int(block.ends[i])):
                    cut[block.starts[i] : block.ends[i]] = False
        whole = np.zeros(n_docs, dtype=bool)
        if self.added and self.added.search(raw):
            for i in range(n_docs):
                if self.added.search(raw, int(block.starts[i]), int(block.ends[i])):
                    cut[block.starts[i] : block.ends[i]] = False
                    whole[i] = True
        cut[block.starts[block.starts < block.ends]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = hash_runs(data, starts, ends)
        code, seen = pd.factorize(keys)
        if len(self.keys) + len(seen) > _PIECES or len(self.ids) > _IDS:
            self.clear()
        first = np.empty(len(seen), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        at = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == seen[inside]
        if not known.all():
            new = first[~known]
            self._learn(seen[~known], data, starts[new], ends[new], whole[np.searchsorted(block.ends, starts[new], side="right")])
            at = np.searchsorted(self.keys, seen)
        count = self.count[at][code]
        place = self.place[at][code]
        until = np.cumsum(count)
        ids = self.ids[np.repeat(place - (until - count), count) + np.arange(until[-1])]
        doc = np.searchsorted(block.ends, starts, side="right")
        return ids, np.bincount(doc, weights=count, minlength=n_docs).astype(np.int64)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with an end id after each document."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1
