"""Token counts by rank-synchronous merging of byte-pair symbols held as ragged arrays."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame

NONE = np.int64(1) << 40
#: Distinct pre-tokens whose counts a worker keeps, and bytes of text it holds split at a time.
CACHED = 400_000
SLICE = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _unassigned() -> re.Pattern:
    """Code points without a category here, which pattern libraries of other Unicode versions may class otherwise."""
    parts, first = [], None
    for cp in range(0x80, sys.maxunicode + 2):
        odd = cp <= sys.maxunicode and unicodedata.category(chr(cp)) == "Cn"
        if odd and first is None:
            first = cp
        elif not odd and first is not None:
            parts.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return re.compile(f"[{''.join(parts)}]")


class Merger:
    """Counts of byte-level BPE tokens for a tokenizers .json file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, self.path = spec["model"]["vocab"], path
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.first[byte] = vocab[char]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.odd = _unassigned()
        self.cache: dict[str, int] = {}
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each byte sequence.

        All sequences lie end to end in one array. In each round every sequence finds the lowest rank among
        its adjacent pairs and merges all its pairs of that rank from the left; only ranks beside a merge are
        looked up again. Finished sequences leave the arrays.
        """
        sizes = np.array([len(t) for t in tokens], np.int64)
        out = sizes.copy()
        symbol = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        rank = np.full(len(symbol), NONE)
        if len(symbol) > 1:
            rank[:-1] = self.rank(symbol[:-1], symbol[1:])
            rank[:-1][owner[1:] != owner[:-1]] = NONE
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.append(starts, len(symbol)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            if done.any():
                out[owner[starts[done]]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
                lowest, lengths = lowest[~done], lengths[~done]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, lengths))
            if len(at) > 1:  # of overlapping equal pairs, the first, third, ... of a run merge
                fresh = np.concatenate([[True], np.diff(at) != 1])
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            beside = np.zeros(len(symbol), bool)
            beside[place] = True
            beside[place[place > 0] - 1] = True
            look = np.flatnonzero(beside)
            last = look == len(symbol) - 1
            rank[look[last]] = NONE
            look = look[~last]
            rank[look] = np.where(owner[look] == owner[look + 1], self.rank(symbol[look], symbol[look + 1]), NONE)
        return out

    def split(self, text: str, careful: bool) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special strings in it. careful: as the library splits."""
        parts, n = [text], 0
        for special in self.special:
            cut = [p.split(special) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        words: list[str] = []
        for part in parts:
            if careful:
                words += [part[a:b] for _, (a, b) in self.library().pre_tokenizer.pre_tokenize_str(part)]
            else:
                words += self.pattern.findall(part)
        return words, n

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count as one token each, as the library's default has it.

        Words with unassigned code points never stay in the cache, so a text that holds any shows up
        among those with new words and is split again by the library itself.
        """
        if len(self.cache) > CACHED:
            self.cache.clear()
        split = [self.split(text, False) for text in texts]
        new = set().union(*(words for words, _ in split)) - self.cache.keys()
        odd = {w for w in new if self.odd.search(w)} if self.odd.search("".join(w for w in new if not w.isascii())) else set()
        if odd:
            split = [s if odd.isdisjoint(s[0]) else self.split(text, True) for text, s in zip(texts, split)]
            new = set().union(*(words for words, _ in split)) - self.cache.keys()
        if new:
            fresh = list(new)
            self.cache.update(zip(fresh, self.merge([w.encode() for w in fresh]).tolist()))
        get = self.cache.__getitem__
        out = [n + sum(map(get, words)) for words, n in split]
        if odd:
            for word in [w for w in new if self.odd.search(w)]:
                self.cache.pop(word, None)
        return out


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    vocabulary: path of a byte-level BPE .json file, present on every executor. A null text counts as empty:
    0 bytes, 0 tokens. A null id stays null; repeated rows are counted one by one; other columns
    are not read. A map without shuffle; a worker holds the file's merges, a bounded cache of
    pre-token counts and a slice of a batch.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary)
        for batch in batches:
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            ends = np.cumsum(size.to_numpy(zero_copy_only=False)) // SLICE
            counts: list[int] = []
            for block in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends)) + 1) if batch.num_rows else []:
                texts = batch.column(1).slice(int(block[0]), len(block)).to_pylist()
                counts += own.count([t or "" for t in texts])
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
