"""Encoding of whole texts by a byte-level BPE vocabulary, in numpy matrices (problem 8).

A batch is split into words by the vocabulary's pattern, and each distinct word is encoded once.
Words are dealt to buckets by length, each a padded matrix of token ids. In every round each row
looks up the ranks of its adjacent pairs in a hash table, merges its leftmost pair of least rank
and is compacted; rows without a pair to merge leave the matrix. Rows longer than ``WIDE`` merge
all places of their least pair in a round, left to right, which gives the same ids in fewer rounds.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which a pre-tokenizer of the kind ByteLevel splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Upper bounds of the buckets' lengths in bytes; a bucket holds at most ``CELLS`` ids.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
WIDE = 128
CELLS = 1 << 21
_NONE = np.iinfo(np.int32).max


def default_path() -> str:
    """The file of the public vocabulary byte_bpe_50k."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return os.path.join("/opt/tokenizers", "byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """Fixed by the format: the letter that stands for each byte in the file: printable ones for themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def word_pattern(pre_tokenizer: dict | None, normalizer: dict | None) -> str:
    """The pattern that a vocabulary's file asks for; what isn't a plain byte-level vocabulary is an error."""
    own = pre_tokenizer or {}
    if normalizer is not None or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or own.get("use_regex") is False:
        raise ValueError(f"not a plain byte-level vocabulary: {normalizer}, {pre_tokenizer}")
    return PATTERN


class PairTable:
    """Open addressing over 64-bit keys made of two ids: rank and merged id of each pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.merged = np.full(1 << bits, -1, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        self.probes = 1
        for k, slot, r, m in zip(keys.tolist(), slots.tolist(), rank.tolist(), merged.tolist()):
            n = 1
            while self.key[slot] != -1:
                slot, n = (slot + 1) & self.mask, n + 1
            self.key[slot], self.rank[slot], self.merged[slot] = k, r, m
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where there is none (ids below 0 have none)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.full(keys.shape, -1, dtype=np.int64)
        open_ = (left >= 0) & (right >= 0)
        at = np.nonzero(open_)
        k, s = keys[at], slot[at]
        place = np.arange(len(k))
        flat = np.full(len(k), -1, dtype=np.int64)
        for _ in range(self.probes):
            seen = self.key[s]
            hit = seen == k
            flat[place[hit]] = s[hit]
            go = ~hit & (seen != -1)
            if not go.any():
                break
            k, s, place = k[go], (s[go] + 1) & self.mask, place[go]
        out[at] = flat
        return out


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, letters = model["vocab"], _letters()
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        for letter, byte in letters.items():
            if letter in vocab:
                self.byte_ids[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids), dtype=np.int32), ids[:, 2])
        self.pattern = regex.compile(word_pattern(whole.get("pre_tokenizer"), whole.get("normalizer")))
        if len(ids) and not (np.diff(ids[:, 2]) > 0).all():
            # merging all places of a pair in one round needs every later merge to have a later id
            raise ValueError("merged ids aren't in the order of the merges")
        self.cache: dict[str, np.ndarray] = {}

    # --- matrices

    def _merge_leftmost(self, ids: np.ndarray) -> np.ndarray | None:
        """One round: every row merges its leftmost pair of least rank; null if no row has one. Padding is -1."""
        slot = self.table.find(ids[:, :-1], ids[:, 1:])
        rank = np.where(slot >= 0, self.table.rank[slot], _NONE)
        at = rank.argmin(axis=1)  # the first of the least
        rows = np.arange(len(ids))
        least = rank[rows, at]
        if (least == _NONE).all():
            return None
        has = least != _NONE
        ids[rows[has], at[has]] = self.table.merged[slot[rows[has], at[has]]]
        # compaction: what follows the merged pair moves one place to the left
        gone = np.where(has, at + 1, ids.shape[1])
        column = np.arange(ids.shape[1] - 1)
        out = np.where(column >= gone[:, None], ids[:, 1:], ids[:, :-1])
        out = np.concatenate([out, np.where(has, -1, ids[:, -1])[:, None]], axis=1)
        return out

    def _encode_bucket(self, words: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words])
        flat = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        result: list[np.ndarray | None] = [None] * len(words)
        place = np.arange(len(words))
        while True:
            out = self._merge_leftmost(ids) if ids.shape[1] > 1 else None
            if out is None:
                for k, row in zip(place, ids):
                    result[k] = row[row >= 0].copy()
                return result  # type: ignore[return-value]
            changed = (out >= 0).sum(axis=1) != (ids >= 0).sum(axis=1)
            if not changed.all():  # rows without a pair to merge are done
                for k, row in zip(place[~changed], out[~changed]):
                    result[k] = row[row >= 0].copy()
                out, place = out[changed], place[changed]
            used = int((out >= 0).sum(axis=1).max())
            ids = np.ascontiguousarray(out[:, : max(1, used)])

    def _encode_wide(self, word: bytes) -> np.ndarray:
        """A long word: all places of the least pair merge in a round, left to right."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].copy()
        while len(ids) > 1:
            slot = self.table.find(ids[:-1], ids[1:])
            rank = np.where(slot >= 0, self.table.rank[slot], _NONE)
            least = rank.min()
            if least == _NONE:
                break
            hits = np.flatnonzero(rank == least)
            if len(hits) > 1 and (np.diff(hits) == 1).any():  # overlapping, as in "aaa": every second of a run
                run = np.concatenate([[0], np.cumsum(np.diff(hits) != 1)])
                first = np.searchsorted(run, run)
                hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
            ids[hits] = self.table.merged[slot[hits[0]]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hits + 1] = False
            ids = ids[keep]
        return ids

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[np.ndarray | None] = [None] * len(raw)
        order = np.argsort([len(r) for r in raw], kind="stable")
        at = 0
        for width in BUCKETS:
            own = []
            while at < len(order) and len(raw[order[at]]) <= width:
                own.append(order[at])
                at += 1
            for a in range(0, len(own), max(1, CELLS // width)):
                part = own[a : a + max(1, CELLS // width)]
                for k, ids in zip(part, self._encode_bucket([raw[k] for k in part], width)):
                    out[k] = ids
        for k in order[at:]:
            out[k] = self._encode_wide(raw[k])
        return out  # type: ignore[return-value]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; an empty or null text has none."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        new = list({w for own in split for w in own if w not in self.cache})
        known = self.cache
        if len(known) + len(new) > 1 << 18:  # the cache is bounded; the words of this batch are kept apart
            known = {w: self.cache[w] for own in split for w in own if w in self.cache}
            self.cache.clear()
        known.update(zip(new, self.encode_words(new)))
        if known is not self.cache and len(known) < 1 << 17:
            self.cache.update(known)
        empty = np.empty(0, dtype=np.int32)
        return [np.concatenate([known[w] for w in own]) if own else empty for own in split]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process and file."""
    return Vocabulary(path)


def encoded(documents: DataFrame, id_column: str, text: Column, path: str | None = None) -> DataFrame:
    """``id`` and ``ids`` (array of int) of every row, without special tokens; no shuffle.

    Empty and null texts have the empty list; the strings of special tokens are ordinary text.
    ``path`` names a vocabulary file that every executor can read.
    """
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        out, size, batch, vocab = [], 0, [], vocabulary(path)
        for t in texts:  # at most a few million characters at a time, so that long texts don't add up
            batch.append(t)
            size += len(t) if t else 0
            if size > 4_000_000:
                out += vocab.encode(batch)
                batch, size = [], 0
        return pd.Series(out + vocab.encode(batch), dtype=object)

    return documents.select(id_column, encode(text).alias("ids"))
