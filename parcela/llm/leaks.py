"""Evaluation texts leaking into a corpus: a distributed positional inverted index (problem 9).

The index holds every word of the training texts and is built once, for any items. It is dealt by
document: each segment holds the sorted postings of its own documents, so that building it moves
nothing. An item's phrase is looked up in every segment from its rarest terms: their lists, shifted
by the term's place in the item, give the few places where the item could lie, and only there the
other terms' shifted lists are intersected. Rarity is that in the whole corpus.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.storage import materialize

#: Test items of one lookup, whose terms go to every task; more are looked up in blocks.
ITEMS = 50_000
#: Words after which a segment is closed; a text of more is a segment of its own.
SEGMENT = 250_000
#: Places between two documents of a segment.
GAP = 64

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without accents, composed or not. Null has none."""
    if not text:
        return []
    s = text.lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return _WORD.findall(s)


@lru_cache(maxsize=1 << 20)
def term(word: str) -> int:
    """The 64-bit number under which a word is indexed."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def positional_index(documents: DataFrame, id_column: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """Segments of postings of every word of all documents, whole texts: an index for any items.

    Of each segment, as bytes: ``terms`` (ascending, 64 bits), ``ends`` of their lists, ``postings``
    (the lists one after the other, each ascending, 32 bits) and ``starts`` of its documents; ``ids``
    are the documents'. A posting is a word's position in the segment, in which documents follow each
    other ``gap`` apart. Write it where it is to be kept.
    """

    def build(ids: list, found: list[list[str]]) -> tuple:
        size = np.array([len(f) for f in found], dtype=np.int64)
        starts = np.append(0, np.cumsum(size + gap)[:-1])
        codes, distinct = pd.factorize(np.array([w for f in found for w in f], dtype=object))
        value = np.array([term(w) for w in distinct], dtype=np.int64)
        rank = np.argsort(value, kind="stable")
        place = np.empty(len(rank), dtype=np.int64)
        place[rank] = np.arange(len(rank))
        codes = place[codes]
        order = np.argsort(codes, kind="stable")
        position = np.arange(len(codes)) + np.repeat(starts - (np.cumsum(size) - size), size)
        ends = np.cumsum(np.bincount(codes, minlength=len(rank)))
        return value[rank].tobytes(), ends.astype(np.int32).tobytes(), position[order].astype(np.int32).tobytes(), starts.tobytes(), gap, ids

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["terms", "ends", "postings", "starts", "gap", "ids"]
        ids: list = []
        found: list[list[str]] = []
        held = 0
        for b in batches:
            for i, t in zip(b[id_column], b[text]):
                if own := words(t):
                    ids.append(i)
                    found.append(own)
                    held += len(own)
                if held >= SEGMENT:
                    yield pd.DataFrame([build(ids, found)], columns=columns)
                    ids, found, held = [], [], 0
        if ids:
            yield pd.DataFrame([build(ids, found)], columns=columns)

    kind = dict(documents.dtypes)[id_column]
    return documents.select(id_column, text).filter(F.col(text).isNotNull()).mapInPandas(post, f"terms binary, ends binary, postings binary, starts binary, gap int, ids array<{kind}>")


class Segment:
    """One segment of an index, opened for windows of a ``reach`` of words."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes, starts: bytes, gap: int = GAP, reach: int = 0):
        self.terms, self.ends = np.frombuffer(terms, dtype=np.int64), np.frombuffer(ends, dtype=np.int32)
        self.postings, self.starts = np.frombuffer(postings, dtype=np.int32), np.frombuffer(starts, dtype=np.int64)
        #: Documents are moved further apart where a window could run from one into the next.
        self.gap, self.apart = gap, max(0, reach - gap)

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """The length of each term's list."""
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, self.ends[at] - np.where(at > 0, self.ends[at - 1], 0), 0)

    def get(self, wanted: int) -> np.ndarray | None:
        at = int(np.searchsorted(self.terms, wanted))
        if at == len(self.terms) or self.terms[at] != wanted:
            return None
        own = self.postings[self.ends[at - 1] if at else 0 : self.ends[at]].astype(np.int64)
        return own + self.apart * (np.searchsorted(self.starts, own, "right") - 1) if self.apart else own

    def document(self, positions: np.ndarray) -> np.ndarray:
        """The document of each position, which may lie in the half gap around it."""
        border = self.starts + self.apart * np.arange(len(self.starts)) - (self.gap + self.apart) // 2
        return np.searchsorted(border, positions, "right") - 1


def term_frequency(index: DataFrame, wanted: list[int]) -> dict[int, int]:
    """Occurrences of each of the terms in the corpus; one number for each."""
    terms = np.array(wanted, dtype=np.int64)

    def count(segments: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in segments:
            for t, e in zip(batch["terms"], batch["ends"]):
                total += Segment(t, e, b"", b"").count(terms)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": terms[some], "n": total[some]})

    counted = index.select("terms", "ends").mapInPandas(count, "term long, n long")
    return {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _anchors(item_words: dict, frequency: dict[int, int], number: dict[str, int], length: int) -> list[tuple]:
    """(item, term, place): of each window of ``length`` words the rarest, so that every window holds
    one. Windows with a term that no document has can't occur and need none."""
    out = []
    for item, own in item_words.items():
        ids = [number[w] for w in own]
        counts = [frequency.get(k, 0) for k in ids]
        places = set()
        for a in range(len(ids) - length + 1):
            window = counts[a : a + length]
            if min(window) == 0:
                continue
            if not any(a <= p < a + length and counts[p] <= min(window) for p in places):
                places.add(a + window.index(min(window)))
        out += [(item, ids[p], p) for p in sorted(places)]
    return out


def _probes(p: int, ids: list[int], frequency: dict[int, int], length: int) -> list[tuple[int, int]]:
    """(q, term): the rarest term of the words just before an anchor and of those just after it. A
    window around the anchor holds all of the one or all of the other group."""
    half = (length - 1) // 2
    groups = (range(max(0, p - half), p), range(p + 1, min(len(ids), p + length - half)))
    return [(q, ids[q]) for g in groups if len(g) for q in [min(g, key=lambda k: frequency.get(ids[k], 0))]]


def _holds(postings: np.ndarray | None, places: np.ndarray, slack: int) -> np.ndarray:
    """For each place whether an ascending list has it, or one at most ``slack`` off."""
    if postings is None:
        return np.zeros(len(places), dtype=bool)
    if slack:
        return np.searchsorted(postings, places - slack, "left") < np.searchsorted(postings, places + slack, "right")
    at = np.searchsorted(postings, places)
    return postings[np.minimum(at, len(postings) - 1)] == places


def _documents(lists: dict, anchor: np.ndarray, ids: np.ndarray, place: int, probes: list, length: int, slack: int) -> np.ndarray:
    """The anchor's positions in the documents in which ``length`` consecutive terms of an item stand at most ``slack`` off the
    places that a common start gives them. The anchor itself may be off its place, so that each of
    its postings stands for all starts at most ``slack`` around it."""
    starts = anchor - place
    if probes:
        near = np.zeros(len(starts), dtype=bool)
        for q, t in probes:
            near |= _holds(lists.get(t), starts + q, 2 * slack)
        starts = starts[near]
    if not len(starts):
        return starts
    if slack:
        starts = np.unique(starts[:, None] + np.arange(-slack, slack + 1))
    qs = range(max(0, place - length + 1), min(len(ids), place + length))
    met = np.stack([_holds(lists.get(int(ids[q])), starts + q, slack) for q in qs], axis=1)
    runs = np.concatenate([np.zeros((len(starts), 1), int), np.cumsum(met, axis=1)], axis=1)
    full = (runs[:, length:] - runs[:, :-length] == length).any(axis=1)
    return starts[full] + place


def look_up(index: DataFrame, items: DataFrame, length: int = 12, slack: int = 0, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``item_id`` of the indexed documents that hold ``length`` consecutive words of an
    item; items in blocks of about ``ITEMS``, each block against the whole index."""
    kinds = dict(index.dtypes)["ids"][6:-1], dict(items.dtypes)["item_id"]
    schema = f"{id_column} {kinds[0]}, item_id {kinds[1]}"
    asked = items.select("item_id", "enunciado").filter("item_id is not null and enunciado is not null").dropDuplicates()
    blocks = max(1, -(-asked.count() // ITEMS))
    found = None
    for k in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "enunciado"), F.lit(blocks)) == k).toLocalIterator()
        part = index.mapInPandas(_search(index, own, length, slack, id_column), schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()  # equal ids of several rows, and equal items


def _search(index: DataFrame, rows: Iterable, length: int, slack: int, id_column: str):
    """The function over segments that finds one block of items."""
    item_words = {(r.item_id, k): own for k, r in enumerate(rows) if len(own := words(r.enunciado)) >= length}
    number = {w: term(w) for own in item_words.values() for w in own}
    frequency = term_frequency(index, sorted(set(number.values())))
    ids = {i: np.array([number[w] for w in own]) for i, own in item_words.items()}
    # (item, its terms, anchor's place, probes), by the anchor's term
    plan: dict[int, list[tuple]] = {}
    for i, t, p in _anchors(item_words, frequency, number, length):
        plan.setdefault(t, []).append((i, ids[i], p, _probes(p, ids[i].tolist(), frequency, length)))

    def search(segments: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in segments:
            for terms_, ends, postings, starts, gap, own in zip(*[batch[c] for c in ("terms", "ends", "postings", "starts", "gap", "ids")]):
                segment = Segment(terms_, ends, postings, starts, gap, 2 * (length + 4 * slack))
                lists = Lists(segment)
                hits: set[tuple] = set()
                for t, uses in plan.items():
                    if (anchor := lists.get(t)) is not None:
                        for item, words_, place, probes in uses:
                            at = _documents(lists, anchor, words_, place, probes, length, slack)
                            hits.update((own[d], item[0]) for d in set(segment.document(at).tolist()))
                yield pd.DataFrame(sorted(hits), columns=[id_column, "item_id"])

    return search


class Lists(dict):
    """The lists of a segment, each opened once."""

    def __init__(self, segment: Segment):
        self.segment = segment

    def get(self, wanted: int) -> np.ndarray | None:  # type: ignore[override]
        if wanted not in self:
            self[wanted] = self.segment.get(wanted)
        return self[wanted]


def leaked(documents: DataFrame, items: DataFrame, length: int = 12, slack: int = 0, id_column: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``item_id``: the documents that hold ``length`` consecutive words of an item.

    With ``slack``, each of these words may stand up to so many words off its place after any common
    start (proximity); with 0 the phrase is exact. Null and empty texts and items of fewer words match
    nothing; equal texts and equal items each give their own rows; empty tables give none. ``index``: of
    these documents, if there is one already.
    """
    return look_up(materialize(positional_index(documents, id_column, text), "segments") if index is None else index, items, length, slack, id_column)
