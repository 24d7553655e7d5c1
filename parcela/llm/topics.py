"""Subjects of each document by an anchored non-negative factorisation (problem 10).

The document-term matrix, each document cut into its sentences, is factored into subject and
background components by alternating non-negative updates (Kullback-Leibler). A component for each
subject is seeded and anchored by the hand labels: its terms start from their excess in labelled
documents and keep that prior in every update. The components hence are the subjects, and a
sentence's loadings its mixture of them: they are solved for every sentence with the final term
factor, and a document deals with the subjects that dominate enough of its sentences.

Terms are words and pairs of neighbours, each under a 64-bit hash of its own. Terms that labelled
documents show often and without excess for any subject are background from the start: a sentence
keeps their number only. Sums over the corpus are rows (term, sum by component), added up by Spark.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.storage import bounded_rows, materialize

#: Most subjects; a taxonomy beyond would need another model.
SUBJECTS = 1_000
#: Most labelled documents that seed and anchor the factors; beyond, those of the least hash are taken.
LABELLED = 200_000
#: A term counts if it occurs at least ``LEAST`` times and has this share of all occurrences, which
#: bounds the vocabulary by its inverse, whatever the corpus' size.
LEAST, LEAST_SHARE = 3, 1e-7
#: Labelled documents with a term without excess after which it is background for certain.
SURE = 5

# A line end alone is no break, as passages come wrapped; an empty line, a tag or a bullet is one.
_BREAK = re.compile(r"(?<=[.!?…。])[\"'”»)\]*_]*\s+|(?:\r?\n|\r)\s*[\r\n]|\u2029|<[^<>]{1,60}>|\s[•·|]\s")
_WORD, _TOKEN = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+|[\x00\x01]")
_MARKS = regex.compile(r"\p{M}+")
#: Characters to a chunk of texts that are cut into words at once.
_CHUNK = 4_000_000


def folded(text: str) -> str:
    """Lower case without accents, composed or not."""
    s = text.lower()
    return s if s.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", s))


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text that hold a word of two letters, each as its words."""
    if not text:
        return []
    found = (_WORD.findall(part) for part in _BREAK.split(folded(text)) if part)
    return [w for w in found if any(len(x) > 1 for x in w)]


@lru_cache(maxsize=1 << 20)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def hashed_sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes of all ``sentences`` of all texts one after the other, the size of each sentence and its text's number."""
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= _CHUNK):
            size += len(texts[b])
            b += 1
        # one search for all: \x01 ends a text, \x00 a sentence
        joined = "\x01".join(folded(t.replace("\x00", " ").replace("\x01", " ")) for t in texts[a:b])
        tokens = np.array(_TOKEN.findall("\x01" + _BREAK.sub("\x00", joined.replace("\x01", "\x00\x01"))), dtype=object)
        codes, distinct = pd.factorize(tokens)
        kind = np.array([2 if t == "\x01" else 1 if t == "\x00" else 0 for t in distinct])[codes]
        long = np.array([len(t) > 1 for t in distinct])[codes]
        value = np.array([word_hash(t) for t in distinct], dtype=np.int64)[codes]
        text, sentence = np.cumsum(kind == 2) - 1, np.cumsum(kind > 0)
        word = kind == 0
        good = np.bincount(sentence[word & long], minlength=len(tokens) + 1) > 0
        word &= good[sentence]
        own = sentence[word]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
        words.append(value[word])
        sizes.append(np.diff(np.append(begin, len(own))))
        owners.append(text[word][begin] + a)
        a = b
    empty = [np.empty(0, np.int64)]
    return np.concatenate(words or empty), np.concatenate(sizes or empty), np.concatenate(owners or empty)


@dataclass
class Bag:
    """Sentences as one row of terms after the other: words, then pairs of neighbours."""

    terms: np.ndarray  # hashes, or places in a vocabulary
    row: np.ndarray  # each term's sentence, ascending
    document: np.ndarray  # each sentence's document
    total: np.ndarray  # each sentence's number of terms, those left out too

    @staticmethod
    def of(batch: pd.DataFrame) -> Bag:
        """From columns ``words`` and ``sizes`` (numbers as bytes)."""
        words = np.frombuffer(b"".join(batch["words"]), dtype=np.int64)
        each = [np.frombuffer(s, dtype=np.int32) for s in batch["sizes"]]
        size = np.concatenate(each).astype(np.int64) if each else np.empty(0, np.int64)
        document = np.repeat(np.arange(len(batch)), [len(s) for s in each])
        row = np.repeat(np.arange(len(size)), size)
        with np.errstate(over="ignore"):
            mixed = (words[:-1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (words[:-1].view(np.uint64) >> np.uint64(29))) + words[1:].view(np.uint64) if len(words) else words.view(np.uint64)
        inside = row[1:] == row[:-1]
        terms, rows = np.concatenate([words, mixed.view(np.int64)[inside]]), np.concatenate([row, row[:-1][inside]])
        order = np.argsort(rows, kind="stable")
        return Bag(terms[order], rows[order], document, 2 * size - 1)

    def known(self, vocabulary: np.ndarray) -> Bag:
        """Only the terms of an ascending vocabulary, as their places in it."""
        if not len(vocabulary):
            return Bag(self.terms[:0], self.row[:0], self.document, self.total)
        codes, distinct = pd.factorize(self.terms)
        at = np.minimum(np.searchsorted(vocabulary, distinct), len(vocabulary) - 1)
        place = np.where(vocabulary[at] == distinct, at, -1)[codes]
        return Bag(place[place >= 0], self.row[place >= 0], self.document, self.total)

    def parts(self, size: int = 20_000) -> Iterator[Bag]:
        """The bag in pieces of so many sentences, so that intermediate matrices stay small."""
        for a in range(0, len(self.document), size):
            first, last = np.searchsorted(self.row, [a, a + size])
            yield Bag(self.terms[first:last], self.row[first:last] - a, self.document[a : a + size], self.total[a : a + size])


@dataclass
class Factors:
    """Components over a vocabulary: the first of them are the subjects, the rest background."""

    subjects: list[str]
    background: int = 4
    #: Weight of the labels' terms against the corpus, in hundredths of a subject's mass.
    prior: float = 20.0
    #: Loading that an unlabelled subject may still have in a labelled document, for passing mentions.
    stray: float = 0.05
    inner: int = 3
    seed: int = 3
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    h: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    anchor: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    #: Occurrences of the terms that are background for certain.
    plain: float = 0.0

    def start(self, terms: np.ndarray, seen: np.ndarray, together: np.ndarray, labelled: np.ndarray) -> None:
        """Seeds. ``seen``: occurrences of each term in the corpus; ``together``: labelled documents
        with the term by subject, last all; ``labelled``: all labelled documents likewise."""
        share = labelled[:-1] / max(1.0, labelled[-1])
        with_term = together[:, -1]
        p = (together[:, :-1] + 2 * share) / (with_term[:, None] + 2)
        excess = np.clip((p - share - 0.15) / np.maximum(1e-9, 0.85 - share), 0, None)
        excess[with_term < 2] = 0
        kept = (excess.max(axis=1, initial=0) > 0) | (with_term < SURE)
        order = np.flatnonzero(kept)[np.argsort(terms[kept], kind="stable")]
        self.plain = float(seen.sum() - seen[order].sum())
        self.vocabulary, seen, excess, with_term = terms[order], seen[order], excess[order], with_term[order]
        anchor = (excess**2 * seen[:, None]).T
        total = anchor.sum(axis=1, keepdims=True)
        self.anchor = (anchor / np.where(total > 0, total, 1)).astype(np.float32)
        base = seen / max(1.0, seen.sum() + self.plain)
        noise = np.random.default_rng(self.seed).uniform(0.5, 1.5, (self.background, len(seen)))
        # what the labels tie to a subject starts outside of the background; what they never show starts everywhere, thinly
        tied = np.clip(1 - 1.2 * excess.max(axis=1, initial=0), 0.02, 1)
        unknown = (with_term < 2).astype(float)
        self._scale(np.concatenate([0.98 * self.anchor + 0.02 * base * unknown, base * tied * noise]), self.plain / max(1.0, seen.sum() + self.plain))

    def _scale(self, h: np.ndarray, plain: float) -> None:
        """Make components sum to one, with the terms that are background for certain, which ``h`` lacks, in even shares."""
        whole = h.sum(axis=1, keepdims=True)
        whole[len(self.subjects) :] += plain / self.background
        self.h = (h / np.maximum(whole, 1e-12)).astype(np.float32)

    def load(self, bag: Bag, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sentences that have terms of the vocabulary, their loadings (in terms), and each term's
        share by component. ``allowed``: the weight of each component by document."""
        some, begin = np.unique(bag.row, return_index=True)
        width, k = self.h.shape[0], len(self.subjects)
        if not len(some):
            return some, np.empty((0, width), np.float32), np.empty((0, width), np.float32)
        own = np.diff(np.append(begin, len(bag.row)))
        rows = np.repeat(np.arange(len(some)), own)
        plain = (bag.total[some] - own).astype(np.float32)
        like = self.h[:, bag.terms].T + np.float32(1e-9)
        bound = np.ones((len(some), width), np.float32) if allowed is None else allowed[bag.document[some]].astype(np.float32)
        w = bound.copy()
        for _ in range(self.inner):
            p = like * (w + np.float32(0.02))[rows]
            p /= p.sum(axis=1, keepdims=True)
            w = np.add.reduceat(p, begin, axis=0) * bound
            w[:, k:] += plain[:, None] / self.background
            w /= w.sum(axis=1, keepdims=True) + np.float32(1e-9)
        p = like * w[rows]
        p /= p.sum(axis=1, keepdims=True) + np.float32(1e-12)
        return some, np.add.reduceat(p, begin, axis=0), p

    def counts(self, bag: Bag, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a batch adds to the term factor: the places of its terms, and a row of sums for each."""
        out = np.zeros((len(self.vocabulary), self.h.shape[0]))
        for part in bag.parts():
            _, _, p = self.load(part, allowed)
            for z in range(out.shape[1]):
                out[:, z] += np.bincount(part.terms, weights=p[:, z], minlength=len(out))
        some = np.flatnonzero(out.any(axis=1))
        return some, out[some]

    def update(self, total: np.ndarray) -> None:
        """The alternating update of the term factor from the sums over all documents."""
        k = len(self.subjects)
        h = total.T.astype(np.float64)
        h[:k] += self.prior * np.maximum(1.0, h[:k].sum(axis=1, keepdims=True)) / 100 * self.anchor
        self._scale(h, self.plain)

    def sentence_subjects(self, bag: Bag, least: float = 0.5, share: float = 0.5, density: float = 0.03) -> np.ndarray:
        """The subject of each sentence, -1 for none: the largest in its loadings, if that has at least
        ``least`` terms, ``share`` of what all subjects have and ``density`` of all terms."""
        out, at, k = np.full(len(bag.document), -1), 0, len(self.subjects)
        tied = self.anchor.sum(axis=1) > 0  # nothing ties a subject without labels
        for part in bag.parts():
            some, mass, _ = self.load(part)
            own = mass[:, :k] * tied
            best = own.argmax(axis=1) if len(own) else np.empty(0, int)
            top = own[np.arange(len(own)), best]
            good = (top >= np.maximum(least, density * part.total[some])) & (top >= share * own.sum(axis=1))
            out[at + some[good]] = best[good]
            at += len(part.document)
        return out


# --- over a corpus -----------------------------------------------------------------------------


def _term_lists(documents: DataFrame, labels: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, ``words`` and ``sizes`` of the sentences, ``marks`` (the subjects' numbers of a labelled document, else null); written once.

    The labels are a bounded table, so that no text is shuffled.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, sizes, owner = hashed_sentences(list(b[text]))
            first = np.searchsorted(owner, np.arange(len(b) + 1))
            edge = np.append(0, np.cumsum(sizes))
            own = [(words[edge[x] : edge[y]].tobytes(), sizes[x:y].astype(np.int32).tobytes()) for x, y in zip(first, first[1:])]
            yield pd.DataFrame({id_column: b[id_column], "words": pd.Series([w for w, _ in own], dtype=object, index=b.index), "sizes": pd.Series([s for _, s in own], dtype=object, index=b.index), "marks": b["marks"]})

    kind = dict(documents.dtypes)[id_column]
    marked = documents.select(id_column, text).filter(F.col(text).isNotNull()).join(F.broadcast(labels), id_column, "left")
    return materialize(marked.mapInPandas(encode, f"{id_column} {kind}, words binary, sizes binary, marks array<int>"), "term-lists")


def _rows(terms: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"term": terms.astype(np.int64)} | {f"s{z}": sums[:, z] for z in range(sums.shape[1])})


def _added(rows: DataFrame, width: int) -> DataFrame:
    """The sums of each term: partial sums in each task first."""
    return rows.groupBy("term").agg(*[F.sum(f"s{z}").alias(f"s{z}") for z in range(width)])


def _schema(width: int) -> str:
    return "term long, " + ", ".join(f"s{z} double" for z in range(width))


def fit(listed: DataFrame, subjects: list[str], rounds: int = 3, **options) -> Factors:
    """Seed the factors by the labels and alternate ``rounds`` times over all documents."""
    factors = Factors(subjects, **options)
    k, width = len(subjects), len(subjects) + factors.background

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bag = Bag.of(b)
            codes, distinct = pd.factorize(bag.terms)
            sums = np.zeros((len(distinct), k + 2))
            sums[:, k + 1] = np.bincount(codes, minlength=len(distinct))
            document = bag.document[bag.row] if len(bag.row) else bag.row
            marked = np.array([m is not None for m in b["marks"]], dtype=bool)
            held = marked[document]
            pairs = np.unique(document[held].astype(np.int64) * max(1, len(distinct)) + codes[held])
            for d, term in ((d, pairs[pairs // len(distinct) == d] % len(distinct)) for d in np.flatnonzero(marked)) if len(distinct) else ():
                sums[np.ix_(term, [*b["marks"].iloc[d], k])] += 1
            yield _rows(distinct, sums)

    marks = F.explode(F.array_append("marks", F.lit(k))).alias("m")  # the last stands for all
    labelled = np.zeros(k + 1)
    for r in listed.filter("marks is not null").select(marks).groupBy("m").count().collect():  # one row a subject
        labelled[r.m] = r["count"]
    found = materialize(_added(listed.mapInPandas(evidence, _schema(k + 2)), k + 2), "evidence")
    occurrences = found.agg(F.sum(f"s{k + 1}")).first()[0] or 0.0
    frequent = found.filter(F.col(f"s{k + 1}") >= max(LEAST, LEAST_SHARE * occurrences)).toPandas()  # at most 1 / LEAST_SHARE terms
    sums = frequent[[f"s{z}" for z in range(k + 2)]].to_numpy(float)
    factors.start(frequent["term"].to_numpy(np.int64), sums[:, k + 1], sums[:, : k + 1], labelled)
    for _ in range(rounds):
        now = factors

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                allowed = np.ones((len(b), width), np.float32)
                for d, own in enumerate(b["marks"]):
                    if own is not None:
                        allowed[d, :k] = now.stray
                        allowed[d, list(own)] = 1
                yield _rows(*now.counts(Bag.of(b).known(now.vocabulary), allowed))

        added = _added(listed.mapInPandas(count, _schema(width)), width).toPandas()  # one row a term of the vocabulary
        total = np.zeros((len(factors.vocabulary), width))
        total[added["term"].to_numpy(np.int64)] = added[[f"s{z}" for z in range(width)]].to_numpy(float)
        factors.update(total)
    return factors


def labels_table(labels: DataFrame, subjects: list[str], id_column: str = "doc_id", limit: int = LABELLED) -> DataFrame:
    """id and ``marks`` of the labelled documents, each label once; at most ``limit`` documents."""
    number = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("materia")).cast("int") - 1
    marks = labels.filter(F.col(id_column).isNotNull() & F.col("materia").isin(subjects)).groupBy(id_column).agg(F.sort_array(F.collect_set(number)).alias("marks"))
    return marks.orderBy(F.xxhash64(id_column), id_column).limit(limit)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least: int = 3, rounds: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``materia``, ``oraciones``: the subjects to which a document gives at least ``least`` sentences.

    A sentence counts for the subject that dominates its loadings, if any; repeated sentences count
    each time. Null, empty and wordless texts have no subject. Labels may repeat, name documents
    that don't exist or unknown subjects (ignored). Without subjects the result is empty; without
    labels nothing ties components to subjects, and the result is empty too.
    """
    names = [r.materia for r in bounded_rows(subjects.select("materia").filter("materia is not null").distinct().orderBy("materia"), SUBJECTS, "subjects")]
    kind = dict(documents.dtypes)[id_column]
    schema = f"{id_column} {kind}, materia string, oraciones int"
    if not names:
        return documents.sparkSession.createDataFrame([], schema)
    listed = _term_lists(documents, labels_table(labels, names, id_column), id_column, text)
    factors = fit(listed, names, rounds)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bag = Bag.of(b).known(factors.vocabulary)
            best = factors.sentence_subjects(bag)
            counts = np.zeros((len(b), len(names)), dtype=np.int32)
            np.add.at(counts, (bag.document[best >= 0], best[best >= 0]), 1)
            d, z = np.nonzero(counts >= least)
            yield pd.DataFrame({id_column: b[id_column].to_numpy()[d], "materia": pd.Series([names[i] for i in z], dtype=object), "oraciones": counts[d, z]})

    return listed.select(id_column, "words", "sizes").mapInPandas(assign, schema)
