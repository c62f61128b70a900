"""Evaluation texts leaking into training text (numbered problem 7).

Finds every document that holds at least MIN_WORDS words of a test item in their order in one stretch, letter case, spacing,
punctuation, line breaks and up to about one in five words altered or added aside.

Defined results of odd input: null, empty and blank texts leak nothing; very long texts are read whole; repeated documents are
found each; items without words are ignored, repeated item rows count once; with no items or no documents the result is empty;
other columns are not read. Sentences that several items share (stock instructions) are masked and never count.

Method: n-gram seeds join passages to items. MIN_WORDS or more words in order with at most EDITS altered or added ones for each leave
a run of at least SEED words as they are, so every run of SEED words of an item is a seed, however frequent it is, and one seed is enough.
All seeds of a batch of documents are found and extended together in numpy: a seed is kept if at least NEAR words around it stand in
the item's order too. Smith-Waterman alignment of the words around the kept ones decides, with the same limit for all. Words may be
altered or added; a missing word ends the stretch, as it does where stock phrases and templates meet an item by chance. The index of the
items' words is shipped to the tasks; it is bounded, as items are taken in slices of at most SLICE_WORDS words.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.skew import cut, spread

#: Words of an item that must be found in order, and how many altered or added words are allowed for each of them.
MIN_WORDS, EDITS = 15, 0.25
#: Words of a seed; words that must stand in order within REACH words around it, with up to SHIFT added ones.
SEED, NEAR, REACH, SHIFT = 4, 12, 18, 4
#: Words of the item and of the text on both sides of a seed in which the shortest leak around it lies.
ITEM_SIDE, TEXT_SIDE = 40, 48
#: Words of documents, and seeds, that are handled together.
BATCH_WORDS, BATCH_SEEDS, BATCH_ALIGNED = 200_000, 1_000_000, 1024
#: Words of test items per pass.
SLICE_WORDS = 1_000_000

_BROKEN = re.compile(r"[-­¬‐][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_OUTSIDE = re.compile(r"[^\w\s]+|_+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    """Words between blanks in lower case without punctuation; words hyphenated over lines are joined."""
    if not text:
        return []
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _OUTSIDE.sub("", text.lower()).split()


def distinct_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, text, masked), (key, item_id)): every different test text once, with one flag per sentence - true if another text holds it
    too - and the items of each text. Sharing is counted over all texts at once; items that repeat one text don't mask it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                digests = [_digest(words_of(s)) for s in _SENTENCE.split(text)]
                rows.append((_digest(words_of(text)), item, text, digests))
            yield pd.DataFrame(rows, columns=["key", "item_id", "text", "sentences"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = cut(items.dropna().distinct().mapInPandas(read, f"key string, item_id {kind}, text string, sentences array<string>"))
    texts = rows.groupBy("key").agg(F.min(F.struct("item_id", "text", "sentences")).alias("r")).select("key", "r.text", "r.sentences")
    places = texts.select("key", F.posexplode("sentences").alias("at", "sentence"))
    shared = places.select("key", "sentence").distinct().groupBy("sentence").agg((F.count(F.lit(1)) > 1).alias("shared"))
    flags = places.join(shared, "sentence").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "shared"))).alias("flags"))
    return texts.join(flags, "key").select("key", "text", F.transform("flags", lambda f: f["shared"]).alias("masked")), rows.select("key", "item_id")


def _digest(words: list[str]) -> str:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).hexdigest()


def unmasked_words(text: str, masked: list[bool]) -> list[str | None]:
    """The words of a test text; those of masked sentences are None."""
    return [None if hidden else w for s, hidden in zip(_SENTENCE.split(text), masked) for w in words_of(s)]


#: Score units of a match, so that one integer holds the score and, below it, the matches.
_UNIT = 1 << 20


def align(document: list[str], item: list[str | None]) -> tuple[int, int]:
    """(matched words, edits) of the best local alignment; a match counts 1, a changed, added or missing word -2."""
    codes: dict[str, int] = {}
    d = [codes.setdefault(w, len(codes)) for w in document]
    t = np.array([codes.get(w, -1) if w is not None else -2 for w in item], np.int64)
    slope = 2 * _UNIT * np.arange(len(t) + 1, dtype=np.int64)
    row = np.zeros(len(t) + 1, np.int64)
    best = 0
    for code in d:
        now = np.maximum(row - 2 * _UNIT, 0)
        np.maximum(now[1:], row[:-1] + np.where(t == code, _UNIT + 1, -2 * _UNIT), out=now[1:])
        row = np.maximum.accumulate(now + slope) - slope
        best = max(best, int(row.max()))
    score, matched = best >> 20, best & (_UNIT - 1)
    return matched, (matched - score) // 2


def align_unbroken(document: list[str], item: list[str | None]) -> tuple[int, int]:
    """(matched words, edits) of the alignment within the limits that matches most, (0, 0) if none is; no word of the item may be missing in it."""
    codes: dict[str, int] = {}
    d = [codes.setdefault(w, len(codes)) for w in document]
    t = np.array([codes.get(w, -1) if w is not None else -2 for w in item], np.int64)
    row = np.zeros(len(t) + 1, np.int64)
    found = (0, 0)
    least = int(MIN_WORDS * (1 - 2 * EDITS)) << 20
    for code in d:
        now = np.maximum(row - 2 * _UNIT, 0)
        np.maximum(now[1:], row[:-1] + np.where(t == code, _UNIT + 1, -2 * _UNIT), out=now[1:])
        row = now
        if row.max() >= least:
            matched = row & (_UNIT - 1)
            edits = (matched - (row >> 20)) // 2
            at = int(np.where(edits <= EDITS * matched, matched, 0).argmax())
            if matched[at] >= max(MIN_WORDS, found[0] + 1) and edits[at] <= EDITS * matched[at]:
                found = (int(matched[at]), int(edits[at]))
    return found


class ItemIndex:
    """The items' words as one array of numbers, with the places of every run of SEED words."""

    def __init__(self, items: dict[str, list[str | None]]):
        self.items, self.names = items, list(items)
        self.numbers = {w: k for k, w in enumerate(dict.fromkeys(w for own in items.values() for w in own if w is not None), 1)}
        pad = [0] * (TEXT_SIDE + SEED)
        flat, owner, self.start = list(pad), [-1] * len(pad), []
        for k, own in enumerate(items.values()):
            self.start.append(len(flat))
            flat += [self.numbers[w] if w is not None else 0 for w in own] + pad
            owner += [k] * len(own) + [-1] * len(pad)
        self.flat, self.owner = np.array(flat, np.int32), np.array(owner, np.int32)
        place, key = self.seeds(self.flat)
        order = np.argsort(key, kind="stable")
        self.place, self.key = place[order], key[order]

    @staticmethod
    def seeds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of SEED known words, and their keys (equal keys of different runs are told apart later)."""
        known = flat > 0
        n = max(len(flat) - SEED + 1, 0)
        whole = np.ones(n, bool)
        key = np.zeros(n, np.uint64)
        for j in range(SEED):
            whole &= known[j : j + n]
            key = (key ^ flat[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        place = np.flatnonzero(whole)
        return place, key[place]

    def leaks(self, texts: list[list[str]]) -> list[tuple[int, str, int, int]]:
        """(number of the text, item, matched words, edits) of every leak in the texts, given as words."""
        pad = [-1] * (TEXT_SIDE + SEED)
        flat, owner, start = list(pad), [-1] * len(pad), []
        for k, words in enumerate(texts):
            start.append(len(flat))
            flat += [self.numbers.get(w, -1) for w in words] + pad
            owner += [k] * len(words) + [-1] * len(pad)
        words_at, text_of = np.array(flat, np.int32), np.array(owner, np.int64)
        n_items = max(len(self.names), 1)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        place, key = self.seeds(words_at)
        low = np.searchsorted(self.key, key)
        count = np.searchsorted(self.key, key, "right") - low
        place, low, count = place[count > 0], low[count > 0], count[count > 0]
        part = np.cumsum(count) // BATCH_SEEDS
        for k in np.unique(part):
            mine = part == k
            many = count[mine]
            at = np.repeat(place[mine], many)
            i = self.place[np.repeat(low[mine], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
            run = words_at[at - 1] != self.flat[i - 1]  # the first seed of a run speaks for it
            for j in range(SEED):
                run &= words_at[at + j] == self.flat[i + j]
            at, i = at[run], i[run]
            pair = text_of[at] * n_items + self.owner[i]
            keep = np.flatnonzero(self._in_order(words_at, at, i) >= NEAR)
            sure = [self._leaks_at(words_at, at[c], i[c]) for c in np.array_split(keep, -(-len(keep) // BATCH_ALIGNED))] if len(keep) else []
            keep = keep[np.concatenate(sure)] if sure else keep
            for p, a, b in zip(pair[keep].tolist(), at[keep].tolist(), i[keep].tolist()):
                spans[p].append((a - start[p // n_items], b - self.start[p % n_items]))
        found = []
        for p, seeds in spans.items():
            leak = self._judge(texts[p // n_items], self.names[p % n_items], seeds)
            if leak:
                found.append((p // n_items, self.names[p % n_items], *leak))
        return found

    def _in_order(self, words_at: np.ndarray, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many words within REACH of each seed equal the item's word at their place, or up to SHIFT places nearer."""
        near = np.full(len(at), SEED, np.int8)
        for side in (1, -1):
            for k in range(1, REACH + 1):
                off = k + SEED - 1 if side > 0 else -k
                word = words_at[at + off]
                same = word == self.flat[i + off]
                for shift in range(1, min(SHIFT, k - 1) + 1):
                    same |= word == self.flat[i + off - side * shift]
                near += same
        return near

    def _leaks_at(self, words_at: np.ndarray, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether a leak lies around each seed: align_unbroken of all of them in step, over the words at their sides."""
        d = words_at[at[:, None] + np.arange(-TEXT_SIDE, TEXT_SIDE + SEED)]
        t = self.flat[i[:, None] + np.arange(-ITEM_SIDE, ITEM_SIDE + SEED)]
        unit, least = 1 << 12, int(MIN_WORDS * (1 - 2 * EDITS)) << 12
        row = np.zeros((len(at), t.shape[1] + 1), np.int32)
        leak = np.zeros(len(at), bool)
        for k in range(d.shape[1]):
            now = np.maximum(row - np.int32(2 * unit), 0)
            np.maximum(now[:, 1:], row[:, :-1] + np.where(t == d[:, k : k + 1], np.int32(unit + 1), np.int32(-2 * unit)), out=now[:, 1:])
            row = now
            high = np.flatnonzero((row.max(1) >= least) & ~leak)
            if len(high):
                matched = row[high] & (unit - 1)
                edits = (matched - (row[high] >> 12)) // 2
                leak[high] = ((matched >= MIN_WORDS) & (edits <= EDITS * matched)).any(1)
        return leak

    def _judge(self, words: list[str], item: str, seeds: list[tuple[int, int]]) -> tuple[int, int] | None:
        """(matched words, edits) of the leak around the seeds, each piece of the text being aligned once."""
        own = self.items[item]
        size = len(own)
        spans: list[list[int]] = []
        for a, b in sorted((max(0, a - int(1.3 * b) - 3), a + int(1.3 * (size - b)) + 4) for a, b in seeds):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in spans:
            matched, edits = align_unbroken(words[a:b], own)
            if matched:
                return matched, edits
        return None


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, edits) of every document and test item that it leaks."""
    spark = documents.sparkSession
    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0))
    texts, members = distinct_items(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")))
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, key string, matched int, edits int"
    found = spark.createDataFrame([], schema)
    for part in _slices(texts):
        found = found.unionByName(rows.mapInPandas(_finder(part), schema))
    return found.join(members, "key").select("doc_id", "item_id", "matched", "edits")


def _slices(texts: DataFrame) -> Iterator[dict[str, list[str | None]]]:
    """The words of the test texts, in slices of at most SLICE_WORDS words: one slice at a time is on the driver."""
    part: dict[str, list[str | None]] = {}
    size = 0
    for row in texts.orderBy("key").toLocalIterator():
        words = unmasked_words(row["text"], row["masked"])
        if part and size + len(words) > SLICE_WORDS:
            yield part
            part, size = {}, 0
        part[row["key"]] = words
        size += len(words)
    if part:
        yield part


def _finder(items: dict[str, list[str | None]]):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(items)
        for batch in batches:
            out: list[tuple] = []
            ids: list = []
            texts: list[list[str]] = []
            size = 0
            for d, text in zip(batch["doc_id"], batch["text"]):
                ids.append(d)
                texts.append(words_of(text))
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    out += [(ids[k], *leak) for k, *leak in index.leaks(texts)]
                    ids, texts, size = [], [], 0
            if texts:
                out += [(ids[k], *leak) for k, *leak in index.leaks(texts)]
            yield pd.DataFrame(out, columns=["doc_id", "key", "matched", "edits"])

    return find
