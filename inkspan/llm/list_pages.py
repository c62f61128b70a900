"""Keyword-stuffed and link-list pages (numbered problem 9).

For every page the share of its characters that belong to repeated keywords, tags, links, menus or product entries
rather than to sentences. A page whose share is above one half is a list page.

Defined results of odd input: null, empty and blank texts have share 0; very long texts are read whole, in time linear in their
length; repeated rows are judged each by itself; other columns are not read.

Method: the page's suffix automaton over its tokens (words, numbers as one class, marks, line ends) with the number of places of every
substring that is met twice; at pairs of tokens met once it begins anew. Dense are substrings of at most SHORT words running that occur in at least DENSE of the page's words; what they cover are keywords,
tags, separators. A longer repeat is a repeated sentence: it counts as keywords only where a short part of it is met TIMES as often as itself.
Clause structure is what dense substrings leave over: CLAUSE or more words in a row. A unit (sentence or line) is list text if repeats of any
length cover enough of it and clauses make little of it. No word lists, no shapes of links or hosts, in any language. Each page is one narrow step in a map
over Arrow batches: no shuffle.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.skew import spread

#: A substring is dense from so many places on, and from this share of the page's words.
DENSE_LEAST, DENSE = 4, 0.02
#: Most words running of a keyword; times a part must be met as often as the repeat it stands in; fewest characters of a repeat.
SHORT, TIMES, MIN_REPEAT = 3, 2, 4
#: Fewest words in a row that make a clause; a unit is list text below this share of clauses and from this share of repeats on.
CLAUSE, CLAUSE_SHARE, COVERED = 4, 0.3, 0.25
#: A line with fewer characters than this wasn't wrapped: its end is the end of a unit.
WRAPPED = 40
#: Longest dense substring in tokens whose parts are looked at one by one.
PARTS = 16

#: Words; of scripts without blanks, where a text has any, every character is a word.
_REST = r"|\d+|[.!?…]+(?=[\s\"”»')\]]|$)|[^\w\s]|_|\n"
#: The first pattern is only a quicker way to words of frequent letters.
_TOKEN = re.compile(r"[a-zß-öø-ÿа-яё]++(?![^\W\d_])|[^\W\d_]+" + _REST)
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")
_TOKEN_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|[^\W\d_぀-ヿ㐀-鿿豈-﫿฀-๿]+" + _REST)
_ENDS = frozenset(".!?…")
_INSIDE = frozenset("-'’‐")


class Repeats:
    """The suffix automaton of a list of tokens, built online, with the number of places of each state's strings.

    Between two tokens that follow each other only here it begins anew: no string that is met twice lies across.
    """

    def __init__(self, tokens: list[str]):
        length, link, step, places = [0], [-1], [{}], [0]
        root = step[0]
        self.at: list[int] = []
        add = self.at.append
        pairs = list(zip(tokens, tokens[1:]))
        met = Counter(pairs)
        last = 0
        for token, follows in zip(tokens, [1, *map(met.__getitem__, pairs)]):
            p = last
            if follows == 1:
                p = 0
                q = root.get(token, 0)
                if q and length[q] == 1:
                    places[q] += 1
                    add(q)
                    last = q
                    continue
            longer = length[p] + 1
            q = step[p].get(token, 0)
            if not q:
                last = len(length)
                length.append(longer)
                link.append(0)
                step.append({})
                places.append(1)
                while p >= 0:
                    way = step[p]
                    if token in way:
                        q = way[token]
                        longer = length[p] + 1
                        break
                    way[token] = last
                    p = link[p]
                if q and longer == length[q]:
                    link[last] = q
            elif longer == length[q]:
                last = q
                places[q] += 1
            else:
                last = 0
            if q and longer != length[q]:
                copy = len(length)
                length.append(longer)
                link.append(link[q])
                step.append(step[q].copy())
                places.append(0)
                link[q] = copy
                if last:
                    link[last] = copy
                else:
                    last = copy
                    places[copy] = 1
                while p >= 0 and step[p].get(token) == q:
                    step[p][token] = copy
                    p = link[p]
            add(last)
        self.by_length = sorted(range(1, len(length)), key=length.__getitem__)
        for s in reversed(self.by_length):
            places[link[s]] += places[s]
        self.length, self.link, self.places = length, link, places

    def ends(self) -> list[int]:
        """For each position, the length of the longest string ending there that occurs at another place too."""
        length, link, places = self.length, self.link, self.places
        return [length[s] if places[s] > 1 else length[link[s]] for s in self.at]

    def dense_ends(self, least: float, free_tokens: Callable[[], list[int]]) -> list[int]:
        """For each position, the length of the dense string ending there that counts as keywords, or 0.

        free_tokens: tells how many tokens back from each position no run of more than SHORT different words lies; it is SHORT at least,
        and only asked where a dense string is longer than that.
        """
        length, link, places = self.length, self.link, self.places
        dense, brief = [0] * len(length), [0] * len(length)
        for s in self.by_length:
            up = link[s]
            dense[s] = s if places[s] >= least else dense[up]
            brief[s] = s if length[s] <= PARTS else brief[up]
        longest = max((length[s] for s in set(dense)), default=0)
        free = free_tokens() if longest > SHORT else [SHORT] * len(self.at)
        back = [0] * len(self.at)
        longer, more = 0, 0  # the dense string of the next position and its places
        for i in range(len(self.at) - 1, -1, -1):
            s = dense[self.at[i]]
            n = places[s] if s else 0
            goes_on = longer > length[s] and more == n
            longer, more = length[s], n
            if not s:
                continue
            if goes_on or length[s] > free[i]:
                s = brief[s]
                while s and length[s] > free[i]:
                    n, s = places[s], link[s]
                while s and places[s] < TIMES * n:
                    s = link[s]
            back[i] = length[s]
        return back


def _covered(back: list[int], begins: list[int]) -> list[bool]:
    """Which positions the strings that end at the positions with these lengths cover, those of fewer than MIN_REPEAT characters aside."""
    covered = []
    first = len(back)
    for i in range(len(back) - 1, -1, -1):
        start = i - back[i] + 1
        if start < first and begins[i + 1] - begins[start] >= MIN_REPEAT:
            first = start
        covered.append(first <= i)
    covered.reverse()
    return covered


def _free(tokens: list[str], word: list[bool]) -> list[int]:
    """For each position, how many tokens back from it no run of more than SHORT different words begins."""
    free = []
    at: list[int] = []  # places of the words
    seen: dict[str, int] = {}  # the last one of each word, by its number
    base = 0  # number of the first word from which on all that run are different
    last = -1  # where the last run of more than SHORT different words begins
    for i, t in enumerate(tokens):
        if word[i]:
            k = len(at)
            before = seen.get(t, -1)
            if before >= base:
                base = before + 1
            seen[t] = k
            at.append(i)
            if k - base >= SHORT:
                last = at[k - SHORT]
        elif t not in _INSIDE:
            base = len(at)
        free.append(i - last)
    return free


def list_share(text: str | None) -> tuple[float, float]:
    """(share of characters in list text, share of characters that repeats cover), blanks not counted."""
    tokens = (_TOKEN_UNSPACED if _UNSPACED.search(text) else _TOKEN).findall(text.lower()) if text else []
    n = len(tokens)
    sizes = [0 if t == "\n" else len(t) for t in tokens]
    begins = list(accumulate(sizes, initial=0))
    if not begins[n]:
        return 0.0, 0.0
    word = list(map(str.isalpha, tokens))
    repeats = Repeats(["#" if t.isdigit() else t for t in tokens])
    keyword = _covered(repeats.dense_ends(max(DENSE_LEAST, DENSE * sum(word)), lambda: _free(tokens, word)), begins)
    repeated = _covered(repeats.ends(), begins)
    listed = again = words = size = letters = clauses = 0
    unit = line = after = 0  # where the unit and the line begin, and the words that may belong to a clause
    tokens.append("\n")
    for i in [*(i for i in range(n) if keyword[i] or not word[i]), n]:
        words += i - after
        size += begins[i] - begins[after]
        after = i + 1
        t = tokens[i]
        if t in _INSIDE:
            continue
        closing = t[0] in _ENDS
        if t == "\n":
            closing = i == n or begins[i] - begins[line] + after - line < WRAPPED or (after < n and tokens[after] == "\n")
            line = after
            if not closing:
                continue
        if words >= CLAUSE:
            clauses += size
        letters += size
        if i < n and word[i]:
            letters += sizes[i]
        words = size = 0
        if closing:
            end = min(after, n)
            total, here = begins[end] - begins[unit], sum(compress(sizes[unit:end], repeated[unit:end]))
            if clauses < CLAUSE_SHARE * letters or (not letters and total):
                listed += total if here >= COVERED * total else 0
            again += here
            unit, clauses, letters = end, 0, 0
    return listed / begins[n], again / begins[n]


def list_shares(pages: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, list_share, repeat_share) of every page."""
    kind = pages.schema[id_column].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # automata are many small objects without cycles: looking for cycles takes a sixth of the time
        try:
            for batch in batches:
                shares = [list_share(text) for text in batch["text"]]
                yield pd.DataFrame({"id": batch["id"], "list_share": [s[0] for s in shares], "repeat_share": [s[1] for s in shares]})
        finally:
            gc.enable()

    rows = pages.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return spread(rows).mapInPandas(judge, f"id {kind}, list_share double, repeat_share double")


def list_pages(pages: DataFrame, id_column: str = "doc_id", text_column: str = "text", above: float = 0.5) -> DataFrame:
    """(id, list_share, repeat_share) of the pages of which more than that share is list text."""
    return list_shares(pages, id_column, text_column).filter(F.col("list_share") > above)
