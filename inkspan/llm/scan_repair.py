"""Noise in text from scanned pages (numbered problem 1).

Names the damaged lines of every page - running heads, page numbers, words broken over lines, misread words - and gives the page's text as
repaired continuous paragraphs.

Defined results of odd input: null, empty and figure-only texts have no words and give no defects (page numbers aside) and no
paragraphs; very long pages are read whole; pages read twice are judged each by itself; other columns are not read.

Method: word counts over all pages make a lexicon; its LEXICON most frequent words are shipped to the tasks (a bounded model, counted
over all data). Lines that stand at the edges of several pages of one document are running heads; others are known by their shape. Without these the page is one
stream of characters. Its words are decoded jointly by a Viterbi pass over the places of that stream: an edge is one word, read as it stands or with
confusions undone, over any number of characters - one piece between blanks, up to MERGED pieces merged over blanks, line ends or hyphens, or a part of a piece
that holds several words. A word costs its probability and every repair that its reading takes; a word part may also be left
hanging before its hyphen. The defects are read off the best path. Paragraph boundaries are chosen by dynamic programming over the lines.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.page_lines import edge_lines
from inkspan.llm.word_readings import Readings, skeleton
from inkspan.skew import cut, split_join, spread

#: Most frequent words that are shipped to the tasks.
LEXICON = 200_000
#: Log probability of a blank inside a word, of a word that goes on over a line end with and without a hyphen, of a lost blank, of a compound
#: broken at its own hyphen, and of a part left hanging, before other words and before those of HANGING_BEFORE.
REPAIR = {" ": -9.0, "-": -1.0, "\n": -10.0, "split": -6.0, "compound": -3.0, "hang": -6.0, "hang before and": 6.0}
#: Log probability, in relation to any word, of a part at the end of a page whose word goes on on the next.
LONE_PART = -4.0
#: Most pieces that one word may have been torn into, and fewest letters of an unknown piece that may hold several words.
MERGED, SPLIT_LETTERS = 4, 5
#: Lines at the edge of a page that may be running heads; pages of a document that have to share one, and what share of its pages.
EDGE, SHARED_PAGES, SHARED = 3, 3, 0.25
#: Words after a hyphen that leave a word part hanging on purpose ("pre- and post-war").
HANGING_BEFORE = frozenset("and or und oder bis et ou y e o i en of и или".split())

_TOKEN = re.compile(r"(?:[^\W_]|[†|$])+")
_LETTER = re.compile(r"[^\W\d_]")
_HYPHEN_END = re.compile(r"(?<=[^\W_])([-‐¬­])[ \t\r]*$")
_BROKEN = re.compile(r"[^\W_]+[-‐¬\xad][ \t\r]*\n\s*(?:[^\W_]|[†|$])+")
_HANGING = re.compile(r"(?<![^\W_])[^\W\d_]+- (?=\S)")


def count_words(lines: list[str], counts: Counter) -> None:
    """Adds the whole words of a page's body lines, and parts left hanging within a line as `part-`."""
    heads = edge_lines(lines)
    body = "\n".join(line for i, line in enumerate(lines) if i not in heads)
    body = _BROKEN.sub(" ", body).lower()
    counts.update(_TOKEN.findall(body))
    if "- " in body:
        counts.update(_HANGING.findall(body))


def lexicon_of(pages: DataFrame, size: int = LEXICON) -> dict[str, int]:
    """The most frequent words of all pages with their counts; counted per partition, then combined."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                count_words(text.split("\n"), counts)
            if len(counts) > 500_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = Counter()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    words = spread(pages.select("text").filter(F.col("text").isNotNull())).mapInPandas(count, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    return {r["word"]: r["n"] for r in words.orderBy(F.desc("n"), "word").limit(size).collect()}


class Stream:
    """The words of a page's body lines as one stream: pieces, what stands between them, and the best decoding."""

    def __init__(self, lines: list[str], body: list[int], reader: Readings):
        self.reader = reader
        #: (piece, line, start, end)
        self.pieces = [(m.group(), i, m.start(), m.end()) for i in body for m in _TOKEN.finditer(lines[i])]
        known = [reader.piece(p[0]) for p in self.pieces]
        self.low = [k[0] for k in known]
        self.letters = [k[1] for k in known]
        self.bones = [k[2] for k in known]
        self.judged = [k[3] for k in known]
        #: What lies behind each piece: ' ' or '\n' that a word may be torn by, '-' for a hyphen at a line end, '' for anything else.
        self.gaps = [self._gap(lines, k) for k in range(len(self.pieces))]

    def _gap(self, lines: list[str], k: int) -> str:
        _, line, _, end = self.pieces[k]
        if not self.letters[k]:
            return ""
        last = k + 1 == len(self.pieces)
        if not last and self.pieces[k + 1][1] == line:
            return " " if self.letters[k + 1] and lines[line][end : self.pieces[k + 1][2]] == " " else ""
        if _HYPHEN_END.search(lines[line]):
            return "-"
        plain = not last and self.letters[k + 1] and not lines[line][end:].strip() and self.pieces[k + 1][1] == line + 1 and not lines[line + 1][: self.pieces[k + 1][2]].strip()
        return "\n" if plain else ""

    def decode(self) -> tuple[set[tuple[int, str]], dict[int, str], set[int]]:
        """((line, defect), piece -> what it reads as, '' where it went into one before, pieces broken by a hyphen at their line's end)."""
        pieces, low, gaps, reader = self.pieces, self.low, self.gaps, self.reader
        n = len(pieces)
        at = [0]
        for w in low:
            at.append(at[-1] + len(w))
        bones, judged = self.bones, self.judged
        #: place in the stream -> (value, place before, reading, misread lines, lines that end inside the word)
        best: dict[int, tuple[float, int, str, tuple[int, ...], tuple[int, ...]]] = {0: (0.0, 0, "", (), ())}
        parts: dict[int, list[tuple[int, float, str, tuple[int, ...], tuple[int, ...]]]] = {}
        for k in range(n):
            if self.letters[k] and judged[k][2] < 0 and len(low[k]) >= SPLIT_LETTERS and low[k] not in reader.lexicon:
                self._open(k, at, parts)

        def offer(value: float, place: int, to: int, gain: float, reading: str, misread: tuple[int, ...], broken: tuple[int, ...]) -> None:
            if to not in best or value + gain > best[to][0]:
                best[to] = (value + gain, place, reading, misread, broken)

        for k in range(n):
            if at[k] in best:
                value = best[at[k]][0]
                word, line = pieces[k][:2]
                gain, reading, wrong = judged[k]
                misread = () if wrong < 0 else (line,)
                if gaps[k] != "-":
                    offer(value, at[k], at[k + 1], gain, word if wrong < 0 else reading, misread, ())
                elif k + 1 < n:
                    hanging = reader.score(low[k] + "- ") + REPAIR["hang before and" if low[k + 1] in HANGING_BEFORE else "hang"]
                    offer(value, at[k], at[k + 1], hanging, word, misread, ())
                else:
                    if low[k] + "- " in reader.lexicon:
                        offer(value, at[k], at[k + 1], reader.score(low[k] + "- "), word, (), ())
                    offer(value, at[k], at[k + 1], LONE_PART - reader.total, word, (), (line,))
                joined, bone, cost = word, bones[k], 0.0
                misread, broken = (), ()
                for j in range(k + 1, min(n, k + MERGED)):
                    gap = gaps[j - 1]
                    if not gap:
                        break
                    joined, bone, cost = joined + pieces[j][0], bone + bones[j], cost + REPAIR[gap]
                    if gap == " ":
                        misread += (pieces[j - 1][1],)
                    else:
                        broken += (pieces[j - 1][1],)
                    known = bone in reader.by_skeleton
                    if known or (gap == "-" and j == k + 1):
                        gain, reading, wrong = reader.judge(joined)
                        if known and reading in reader.lexicon or gap == "-":
                            offer(value, at[k], at[j + 1], gain + cost, joined if wrong < 0 else reading, misread + self._lines(k, j, wrong), broken)
                    if gap == "-" and j == k + 1 and low[k] in reader.lexicon and low[j] in reader.lexicon and joined.lower() not in reader.lexicon:
                        offer(value, at[k], at[j + 1], reader.score(low[k]) + reader.score(low[j]) + cost + REPAIR["compound"], f"{word}-{pieces[j][0]}", (), broken)
            if parts:
                for place in range(at[k], at[k + 1]):
                    for to, gain, reading, misread, broken in parts.get(place, ()):
                        if place in best:
                            offer(best[place][0], place, to, gain, reading, misread, broken)
        return self._trace(best, at)

    def _lines(self, k: int, j: int, wrong: int) -> tuple[int, ...]:
        """The line of the first repaired character of the pieces k to j."""
        if wrong < 0:
            return ()
        for piece in range(k, j + 1):
            wrong -= len(self.low[piece])
            if wrong < 0:
                return (self.pieces[piece][1],)
        return (self.pieces[j][1],)

    def _open(self, k: int, at: list[int], parts: dict) -> None:
        """Edges for the words that lie inside an unknown piece, or reach from it into the pieces beside it."""
        low, gaps, reader = self.low, self.gaps, self.reader
        first = k - 1 if k and gaps[k - 1] == " " else k
        last = k + 1 if gaps[k] == " " else k
        text = "".join(low[first : last + 1])
        begin, inner = at[first], range(at[k] + 1, at[k + 1])
        ends = [*inner, *(at[j + 1] for j in range(k, last + 1))]
        for x in [*(at[j] for j in range(first, k + 1)), *inner]:
            for y in ends:
                if 2 <= y - x <= reader.longest and (x in inner or y in inner) and text[x - begin : y - begin] in reader.lexicon:
                    torn = [j for j in range(first, last) if x < at[j + 1] < y]
                    gain = reader.score(text[x - begin : y - begin]) + REPAIR[" "] * len(torn) + REPAIR["split"] * (y in inner)
                    parts.setdefault(x, []).append((y, gain, text[x - begin : y - begin], tuple(self.pieces[j][1] for j in torn), ()))

    def _trace(self, best: dict, at: list[int]) -> tuple[set[tuple[int, str]], dict[int, str], set[int]]:
        defects: set[tuple[int, str]] = set()
        repaired = dict.fromkeys(range(len(self.pieces)), "")
        joins: set[int] = set()
        piece_at = {place: k for k, place in enumerate(at)}
        last_of = {p[1]: k for k, p in enumerate(self.pieces)}
        place, inside = at[-1], []
        while place > 0:
            _, before, reading, misread, broken = best[place]
            for line in misread:
                defects.add((line, "misread"))
            for line in broken:
                defects.add((line, "hyphen"))
                joins.add(last_of[line])
            piece = piece_at.get(before)
            if piece is None:
                inside.append(reading)
            elif inside:
                repaired[piece] = " ".join([reading, *reversed(inside)])
                inside = []
            else:
                repaired[piece] = reading
            place = before
        return defects, repaired, joins


def read_page(text: str | None, reader: Readings, repair: bool = True, running: frozenset[int] = frozenset()) -> tuple[list[tuple[int, str]], list[str]]:
    """([(line number from 1, defect)], [paragraph]) of a page; running: indexes of lines that other pages of the document share."""
    if not text:
        return [], []
    lines = text.split("\n")
    heads = dict.fromkeys(sorted(running), "header") | edge_lines(lines)
    body = [i for i, line in enumerate(lines) if i not in heads and line.strip()]
    stream = Stream(lines, body, reader)
    defects, repaired, joins = stream.decode()
    found = [(i + 1, kind) for i, kind in sorted(defects | set(heads.items()))]
    return found, paragraphs(lines, body, stream.pieces, repaired, joins) if repair else []


def paragraphs(lines: list[str], body: list[int], pieces: list[tuple[str, int, int, int]], repaired: dict[int, str], joins: set[int]) -> list[str]:
    """The body lines with repaired words, joined into paragraphs whose boundaries cost least."""
    if not pieces:
        return []
    by_line: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        by_line.setdefault(piece[1], []).append(k)
    texts: dict[int, str] = {}
    for i in body:
        out, at = [], 0
        for k in by_line.get(i, []):
            word, _, start, end = pieces[k]
            gap = lines[i][at:start]
            new = repaired.get(k, word)
            if word[:1].isupper() and new[:1].islower():
                new = new[:1].upper() + new[1:]
            out.append(gap if new else gap.strip(" "))
            out.append(new)
            at = end
        tail = lines[i][at:].rstrip()
        if by_line.get(i) and by_line[i][-1] in joins:
            tail = re.sub(r"^[-‐¬­]", "", tail)
        texts[i] = "".join(out) + tail
    width = max(len(lines[i].rstrip()) for i in body)
    # per line, the cheapest way in which it begins a paragraph or goes on; a paragraph of one line costs extra
    begin, go = [0.0], [math.inf]
    back: list[tuple[bool, bool]] = [(True, True)]
    for a, b in zip(body, body[1:]):
        end = lines[a].rstrip()
        gap = b - a > 1
        fits = len(end) + 1 + len(lines[b].split(None, 1)[0]) <= width - 2
        broken = _HYPHEN_END.search(lines[a]) is not None
        opening = 2.0 - 3.0 * gap + 6.0 * broken + 2.5 * (end[-1:] not in ".!?”\"»") + 2.5 * lines[b].lstrip()[:1].islower()
        going = 6.0 * gap + 4.0 * fits
        single = begin[-1] + 0.5 < go[-1]
        back.append((single, begin[-1] <= go[-1]))
        opened, gone = min(begin[-1] + 0.5, go[-1]) + opening, min(begin[-1], go[-1]) + going
        begin.append(opened)
        go.append(gone)
    begins, here = set(), begin[-1] + 0.5 < go[-1]
    for j in range(len(body) - 1, -1, -1):
        if here:
            begins.add(j)
        here = back[j][0] if here else back[j][1]
    result: list[str] = []
    glue = " "
    for j, i in enumerate(body):
        text = texts[i].strip() if glue else texts[i].rstrip()
        if j in begins or not result:
            result.append(text)
        else:
            result[-1] = f"{result[-1]}{glue}{text}" if text else result[-1]
        last = by_line.get(i)
        glue = "" if last and last[-1] in joins else " "
    return [p for p in result if p]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def running_lines(pages: DataFrame, page_id: str = "page_id", text: str = "text", document_id: str = "document_id", page_number: str = "page_number") -> DataFrame:
    """(page_id, running: array of line indexes): lines at the edges of pages that several pages of the document share, misreadings and numbers aside, where their shape doesn't tell."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, document, number, text in zip(batch["page_id"], batch["document_id"], batch["page_number"], batch["text"]):
                lines = text.split("\n")
                filled = [i for i, line in enumerate(lines) if line.strip()]
                shaped = edge_lines(lines)
                for i in sorted({*filled[:EDGE], *filled[-EDGE:]}):
                    key = skeleton(re.sub(r"[\W_]+", "", re.sub(r"\d+", "#", lines[i].lower())))
                    if key:
                        rows.append((page, _digest(document), number, i, _digest(f"{document}\n{key}"), i in shaped))
            yield pd.DataFrame(rows, columns=["page_id", "document", "page_number", "line", "key", "shaped"])

    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(document_id).cast("string").alias("document_id"), F.col(page_number).cast("int").alias("page_number"), F.col(text).alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("page_id").isNotNull() & F.col("document_id").isNotNull() & F.col("page_number").isNotNull())
    at_edges = cut(spread(rows).mapInPandas(edges, f"page_id {kind}, document binary, page_number int, line int, key binary, shaped boolean"))
    # keys hold their document
    per_page = at_edges.groupBy("key", "page_number").agg(F.first("document").alias("document"), F.count(F.lit(1)).alias("n"))
    shared = per_page.groupBy("key").agg(F.first("document").alias("document"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n")).filter(F.col("pages") >= SHARED_PAGES)
    sizes = at_edges.select("document", "page_number").distinct().groupBy("document").agg(F.count(F.lit(1)).alias("all"))
    shared = cut(shared.join(sizes, "document").filter(F.col("pages") >= SHARED * F.col("all")).select("key", "n"))
    unshaped = at_edges.filter("NOT shaped").select("page_id", "line", "key")
    marked = split_join(unshaped, shared, ["key"], "n", at_edges.count())
    return cut(marked.groupBy("page_id").agg(F.collect_set("line").alias("running")))


def _with_running(pages: DataFrame, running: DataFrame | None, page_id: str, text: str) -> DataFrame:
    """(page_id, text, running) of the pages with text; few pages have such lines, so the marks are usually small enough for Spark to broadcast."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    if running is None or running.isEmpty():
        return spread(rows).withColumn("running", F.array().cast("array<int>"))
    return spread(rows).join(running, "page_id", "left")


def _read(batch: pd.DataFrame, reader: Readings, repair: bool) -> Iterator[tuple]:
    for page, text, running in zip(batch["page_id"], batch["text"], batch["running"]):
        yield page, read_page(text, reader, repair, frozenset() if running is None else frozenset(map(int, running)))


def page_defects(pages: DataFrame, lexicon: dict[str, int], running: DataFrame | None = None, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """(page_id, line_no, defect) of every damaged line; running as of running_lines()."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Readings(lexicon)
        for batch in batches:
            rows = [(page, *defect) for page, (found, _) in _read(batch, reader, False) for defect in found]
            yield pd.DataFrame(rows, columns=["page_id", "line_no", "defect"])

    kind = pages.schema[page_id].dataType.simpleString()
    return _with_running(pages, running, page_id, text).mapInPandas(find, f"page_id {kind}, line_no int, defect string")


def page_paragraphs(pages: DataFrame, lexicon: dict[str, int], running: DataFrame | None = None, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """(page_id, paragraph_no, text) of the repaired paragraphs."""

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Readings(lexicon)
        for batch in batches:
            rows = [(page, k, p) for page, (_, found) in _read(batch, reader, True) for k, p in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["page_id", "paragraph_no", "text"])

    kind = pages.schema[page_id].dataType.simpleString()
    return _with_running(pages, running, page_id, text).mapInPandas(repair, f"page_id {kind}, paragraph_no int, text string")
