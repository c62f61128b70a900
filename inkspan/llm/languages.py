"""Missing or wrong language labels (numbered problem 4).

Gives every page, every paragraph of a page, every chunk and every document its languages with a confidence, and finds the labels that deny them.

Defined results of odd input: texts without words have no language (null) and are no cases; null, blank and unknown labels denote no
language; very long texts are read whole; repeated chunk rows give one result (distinct); a document without pages uses no language;
other columns are not read.

Method: segmentation-marginalised unigrams. The pieces of a fixed public vocabulary have a probability in each language, fitted by
expectation maximisation on labelled sentences (at most SAMPLE_ROWS). A word's likelihood is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. Pages are judged by paragraphs, chunks by runs of sentences (Viterbi
with a cost of changing the language, which are the segments of a chunk); the language of a text is that of most of its letters. Scores of words are kept within a
task, so each distinct word is summed once per task. All steps over texts are narrow; only (document, language) pairs are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.page_lines import edge_lines
from inkspan.skew import spread

#: The public vocabulary, and most labelled sentences that the model is fitted on.
VOCABULARY, SAMPLE_ROWS = "/opt/tokenizers/piece_bpe_32k.model", 20_000
#: Rounds of expectation maximisation, and the pseudo-count that all pieces of the vocabulary share in each language.
ROUNDS, SHARED = 4, 40.0
#: Places of a word after which its running sums are scaled.
SCALED = 16
#: Log cost of changing the language between two sentences of a chunk; fewest letters of a paragraph that has a language of its own.
CHANGE, LEAST_LETTERS = 12.0, 24
#: Of the labelled sentences, every so many-th is held out to calibrate confidences; words of the pieces it is cut into for that.
HELD_OUT, PIECE_WORDS = 5, (1, 2, 3, 5, 8, 12, 20)
#: Posterior from which a paragraph of a few letters has a language of its own, taken with the evidence of at most so many words.
CERTAIN, CERTAIN_WORDS = 0.999, 12

#: Other notations of the languages' two-letter codes.
NOTATIONS = {
    "en": "eng english", "fr": "fra fre french français", "de": "deu ger german deutsch", "es": "spa spanish español castellano", "it": "ita italian italiano",
    "pt": "por portuguese português", "nl": "nld dut dutch nederlands", "ru": "rus russian русский",
}
#: Two-letter labels that name no language.
NO_LANGUAGE = ("xx", "zz", "na", "un", "--")

_WORD = re.compile(r"[^\W\d_]+")
_JOINED = re.compile(r"(?<=[^\W\d_])[-‐¬­][ \t]*\n[ \t]*(?=[^\W\d_])")
_SENTENCE = re.compile(r"(?<=[.!?…:])[\"”»)]?\s+")


def code_of(label: Column) -> Column:
    """The two-letter code that a label denotes whatever its notation, or null."""
    plain = F.regexp_extract(F.lower(F.btrim(label)), r"^([^\W\d_]+)(?:[-_].*)?$", 1)
    names = F.create_map(*[F.lit(x) for code, others in NOTATIONS.items() for other in others.split() for x in (other, code)])
    short = F.when(plain.rlike("^[a-z]{2}$") & ~plain.isin(*NO_LANGUAGE), plain)
    return F.when(label.isNotNull(), F.coalesce(names[plain], short))


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class PieceModel:
    """Piece probabilities by language; `score` sums a word's segmentations."""

    def __init__(self, vocabulary: list[str], samples: list[tuple[str, str]], rounds: int = ROUNDS, shared: float = SHARED):
        self.languages = sorted({lang for lang, _ in samples})
        #: A text of n words is judged by its log likelihoods times tempered[0] / n ** tempered[1]: neighbouring words aren't independent.
        self.tempered = (1.0, 0.0)
        self.longest = max(map(len, vocabulary))
        n = len(self.languages)
        self.base = np.full(n, 1 / len(vocabulary))
        self.known = frozenset(vocabulary)
        words: list[dict[str, int]] = [{} for _ in range(n)]
        for lang, text in samples:
            own = words[self.languages.index(lang)]
            for w in _WORD.findall(text.lower()):
                own["▁" + w] = own.get("▁" + w, 0) + 1
        self.prob: dict[str, np.ndarray] = {}
        flat: dict[str, np.ndarray] = {}
        for _ in range(rounds):
            counts: dict[str, np.ndarray] = {}
            for k, own in enumerate(words):
                for word, times in own.items():
                    self._expect(word, times, k, counts)
            total = np.zeros(n)
            for c in counts.values():
                total += c
            flat = {p: (c + shared / len(vocabulary)) / (total + shared) for p, c in counts.items()}
            self.prob, self.base = flat, (shared / len(vocabulary)) / (total + shared)
        self.unknown = self.base * 1e-2

    def _pieces(self, word: str) -> list[tuple[int, int, np.ndarray]]:
        found = []
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                piece = word[i:j]
                p = self.prob.get(piece)
                if p is not None:
                    found.append((i, j, p))
                elif piece in self.known:
                    found.append((i, j, self.base))
                elif j == i + 1:
                    found.append((i, j, getattr(self, "unknown", self.base * 1e-2)))
        return found

    def _expect(self, word: str, times: int, k: int, counts: dict[str, np.ndarray]) -> None:
        """Adds the expected counts of a word's pieces in language k (forward and backward sums)."""
        pieces = [(i, j, math.log(p[k])) for i, j, p in self._pieces(word)]
        n = len(word)
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, p in pieces:
            into[j].append((i, p))
            out[i].append((j, p))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[i] + p for i, p in into[j]])
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum([behind[j] + p for j, p in out[i]])
        for i, j, p in pieces:
            share = math.exp(ahead[i] + p + behind[j] - ahead[n])
            if share > 1e-4:
                counts.setdefault(word[i:j], np.zeros(len(self.languages)))[k] += times * share

    def score(self, word: str) -> np.ndarray:
        """Log likelihood of a lower-case word in each language: the forward sums over all segmentations."""
        word = "▁" + word
        ahead = np.zeros((len(word) + 1, len(self.languages)))
        ahead[0] = 1.0
        taken, next_scale = 0.0, SCALED
        for i, j, p in self._pieces(word):
            if i == next_scale:  # long words would underflow: the sums go on in proportion to the one here
                scale = ahead[i].copy()
                ahead[i : i + self.longest] /= scale
                taken, next_scale = taken + np.log(scale), next_scale + SCALED
            ahead[j] += ahead[i] * p
        return np.log(ahead[-1]) + taken


def fit(samples: DataFrame, vocabulary_file: str = VOCABULARY, rows: int = SAMPLE_ROWS) -> PieceModel:
    """The model of (lang, sample_text) rows: at most that many of them, by sample_id; its confidences are calibrated on held-out sentences."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file)
    vocabulary = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_byte(i) or pieces.is_unknown(i))]
    taken = samples.select("sample_id", "lang", "sample_text").dropna().orderBy("sample_id").limit(rows).collect()
    labelled = [(r["lang"], r["sample_text"]) for r in taken]
    model = PieceModel(vocabulary, labelled)
    model.tempered = calibrate(vocabulary, labelled)
    return model


def calibrate(vocabulary: list[str], labelled: list[tuple[str, str]]) -> tuple[float, float]:
    """The tempering under which pieces of held-out sentences have the highest likelihood of their language."""
    held, rest = labelled[::HELD_OUT], [x for k, x in enumerate(labelled) if k % HELD_OUT]
    known = {lang for lang, _ in rest}
    held = [(lang, _WORD.findall(text.lower())) for lang, text in held if lang in known]
    parts = [(lang, " ".join(words[at : at + n])) for lang, words in held for n in PIECE_WORDS for at in range(0, len(words) - n + 1, n)]
    if not parts:
        return 1.0, 0.0
    judge = Judge(PieceModel(vocabulary, rest))
    scores, _, words = judge.sums([text for _, text in parts])
    right = np.array([judge.model.languages.index(lang) for lang, _ in parts])
    grid = [(a / 10, b / 10) for a in range(1, 11) for b in range(0, 8)]
    return max(grid, key=lambda t: np.log(posterior(scores, words, t)[np.arange(len(right)), right] + 1e-12).sum())


def posterior(scores: np.ndarray, words: np.ndarray, tempered: tuple[float, float]) -> np.ndarray:
    """Probability of each language of each row of log likelihoods."""
    x = (scores - scores.max(axis=1, keepdims=True)) * (tempered[0] * np.maximum(words, 1.0) ** -tempered[1])[:, None]
    x = np.exp(x)
    return x / x.sum(axis=1, keepdims=True)


class Judge:
    """Languages of many texts at once; word scores are kept."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def _row(self, word: str) -> int:
        k = self.index.get(word)
        if k is None:
            if len(self.index) > 300_000:
                self.index.clear()
            k = self.index[word] = len(self.index)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.score(word)
        return k

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood by language, letters, words) of each text."""
        scores = np.zeros((len(texts), len(self.model.languages)))
        letters, n_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), 5000):
            rows: list[int] = []
            ends = []
            for k, text in enumerate(texts[lo : lo + 5000], lo):
                words = _WORD.findall(text.lower())
                letters[k], n_words[k] = sum(map(len, words)), len(words)
                rows += [self._row(w) for w in words]
                ends.append(len(rows))
            running = np.zeros((len(rows) + 1, scores.shape[1]))
            np.cumsum(self.table[rows], axis=0, out=running[1:])
            at = np.array([0, *ends])
            scores[lo : lo + len(ends)] = running[at[1:]] - running[at[:-1]]
        return scores, letters, n_words

    def confidence(self, scores: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Calibrated posterior of the best language of each row."""
        return posterior(scores, words, self.model.tempered).max(axis=1)


def certain(scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the best language of each row leaves no doubt, even with few words."""
    x = (scores - scores.max(axis=1, keepdims=True)) * np.minimum(1, CERTAIN_WORDS / np.maximum(words, 1))[:, None]
    return 1 / np.exp(x).sum(axis=1) >= CERTAIN


def page_paragraphs(text: str | None) -> list[str]:
    """The blocks between empty lines, without heads and page numbers; a block of these alone is ''."""
    if not text:
        return []
    lines = text.split("\n")
    heads = edge_lines(lines)
    blocks: list[list[str]] = []
    inside = False
    for i, line in enumerate(lines):
        if not line.strip():
            inside = False
            continue
        if not inside:
            blocks.append([])
            inside = True
        if i not in heads:
            blocks[-1].append(line)
    return [_JOINED.sub("", "\n".join(b)) for b in blocks]


def _best_letters(codes: np.ndarray, letters: np.ndarray, n: int) -> int:
    return int(np.bincount(codes, weights=letters, minlength=n).argmax())


def page_languages(pages: DataFrame, model: PieceModel) -> DataFrame:
    """(page_id, document_id, label, lang, confidence, paragraphs: array<struct<no, lang, confidence>>) of every page."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        names = model.languages
        for batch in batches:
            if len(batch) == 0:
                continue
            blocks = [page_paragraphs(t) for t in batch["text"]]
            scores, letters, words = judge.sums([b for own in blocks for b in own])
            sure, clear = judge.confidence(scores, words), certain(scores, words)
            codes = scores.argmax(axis=1)
            langs, confidences, paragraphs = [], [], []
            at = 0
            for own in blocks:
                k = np.arange(at, at + len(own))
                at += len(own)
                k = k[letters[k] > 0]
                if not len(k):
                    langs.append(None), confidences.append(None), paragraphs.append([])
                    continue
                big = k[letters[k] >= LEAST_LETTERS]
                if not len(big):
                    main = int(scores[k].sum(axis=0).argmax())
                    confidences.append(float(judge.confidence(scores[k].sum(axis=0)[None], words[k].sum(keepdims=True))[0]))
                else:
                    main = _best_letters(codes[big], letters[big], len(names))
                    same = big[codes[big] == main]
                    confidences.append(float(np.average(sure[same], weights=letters[same]) * letters[same].sum() / letters[big].sum()))
                langs.append(names[main])
                first = at - len(own)
                own_language = (letters[k] >= LEAST_LETTERS) | ((words[k] >= 2) & clear[k])
                paragraphs.append([{"no": int(j - first + 1), "lang": names[codes[j] if alone else main], "confidence": float(sure[j])} for j, alone in zip(k, own_language)])
            yield pd.DataFrame({"page_id": batch["page_id"], "document_id": batch["document_id"], "label": batch["language"], "lang": langs, "confidence": confidences, "paragraphs": paragraphs})

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, document_id string, label string, lang string, confidence double, paragraphs array<struct<no: int, lang: string, confidence: double>>"
    return spread(pages.select("page_id", "document_id", "language", "text")).mapInPandas(judge, schema)


def chunk_languages(chunks: DataFrame, model: PieceModel) -> DataFrame:
    """(chunk_id, label, lang, confidence, segments: array<struct<no, lang, confidence>>) of every chunk, by its runs of sentences in one language."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        names = model.languages
        for batch in batches:
            if len(batch) == 0:
                continue
            parts = [_SENTENCE.split(t) if t else [] for t in batch["content"]]
            scores, letters, words = judge.sums([p for own in parts for p in own])
            langs, confidences, segments = [], [], []
            at = 0
            for own in parts:
                k = slice(at, at + len(own))
                at += len(own)
                if not letters[k].sum():
                    langs.append(None), confidences.append(None), segments.append([])
                    continue
                path = _runs(scores[k])
                begins = np.flatnonzero(np.diff(path, prepend=-1))
                sure = judge.confidence(np.add.reduceat(scores[k], begins, axis=0), np.add.reduceat(words[k], begins))
                segments.append([{"no": no, "lang": names[path[i]], "confidence": float(c)} for no, (i, c) in enumerate(zip(begins, sure), 1)])
                main = _best_letters(path, letters[k], len(names))
                mine = path == main
                langs.append(names[main])
                sure = judge.confidence(scores[k][mine].sum(axis=0)[None], words[k][mine].sum(keepdims=True))[0]
                confidences.append(float(sure * letters[k][mine].sum() / letters[k].sum()))
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "label": batch["language"], "lang": langs, "confidence": confidences, "segments": segments})

    schema = "chunk_id string, label string, lang string, confidence double, segments array<struct<no: int, lang: string, confidence: double>>"
    return spread(chunks.select("chunk_id", "language", "content")).mapInPandas(judge, schema)


def _runs(scores: np.ndarray) -> np.ndarray:
    """The most likely language of each sentence when a change costs CHANGE."""
    best = scores.argmax(axis=1)
    if (best == best[0]).all():
        return best
    value, back = scores[0].copy(), np.zeros(scores.shape, np.int64)
    for t in range(1, len(scores)):
        top = int(value.argmax())
        change = value[top] - CHANGE
        back[t] = np.where(value >= change, np.arange(len(value)), top)
        value = np.maximum(value, change) + scores[t]
    path = np.zeros(len(scores), np.int64)
    path[-1] = value.argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def document_languages(pages: DataFrame) -> DataFrame:
    """(document_id, used): the languages of each document's pages and of their paragraphs; pages as of page_languages()."""
    used = F.array_distinct(F.concat(F.array("lang"), F.transform("paragraphs", lambda p: p["lang"])))
    return pages.filter(F.col("lang").isNotNull()).select("document_id", F.explode(used).alias("lang")).groupBy("document_id").agg(F.collect_set("lang").alias("used"))


def wrong_labels(pages: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, record_key, segment_no, lang): pages and chunks with a wrong label, segments of mixed pages, document languages amiss."""
    amiss = F.col("lang").isNotNull() & ~F.coalesce(code_of(F.col("label")) == F.col("lang"), F.lit(False))
    row = lambda kind, key, no, lang: [F.lit(kind).alias("kind"), F.col(key).cast("string").alias("record_key"), no.cast("int").alias("segment_no"), lang.alias("lang")]
    of_pages = pages.filter(amiss).select(*row("page", "page_id", F.lit(0), F.col("lang")))
    of_chunks = chunks.filter(amiss).select(*row("chunk", "chunk_id", F.lit(0), F.col("lang")))
    mixed = pages.filter(F.size(F.array_distinct(F.transform("paragraphs", lambda p: p["lang"]))) > 1)
    segments = mixed.select("page_id", F.explode("paragraphs").alias("p")).select(*row("segment", "page_id", F.col("p.no"), F.col("p.lang")))
    latest = documents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max_by("languages_detected", F.coalesce("processed_at", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("named"))
    named = F.array_distinct(F.array_compact(F.transform(F.coalesce("named", F.array().cast("array<string>")), code_of)))
    used = F.coalesce("used", F.array().cast("array<string>"))
    sets = latest.join(document_languages(pages).withColumnRenamed("document_id", "doc_id"), "doc_id", "left").select("doc_id", named.alias("named"), used.alias("used"))
    differ = F.array_union(F.array_except("used", "named"), F.array_except("named", "used"))
    of_documents = sets.select("doc_id", F.explode(differ).alias("lang")).select(*row("document", "doc_id", F.lit(0), F.col("lang")))
    return of_pages.unionByName(of_chunks).unionByName(segments).unionByName(of_documents).distinct()
