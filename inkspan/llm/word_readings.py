"""What a scanned word may read as: a lexicon of counted words, found again by a skeleton that confusions of letters leave as it is."""

from __future__ import annotations

import math
import re
from functools import lru_cache

#: What scanning makes of letters (left as scanned, right as printed), single glyphs first.
GLYPHS = [("†", "t"), ("ɑ", "a"), ("|", "i"), ("|", "l"), ("$", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
          ("0", "o"), ("0", "о"), ("1", "l"), ("1", "i"), ("3", "з"), ("3", "e"), ("4", "a"), ("4", "а"), ("5", "s"), ("6", "b"), ("6", "é"), ("6", "б"), ("8", "b"), ("8", "в"), ("9", "g")]
CONFUSIONS = [("c", "e"), ("b", "h"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "ü"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("h", "li"), ("im", "nn"), ("l", "i"), ("i", "l"),
              ("c", "е"), ("н", "и"), ("и", "н"), ("m", "т"), ("т", "m"), ("п", "л"), ("ьl", "ы"), ("ьі", "ы"), ("c", "с"), ("a", "а"), ("o", "о"), ("p", "р"), ("x", "х")]
#: Letters by the strokes that confusions leave unchanged, so that both sides of every entry above have one skeleton.
STROKES = {"c": "eеc3зс", "i": "il1|rі", "ii": "nuhbü6éб8в", "iii": "mт", "ci": "d", "vv": "w", "a": "aа4ɑ", "o": "oо0", "p": "pр", "x": "xх",
           "s": "s5$", "g": "g9", "t": "t†", "fi": "ﬁﬂ", "ff": "ﬀ", "ffi": "ﬃﬄ", "и": "ин", "л": "лп", "ьi": "ы"}
_SKELETON = str.maketrans({letter: strokes for strokes, letters in STROKES.items() for letter in letters})

#: Log probability of a misread glyph and of a confusion of letters; what an odd glyph left in a word costs.
GLYPH, CONFUSION, ODD = -1.0, -2.5, -6.0
#: Log probability of each letter of a word that isn't in the lexicon, up to LONG letters and beyond.
LETTER, LONG, LATER_LETTER = -0.3, 12, -2.5

_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[†ɑ|$ﬁ-ﬄ0-9]")
_SURE_ODD = re.compile(r"[†ɑﬁ-ﬄ]|(?<=[^\W\d_])[|$](?=[^\W\d_])")
_ODD_DIGIT = re.compile(r"(?<=[^\W\d_]{2})[01459](?=[^\W\d_]{2})")
_NUMBERLIKE = re.compile(r"[0-9IlOo|]+")


def skeleton(word: str) -> str:
    return word.translate(_SKELETON)


class Readings:
    """Log probabilities of words, and the best reading of any word."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.total = math.log(sum(lexicon.values()) + 1)
        self.longest = max(map(len, lexicon), default=1)
        self.by_skeleton: dict[str, list[str]] = {}
        for word in lexicon:
            if not _ODD.search(word):
                self.by_skeleton.setdefault(skeleton(word), []).append(word)
        rules: dict[str, list[tuple[str, str, float]]] = {}
        for scanned, printed, price in [*((a, b, GLYPH) for a, b in GLYPHS), *((a, b, CONFUSION) for a, b in CONFUSIONS)]:
            rules.setdefault(scanned[0], []).append((scanned, printed, price))
        self.rules = rules
        self.correct = lru_cache(maxsize=200_000)(self._correct)
        self.judge = lru_cache(maxsize=200_000)(self._judge)
        self.known_as: dict[str, tuple[str, bool, str, tuple[float, str, int]]] = {}

    def piece(self, written: str) -> tuple[str, bool, str, tuple[float, str, int]]:
        """(lower case, whether it has letters, skeleton, judge()) of a piece of text; kept, as most pieces come again."""
        known = self.known_as.get(written)
        if known is None:
            if len(self.known_as) > 500_000:
                self.known_as.clear()
            low = written.lower()
            known = self.known_as[written] = (low, _LETTER.search(low) is not None, skeleton(low), self.judge(written))
        return known

    def score(self, word: str) -> float:
        """Log probability of a word; one that isn't in the lexicon counts as met once, less if long."""
        n = self.lexicon.get(word)
        if n:
            return math.log(n) - self.total
        return LETTER * min(len(word), LONG) + LATER_LETTER * max(0, len(word) - LONG) - self.total

    def repairs(self, word: str, reading: str) -> tuple[float, int] | None:
        """(log probability, place of the first repair) of the likeliest way in which scanning made word of reading; None if there is none."""
        reached = [{} for _ in range(len(word) + 1)]
        reached[0][0] = (0.0, -1)
        for i, letter in enumerate(word):
            for j, (value, place) in reached[i].items():
                if j < len(reading) and reading[j] == letter:
                    ways = [(i + 1, j + 1, value, place)]
                else:
                    ways = []
                for scanned, printed, price in self.rules.get(letter, ()):
                    if word.startswith(scanned, i) and reading.startswith(printed, j):
                        ways.append((i + len(scanned), j + len(printed), value + price, i if place < 0 else place))
                for to, at, gain, first in ways:
                    if at not in reached[to] or gain > reached[to][at][0]:
                        reached[to][at] = (gain, first)
        return reached[-1].get(len(reading))

    def _correct(self, word: str) -> tuple[float, str, int]:
        """(log probability, reading, place of the first repair or -1) of a lower-case word."""
        odd = _ODD.search(word) is not None and _LETTER.search(word) is not None
        best = (self.score(word) + (ODD if odd else 0.0), word, -1)
        for reading in self.by_skeleton.get(skeleton(word), ()):
            if reading != word:
                way = self.repairs(word, reading)
                if way and self.score(reading) + way[0] > best[0]:
                    best = (self.score(reading) + way[0], reading, way[1])
        return best

    def _judge(self, word: str) -> tuple[float, str, int]:
        """correct() for a word as written; odd glyphs among letters are misreadings even where no reading is known."""
        low = word.lower()
        if not _LETTER.search(low):
            return self.score(low), word, -1
        value, reading, place = self.correct(low)
        if place < 0 and _ODD.search(low) and not _NUMBERLIKE.fullmatch(word):
            inner = _SURE_ODD.search(low)
            if inner and len(_LETTER.findall(low)) >= 2:
                return value, reading, inner.start()
            digit = _ODD_DIGIT.search(low)
            if digit and sum(c.isdigit() for c in low) == 1 and len(low) >= 5:
                return value, reading, digit.start()
        return value, reading, place
