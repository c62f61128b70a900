"""Which lines of a page are running heads and page numbers, judged by their shape at the page's edges."""

from __future__ import annotations

import re

#: Glyphs that scanning puts in place of letters, undone before a line's shape is judged.
LOOKALIKES = str.maketrans({"†": "t", "ɑ": "a", "|": "I", "$": "S", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"})
_DIGIT_LETTERS = str.maketrans("0145938", "olasgeB")
#: Words of titles that stay in lower case.
_SMALL = frozenset("a an and at by for from in of on or the to with de la le les des du et der die das und von el los y di del e do da dos van het en".split())
_SEASON = r"(?:spring|summer|autumn|fall|winter|january|february|march|april|may|june|july|august|september|october|november|december|q[1-4])"

#: A page's own number, alone on its line: digits or Roman numerals, perhaps misread, with the usual trimmings.
_FIGURE = r"(?:[0-9IlOo|]{1,3}|[ivxlcIVXLC]{1,6})"
_PAGE_NUMBER = re.compile(rf"^\s*(?:[-–—\[(]\s*{_FIGURE}\s*[-–—\])]|(?:page|pag\.?|página|pagina|seite|blz\.?|p\.?|s\.?|стр\.?)\s*{_FIGURE}(?:\s*(?:of|de|von|di|van|/|из)\s*{_FIGURE})?|{_FIGURE}\s*/\s*{_FIGURE}|{_FIGURE})\s*$", re.I)
_SPACED = re.compile(r"^\s*(?:\S ){3,}\S?(?:\s+(?:\S ){1,}\S?)*\s*$")
_DATED = re.compile(rf"(?:^|[\s–—-]){_SEASON}\s+[12][0-9]{{3}}(?:,?\s*(?:no|nr|vol)\.?\s*[0-9il]+)?(?:\s{{2,}}[0-9ilo]{{1,4}})?\s*$", re.I)
_WITH_NUMBER = re.compile(r"^\s*(?:[0-9IlO]{1,4}\s+[|•·I]\s+\D|\D.*\s[|•·I]\s+[0-9IlO]{1,4}\s*$)")
_CHAPTER = re.compile(r"^\s*(?:chapter|kapitel|chapitre|capítulo|capitolo|hoofdstuk|глава|part|section)\s+[0-9ivxl]{1,4}\s*[:.–—-]", re.I)
_ENDS = re.compile(r"[.!?;,…\"”»]\s*$")
_LETTERS = re.compile(r"[^\W\d_]+")


def _plain(line: str) -> str:
    """The line with lookalikes undone, and digits inside words read as letters."""
    line = line.translate(LOOKALIKES)
    return re.sub(r"(?<=[^\W\d_])[0145938](?=[^\W\d_]|\b)|(?<!\S)[0145938](?=[^\W\d_]{2,})", lambda m: m.group().translate(_DIGIT_LETTERS), line)


def _unscanned(line: str) -> str:
    """The usual confusions of letters undone everywhere: enough to know a season by."""
    for scanned, printed in (("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("c", "e"), ("ln", "in")):
        line = line.replace(scanned, printed)
    return line


def is_page_number(line: str) -> bool:
    return _PAGE_NUMBER.match(line) is not None


def is_marked_head(line: str) -> bool:
    """A shape that wrapped text never has: letters spaced out, a season and year or a number set off, a chapter, capitals."""
    if not line.strip() or len(line) > 110:
        return False
    if _SPACED.match(line) and sum(c.isalpha() for c in line) >= 6:
        return True
    if _WITH_NUMBER.match(line) and not _ENDS.search(line):
        return True
    plain = _plain(line)
    if ("19" in line or "20" in line) and (_DATED.search(plain) or _DATED.search(_unscanned(plain))):
        return True
    if _CHAPTER.match(plain) or _CHAPTER.match(_unscanned(plain).replace("b", "h")) or _CHAPTER.match(re.sub(r"(?<=[^\W\d_]) (?=[a-z])", "", plain, count=1)):
        return True
    letters = "".join(_LETTERS.findall(plain))
    return not _ENDS.search(line) and len(line.split()) >= 2 and len(letters) >= 8 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)


def is_running_head(line: str) -> bool:
    """A line whose shape is that of a running head or foot: marked as such, or in title case, or a title cut off."""
    if is_marked_head(line):
        return True
    if not line.strip() or len(line) > 110 or _ENDS.search(line) or line.rstrip()[-1] in "-‐¬\xad":
        return False
    plain = _plain(line)
    words = _LETTERS.findall(plain)
    if len(words) < 2 or not words[0][0].isupper():
        return False
    big = [w for w in words if w.lower() not in _SMALL]
    capitals = sum(w[0].isupper() for w in big)
    # one part of a word in lower case may have come off it
    if len(big) >= 2 and words[-1][0].isupper() and (capitals == len(big) or (capitals >= 3 and capitals == len(big) - 1 and big[0][0].isupper())) and len(words) <= 8 and not any(c.isdigit() for c in plain):
        return True
    # a title cut off after a small word
    return words[-1].lower() in ("of", "and", "ancl", "0f") and len(words) <= 9 and plain.rstrip()[-1].isalpha()


def _flows(line: str, following: str, width: int) -> bool:
    """Whether the next line's first word would not have fitted, as between wrapped lines of one paragraph."""
    first = following.split(None, 1)[0] if following.strip() else ""
    return len(line.rstrip()) + 1 + len(first) > width - 2


def edge_lines(lines: list[str]) -> dict[int, str]:
    """Index of a line -> 'header' or 'page_number'.

    Lines are taken from either edge of the page as long as they have such a shape, at most three; wrapped text never has it. Heads in the middle of the text are known by shape alone, page numbers only at the edges.
    """
    filled = [i for i, line in enumerate(lines) if line.strip()]
    found: dict[int, str] = {}
    if not filled:
        return found
    widths = sorted(len(lines[i].rstrip()) for i in filled if not _SPACED.match(lines[i]))
    width = widths[-1] if widths else 0
    if len(widths) > 4:
        width = widths[-2]
    for order in (filled, filled[::-1]):
        for k, i in enumerate(order[:3]):
            if i in found:
                break
            line = lines[i]
            numbers = sum(c.isdigit() for c in line)
            if is_page_number(line) and numbers <= 6 and "page_number" not in [found.get(j) for j in order[:k]]:
                before = lines[i - 1] if i else ""
                label = order is not filled and before.strip() and len(before.split()) <= 2 and not is_running_head(before) and not _ENDS.search(before) and not before.strip()[-1] in "-¬­‐" and len(before.strip()) < 0.5 * width and line.strip().isdigit()
                after = lines[i + 1] if i + 1 < len(lines) else ""
                table = line.strip().isdigit() and (after if order is filled else before).strip().isdigit()
                if not label and not table:
                    found[i] = "page_number"
                    continue
            if is_running_head(line):
                small = i + 1 < len(lines) and lines[i + 1].strip() and lines[i + 1].lstrip()[0].islower()
                wrapped = order is filled and small and _flows(line, lines[i + 1], width)
                if not wrapped:
                    found[i] = "header"
                    continue
            break
    # heads that layout left in the middle of the text: set apart by their shape, and not filled up to the next line's width
    for k, i in enumerate(filled):
        if i in found:
            continue
        line = lines[i]
        if len(line) >= 0.75 * width and not (line[1:2].isupper() or line[1:2] in " |$4" or "|" in line or "20" in line or "19" in line):
            continue
        if len(line) <= 110 and (line[:1].isupper() or line[:1].isdigit() or line[:1] in "|$†") and is_running_head(line):
            following = lines[i + 1] if i + 1 < len(lines) else ""
            if is_marked_head(line) or (len(line) < 0.75 * width and not (following.strip() and _flows(line, following, width)) and (":" in line or "  " not in line)):
                if following.strip() and following.lstrip()[0].islower() and not is_marked_head(line) and i and _flows(lines[i - 1], line, width) is False:
                    continue
                found[i] = "header"
    return found
