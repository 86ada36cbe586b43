"""Noise in text from scanned pages.

A lexicon of all the collection's words and of which words stand beside each other scores a lattice over the
de-lined character stream: its nodes are places between characters, its edges words that are read over any number
of line breaks, hyphens and stray spaces, begin or end inside a run of letters, and may hold several confused
characters; the cheapest path is the repaired text. Running headers and page numbers are taken out first, and only
on evidence: a header recurs in its document in other surroundings and parts words that belong together, a number
parts such words where no number is ever met. A dynamic programme over the remaining lines chooses the paragraph
boundaries.

What is not evidenced stays: an unknown word is rewritten only where it looks like a known one by the usual
confusions of print and that one is met beside the same neighbours more often than the word itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import stored

LEXICON_SHARE = 1 << 18
SLOTS = 1 << 20  # of the counts of rarer words: a fixed size, whatever the collection's
PAIR_SLOTS = 1 << 21  # of the counts of neighbouring words
KINDS = ("hyphen_break", "misread", "running_header", "page_number")
#: Characters that divide words at a line's end.
HYPHENS = "-‐‑­¬"
#: What print is taken for: seen, and what may have stood there.
CONFUSED = {
    "c": ("e", "o"), "e": ("c", "o"), "o": ("a", "c", "e"), "a": ("o",), "f": ("t",), "t": ("f", "l"), "l": ("i", "t"), "i": ("l", "j"), "j": ("i",), "b": ("h",), "h": ("b", "li"), "n": ("u",), "u": ("n", "v"), "v": ("u", "y"), "y": ("v",), "g": ("q",), "q": ("g",), "s": ("5",), "z": ("2",),
    "0": ("o",), "1": ("l", "i"), "2": ("z",), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g", "q"), "+": ("t",), "|": ("l", "i"), "!": ("l", "i"), "$": ("s",), "@": ("a",), "€": ("e",), "£": ("l",), "(": ("c",), "<": ("c",),
    "m": ("rn", "nn", "in", "ni"), "d": ("cl", "ci"), "w": ("vv",), "k": ("lc",), "ﬁ": ("fi",), "ﬂ": ("fl",),
    "rn": ("m",), "nn": ("m",), "in": ("m",), "ni": ("m",), "ii": ("u", "n"), "ri": ("n",), "li": ("h", "u"), "ll": ("u",), "cl": ("d",), "ci": ("d",), "vv": ("w",), "lo": ("b",), "lc": ("k",), "ij": ("y",), "tl": ("d",),
}
CONFUSION, HYPHEN, SPACED_HYPHEN, COMPOUND, STRAY_SPACE, RUN_TOGETHER = 3.4, 1.0, 2.0, 0.5, 9.0, 9.0
SUBTITLE = 6  # words of a subtitle looked for behind a colon in running text; on a line of its own it may have any number
ENOUGH = 50  # sightings of a word before its never standing beside a number says anything
_ROMAN = re.compile(r"^(?=[ivxlcdm]{1,8}$)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
# The forms of a page's number.
_NUM = r"\d{1,5}"
_MARKED = rf"(?:[-–—·•|~*]\s?{_NUM}\s?[-–—·•|~*]|\[\s?{_NUM}\s?\]|(?:page|pg|seite|página|pagina)\.?\s{_NUM}(?:\s?(?:of|/|de|von|sur)\s?{_NUM})?|pp?\.\s?{_NUM}(?:\s?/\s?{_NUM})?|{_NUM}\s?/\s?{_NUM})"
PAGE_LINE = re.compile(rf"^\s*(?:{_MARKED}|\(?{_NUM}\)?)\s*$", re.I)
_SMALL_ROMAN = r"(?-i:[ivxlc]+)"
PAGE_START = re.compile(rf"^\s*(?:{_MARKED}|{_NUM}|{_SMALL_ROMAN})(?:\s*[|·•–—-]\s*|\s+)(?=\S)", re.I)
PAGE_END = re.compile(rf"(?<=\S)(?:\s*[|·•–—-]\s*|\s+)(?:{_MARKED}|{_NUM}|{_SMALL_ROMAN})\s*$", re.I)
PAGE_INLINE = re.compile(rf"(?<!\S)(?:[-–—·•]\s{_NUM}\s[-–—·•]|\[{_NUM}\]|(?:Page|PAGE|Seite|Página)\s{_NUM}(?:\s(?:of|/|de|von|sur)\s{_NUM})?|p\.\s{_NUM}|{_NUM}\s/\s{_NUM})(?!\S)")
_MENTION = re.compile(r"(?:\b(?:see|siehe|vgl\.?|véase|voir|cf\.?)|[(,])\s*$", re.I)
_LABEL = re.compile(r"^[^\W\d_]+\.?\s+(?:\d+|[ivxlcIVXLC]+)\s*[:.–—-]\s*")
#: Short words that stay small inside titles.
_SMALL = frozenset("a an and or of on in for to the with from by at first de la el los las del y e und der die das des le les du et au".split())
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PAIRED = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+|[.!?]")
_LONE_MARKS = ("|", "—", "–", "-", "·", "•")
GAP = "\ue000"  # a private character: no text word


def title_key(line: str) -> str | None:
    """What is the same in all forms of a header: its words without a leading label and number, in small letters; None where a line is no title.

    A title is all in capitals, or every word but short ones begins with one, or such a run is followed by a colon and a
    subtitle; it has two words at least and no stop.
    """
    bare = line.strip()
    if len(bare) > 6 and all(len(x) == 1 for x in bare.split()):
        bare = " ".join("".join(x.split()) for x in re.split(r"\s{2,}", bare))  # letters set apart
    if not bare or bare[-1] in ".!?,;" or re.search(r"[^\w\s:'’&,|–—-]", bare):
        return None
    label = _LABEL.match(bare)
    rest = bare[label.end() :] if label else bare
    head, _, sub = rest.partition(":")
    w = _WORDS.findall(head)
    if not w or re.search(r"\d", rest):
        return None
    capitals = all(c.isupper() for c in rest if c.isalpha())
    big = [x for x in w if x.lower() not in _SMALL]
    titled = bool(big) and w[0][0].isupper() and all(x[0].isupper() for x in big)
    if not capitals and not titled or len(_WORDS.findall(rest)) < 2 and not label:
        return None
    return " ".join(x.lower() for x in _WORDS.findall(rest))


class Lexicon:
    """Costs of words, and which stand beside each other. ``rare``, where given, holds the hashed counts of words that are fewer than ``unseen``: quantity (as counts, lower), table, slot; ``pairs`` those of neighbours: table, slot."""

    def __init__(self, counts: dict[str, int], lower: dict[str, int], total: int, unseen: int, rare: np.ndarray | None = None, pairs: np.ndarray | None = None) -> None:
        self.hashed, self.pairs = rare, pairs
        self.noise = float(rare[0, 0].sum()) / SLOTS if rare is not None else 0.0  # what other words add to a slot
        self.blur = float(pairs[0].sum()) / pairs.shape[1] if pairs is not None else 0.0
        self.counts, self.total = counts, total
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.plain = {w for w, n in counts.items() if 10 * lower.get(w, 0) >= n}  # not names
        self.longest = max(map(len, self.plain), default=0)
        self.bar = -math.log(max(1, unseen) / max(2, total))  # of the rarest word counted exactly
        self.rare = self.bar if rare is None else math.log(max(2, total))  # of a word met nowhere
        self.sure = CONFUSION + min(self.cost.values(), default=0.0)
        self.memo: dict[str, list[tuple[float, str]]] = {}
        self.parsed: dict[str, tuple] = {}

    def _hashed(self, k: int, w: str) -> int:
        """Of a word below the bar: quantity k, never too low."""
        if self.hashed is None:
            return 0
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        return int(min(self.hashed[k, 0, h & (SLOTS - 1)], self.hashed[k, 1, (h >> 32) & (SLOTS - 1)]))

    def number(self, w: str) -> int:
        return self.counts.get(w) or self._hashed(0, w)

    def known(self, w: str, read: bool = True) -> float | None:
        """The word's cost. One that was not read, but is put together, must stand out from what shares its slots."""
        c = self.cost.get(w)
        if c is None and self.hashed is not None:
            n = self._hashed(0, w) - (0.0 if read else self.noise)
            c = -math.log(n / self.total) if n >= (1 if read else 0.5) else None
        return c

    def is_plain(self, w: str) -> bool:
        return w in self.plain or w not in self.cost and self.hashed is not None and 10 * self._hashed(1, w) >= self._hashed(0, w) > 0

    def lone(self, w: str) -> bool:
        """Whether the word is met once only, in a collection where that says little."""
        return self.hashed is not None and w not in self.cost and self._hashed(0, w) == 1

    def beside(self, a: str | None, b: str | None) -> float:
        """How often b follows a, beyond what other pairs of the same slots explain; a stop is ``.``, a number ``#``."""
        if self.pairs is None or not a or not b:
            return 0.0
        h = xxhash.xxh64_intdigest(f"{a} {b}".encode(), 42)
        m = self.pairs.shape[1] - 1
        n = int(min(self.pairs[0, h & m], self.pairs[1, (h >> 32) & m]))
        return n - self.blur if n > self.blur + 3 * math.sqrt(self.blur) else 0.0

    def fluent(self, a: str | None, b: str | None) -> bool:
        """Whether the two words belong side by side."""
        return self.beside(a, b) >= 2

    def told(self, a: str, b: str, w: str) -> bool:
        """Whether a number stands beside w often enough not to be chance: the pair a, b."""
        return self.beside(a, b) >= max(1.0, 0.02 * self.number(w))

    def expects_number(self, w: str) -> bool:
        """Whether numbers stand behind the word, or too little is known of it."""
        return self.number(w) < ENOUGH or self.told(w, "#", w)

    def takes_number(self, w: str) -> bool:
        """Whether numbers stand before the word, or too little is known of it."""
        return self.number(w) < ENOUGH or self.told("#", w, w)

    def corrected(self, w: str) -> list[tuple[float, str]]:
        """Plain words up to two confusions away, with their costs, best first."""
        if w in self.memo:
            return self.memo[w]
        spots = [(i, i + n, x) for i in range(len(w)) for n in (1, 2) if i + n <= len(w) for x in CONFUSED.get(w[i : i + n], ())]
        found: dict[str, float] = {}
        own = self.known(w)
        rarer = self.hashed is not None and (own is None or own > self.bar + CONFUSION)
        for i, e, x in spots:
            o = w[:i] + x + w[e:]
            c = self.cost.get(o)
            if c is None and rarer:
                c = self.known(o, read=False)
            if c is not None and self.is_plain(o):
                found[o] = c + CONFUSION
        if not found and own is None:  # a word that is met is no double misreading
            for k, (i, e, x) in enumerate(spots):
                front = w[:i] + x
                for i2, e2, x2 in spots[k + 1 :]:
                    if i2 >= e:
                        o = front + w[e:i2] + x2 + w[e2:]
                        c = self.cost.get(o)
                        if c is not None and o in self.plain:
                            found[o] = c + 2 * CONFUSION
        best = sorted((c, o) for o, c in found.items())[:4]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[w] = best
        return best


# Punctuation is not part of a word; other signs at its ends are, as they may stand for letters.
_PUNCT = r"[\s.,;:!?\"'’‘“”«»()\[\]{}…–—‐‑­¬/|•·*=-]"
_CORE = re.compile(rf"^({_PUNCT}*)(.*?)({_PUNCT}*)$", re.S)


def _parts(token: str, lex: Lexicon) -> tuple:
    """(lead, core, trail, core in small letters, cost if known, number, odd, ends a sentence, as a neighbour, settled); kept, as tokens recur.

    A token is settled where nothing can cost less than the word itself: it is counted exactly, no correction is
    cheaper, and no hyphen cuts it off.
    """
    got = lex.parsed.get(token)
    if got is None:
        lead, core, trail = _CORE.match(token).groups()
        low = core.lower()
        number = not core or low.replace(".", "").replace(",", "").replace(":", "").isdigit()
        odd = bool(re.search(r"\d|[^\w'’.\-‐‑/@&:]", core) and re.search(r"[^\W\d_]", core))
        if len(lex.parsed) > 200_000:
            lex.parsed.clear()
        ends = bool(re.search(r"[.!?]['\"”’)]*$", token))
        plain = lex.known(low)
        cut = bool(core) and bool(trail) and trail[-1] in HYPHENS and not trail.rstrip(HYPHENS)
        settled = plain is not None and not cut and (plain <= lex.sure or low in lex.cost and not number and not odd and all(c >= plain for c, _ in lex.corrected(low)))
        got = lex.parsed[token] = (lead, core, trail, low, plain, number, odd, ends, "#" if number else low, settled)
    return got


def _shaped(model: str, word: str) -> str:
    return word.upper() if len(model) > 1 and model.isupper() else word[:1].upper() + word[1:] if model[:1].isupper() else word


_NONE, _MIS, _HYP = frozenset(), frozenset({"misread"}), frozenset({"hyphen_break"})


def decode(tokens: list[tuple[str, bool]], lex: Lexicon) -> tuple[list[str], set[str]]:
    """Cheapest path over (token, whether a line ends behind it): the repaired words and the kinds of noise met.

    A node (k, o) is the place before character o of token k's letters; edges run from node to node over any
    number of tokens, as long as nothing but hyphens, spaces and line breaks parts their letters.
    """
    n = len(tokens)
    parts = [_parts(t, lex) for t, _ in tokens]
    best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]  # by token, by offset: cost, from, text, kinds
    best[0][0] = (0.0, None, "", _NONE)

    def relax(at: tuple[int, int], to: tuple[int, int], cost: float, text: str, kinds: frozenset) -> None:
        c = best[at[0]][at[1]][0] + cost
        if to[1] not in best[to[0]] or c < best[to[0]][to[1]][0]:
            best[to[0]][to[1]] = (c, at, text, kinds)

    def before(k: int) -> str | None:
        return None if k == 0 else "." if parts[k - 1][7] else parts[k - 1][8]

    def behind(k: int) -> str | None:
        """What follows token k - 1."""
        return "." if parts[k - 1][7] else parts[k][8] if k < n else None

    def supported(i: int, j: int, word: str, read: str | None) -> bool:
        """Whether a word instead of tokens i to j - 1 is met beside their neighbours, and more often than what was read."""
        a, b = before(i), behind(j)
        for_it = lex.beside(a, word) + lex.beside(word, b)
        against = max(0.0, lex.beside(a, read) - 1) + max(0.0, lex.beside(read, b) - 1) if read else 0.0
        return for_it >= 1 and for_it > 3 * against

    start = True  # of a sentence
    for k in range(n):
        lead, core, trail, low, plain, number, odd, ends, _, settled = parts[k]
        token = tokens[k][0]
        if settled:
            for o in best[k]:
                c = lex.cost.get(low[o:]) if o else plain
                if c is not None:
                    relax((k, o), (k + 1, 0), c, core[o:] + trail if o else token, _NONE)
            start = ends
            continue
        rare = plain is None or low not in lex.cost
        single = plain is not None and low not in lex.cost and lex.lone(low)
        less = lex.bar + 6.0 - plain if single else 0.0  # a word met once costs as much as an unknown one against joins and splits
        for o in range(len(core) + 1):
            if o not in best[k]:  # a place no word ends at
                continue
            at = (k, o)
            if o:
                # Inside a run of letters: the rest, or one more word of it.
                c = lex.cost.get(low[o:])
                if c is not None:
                    relax(at, (k + 1, 0), c, core[o:] + trail, _NONE)
            elif number:
                relax(at, (k + 1, 0), 5.0, token, _NONE)
            else:
                name = core[:1].isupper() and (plain is None or not lex.is_plain(low))
                if plain is not None:
                    relax(at, (k + 1, 0), plain + (6.0 if odd and low not in lex.cost else 0.0), token, _NONE)
                elif "-" in core or "‐" in core:
                    pieces = [p for p in re.split(r"[-‐‑]", low) if p]
                    if len(pieces) > 1 and all(lex.known(p) is not None or p.isdigit() for p in pieces):
                        relax(at, (k + 1, 0), sum(lex.known(p) or 3.0 for p in pieces), token, _NONE)
                if odd or not (name and not start):
                    kept = best[k + 1].get(0, (math.inf,))[0] - best[k][o][0]
                    for c, word in lex.corrected(low):
                        if c >= kept:
                            break  # the word as it was read costs less
                        if odd or supported(k, k + 1, word, low):
                            relax(at, (k + 1, 0), c, lead + _shaped(core, word) + trail, _MIS)
                            break
                    if "-" in core and plain is None:
                        # A confused part of a compound.
                        halves = low.split("-")
                        fixed = [h if lex.known(h) is not None else next((x for _, x in lex.corrected(h)), None) for h in halves]
                        if None not in fixed and fixed != halves and (odd or lex.known("-".join(fixed)) is not None or supported(k, k + 1, "-".join(fixed), low)):
                            relax(at, (k + 1, 0), lex.rare + CONFUSION, lead + _shaped(core, "-".join(fixed)) + trail, _MIS)
                # Kept as an unknown word; letters mixed with digits or signs were misrecognised.
                strange = odd and bool(re.search(r"[^\W\d_].*[^\w'’.\-‐‑/@&:].*[^\W\d_]|[^\W\d_]\d[^\W\d_]", core))
                relax(at, (k + 1, 0), lex.rare + (2.0 if name else 6.0) + (6.0 if odd else 0.0), token, _MIS if strange else _NONE)
            if rare and core.isalpha() and core.islower() and len(core) - o >= 6:
                # A word ends inside the letters. It must be counted exactly: two rare ones cost too much.
                for e in range(o + 2, min(len(core) - 1, o + lex.longest + 1)):
                    c = lex.cost.get(low[o:e])
                    if c is not None and (len(low) - e <= lex.longest):
                        relax(at, (k, e), c + RUN_TOGETHER - (less if not o else 0.0), (lead if not o else "") + core[o:e], _NONE)
            # Words that go on behind hyphens, line breaks and stray spaces.
            read, shown, price, hyphens, j = low[o:], core[o:], 0.0, 0, k
            while j + 1 < n:
                mark = parts[j][2]
                lead2, core2, trail2, low2, plain2 = parts[j + 1][:5]
                cut = bool(mark) and mark[-1] in HYPHENS and not mark.rstrip(HYPHENS)
                if not core2 or lead2.strip() or (mark and not cut) or (cut and not core2[:1].islower()) or not read:
                    break
                if not cut and not (rare or hyphens) or len(read) + len(low2) > lex.longest + 8 and not cut:
                    break
                price += (HYPHEN if tokens[j][1] else SPACED_HYPHEN) if cut else STRAY_SPACE
                hyphens += cut
                first = j == k and not o
                j += 1
                whole, to = read + low2, (j + 1, 0)
                kinds = _HYP if hyphens else _NONE
                front = "" if o else lead
                cw = lex.known(whole, read=False)
                if hyphens:
                    compound = f"{read}-{low2}" if cut else None
                    cc = lex.known(compound, read=False) if compound else None
                    cw = lex.known(whole)
                    if cc is not None:
                        relax(at, to, cc + COMPOUND, f"{front}{shown}-{core2}{trail2}", _HYP if hyphens > 1 else _NONE)
                    if cw is not None:
                        relax(at, to, cw + price, front + shown + core2 + trail2, kinds)
                    fix = next(((c, x) for c, x in lex.corrected(whole) if not whole.isalpha() or supported(k, j + 1, x, whole) or cw is None and cc is None), None)
                    if fix is not None:
                        relax(at, to, fix[0] + price, front + _shaped(shown, fix[1]) + trail2, kinds | _MIS)
                    if cw is None:
                        if cut and cc is None and first:
                            if not (lex.known(read) is not None and lex.known(low2) is not None):
                                relax(at, to, lex.rare + price + (2.0 if core[:1].isupper() else 4.0), front + shown + core2 + trail2, kinds)
                            if fix is None and "-" in core2:
                                relax(at, to, lex.rare + price, front + shown + core2 + trail2, kinds)
                elif cw is not None and (whole in lex.cost or cw < lex.rare - 0.5 and low2 not in lex.cost):  # met more than once, and not from an ordinary word
                    relax(at, to, cw + price - less, front + shown + core2 + trail2, kinds)
                elif not odd and plain is None and plain2 is None:
                    fix = next(((c, x) for c, x in lex.corrected(whole) if supported(k, j + 1, x, None)), None)
                    if fix is not None:
                        relax(at, to, fix[0] + price, front + _shaped(shown, fix[1]) + trail2, kinds | _MIS)
                if plain2 is None and core2.isalpha() and core2.islower():
                    # The word ends inside the next letters.
                    for e in range(2, len(low2) - 1):
                        c = lex.cost.get(read + low2[:e])
                        if c is not None:
                            relax(at, (j, e), c + price + RUN_TOGETHER, front + shown + core2[:e], kinds)
                read, shown = whole, shown + core2
        start = ends or not core and start
    out: list[str] = []
    kinds: set[str] = set()
    at = (n, 0)
    while True:
        _, prev, text, k = best[at[0]][at[1]]
        if prev is None:
            break
        out.append(text)
        kinds |= k
        at = prev
    return out[::-1], kinds


def _last(words: list[str]) -> str | None:
    """The last of the words as a neighbour; a stop where a sentence ended."""
    t = _PAIRED.findall(words[-1].lower()) if words else []
    return None if not t else "." if t[-1] in "!?" else "#" if t[-1].isdigit() else t[-1]


def _first(words: list[str]) -> str | None:
    t = _PAIRED.findall(words[0].lower()) if words else []
    return None if not t else "#" if t[0].isdigit() else t[0]


def _parts_words(before: list[str], after: list[str], lex: Lexicon) -> bool:
    """Whether the words before and behind a gap belong together: side by side elsewhere, or halves of one word."""
    if not before or not after:
        return False
    a, b = before[-1], after[0]
    if a[-1] in HYPHENS and b[:1].islower():
        whole = (a.rstrip(HYPHENS) + b).lower()
        return lex.known(_CORE.match(whole).group(2)) is not None
    x, y = _last(before), _first(after)
    if x == ".":
        return b[:1].isupper() and lex.fluent(".", y)
    return not b[:1].isupper() and lex.fluent(x, y)


def _page_split(bare: str) -> str | None:
    """A line without the page number at one of its ends; None where none stands there."""
    for edge in (PAGE_START, PAGE_END):
        m = edge.search(bare)
        if m:
            return bare[: m.start()] + bare[m.end() :]
    return None


def _runs(words: list[str]) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, all in capitals) of what could be a header inside running text, longest first at each place."""
    n = len(words)
    clean = [w.rstrip(":,") for w in words]
    big = [c[:1].isupper() and any(x.isalpha() for x in c) for c in clean]
    i = 0
    while i < n:
        if not big[i] or words[i][:1] in "(\"":
            i += 1
            continue
        j = i
        while j < n and (big[j] or clean[j].lower() in _SMALL or j > i and clean[j].isdigit() and words[j][-1] == ":"):
            j += 1
            if words[j - 1][-1] in ".!?;,)":
                break
        for b in range(i, j):
            if big[b]:
                for e in range(j, b + 1, -1):
                    if words[e - 1][-1] == ":":
                        for m in range(min(n, e + SUBTITLE), e, -1):
                            if words[m - 1][-1] not in ".!?;,:)":
                                yield b, m, False
                    if big[e - 1] and words[e - 1][-1] not in ".!?;,)":
                        yield b, e, all(c.isupper() for w in words[b:e] for c in w if c.isalpha())
        i = max(j, i + 1)


def sites(text: str | None, lex: Lexicon) -> list[tuple[str, str | None, bool, bool]]:
    """(key, surroundings, parts words or stands beside a page number, at the text's edge) of every place that looks like a header; surroundings are null where it only might be one, inside running text."""
    if not text:
        return []
    raw = [ln.strip() for ln in re.split(r"\r\n|\r|\n", unicodedata.normalize("NFC", text)) if ln.strip()]
    lines = [ln.split() for ln in raw]
    out = []
    near = lambda a, b: " ".join([*a[-2:], "/", *b[:2]])
    if len(lines) > 1:
        for k, bare in enumerate(raw):
            rest = _page_split(bare)
            key = title_key(rest) if rest is not None else None
            paged = key is not None
            key = key or title_key(bare)
            if key is None:
                continue
            a = next((x for x in reversed(lines[:k]) if not PAGE_LINE.match(" ".join(x))), [])
            b = next((x for x in lines[k + 1 :] if not PAGE_LINE.match(" ".join(x))), [])
            paged |= any(PAGE_LINE.match(" ".join(x)) for x in (lines[k - 1] if k else [], lines[k + 1] if k + 1 < len(lines) else []) if x)
            out.append((key, near(a, b), paged or _parts_words(a, b, lex), not a or not b))
    words = [w for ln in lines for w in ln]
    for b, e, capitals in _runs(words):
        key = title_key(" ".join(words[b:e]))
        if key is not None:
            whole = capitals and (b == 0 or not words[b - 1].isupper()) and (e == len(words) or not words[e].isupper())
            strong = whole and len(lines) == 1
            out.append((key, near(words[:b], words[e:]) if strong else None, strong and _parts_words(words[:b], words[e:], lex), strong and (b == 0 or e == len(words))))
    return out


def _inline(words: list[str], lex: Lexicon, headers: frozenset[str]) -> tuple[list[str], set[str]]:
    """Take page numbers and evidenced headers out of running text; a line's end is a word of its own, GAP marks a place."""
    kinds: set[str] = set()
    taken = [False] * len(words)
    if headers:
        upto = 0
        for b, e, capitals in _runs(words):
            if b < upto:
                continue
            key = title_key(" ".join(words[b:e]))
            if key in headers and (capitals or len(key.split()) >= 2):
                taken[b:e] = [True] * (e - b)
                upto = e
                kinds.add("running_header")
    text = " ".join(GAP if t else w for w, t in zip(words, taken))

    def page(m: re.Match) -> str:
        before, after = text[: m.start()].split(), text[m.end() :].split()
        beside = GAP in (before[-1:] + after[:1])
        if _MENTION.search(text[max(0, m.start() - 12) : m.start()]) or re.search(r"[=:]\s*$", text[: m.start()]):
            return m.group(0)
        edge = not before and after and after[0][:1].isupper() or not after and before and _last(before) == "."
        if not (beside or edge or _parts_words([w for w in before if w != GAP], [w for w in after if w != GAP], lex)):
            return m.group(0)
        kinds.add("page_number")
        return GAP

    words = PAGE_INLINE.sub(page, text).split()
    out: list[str] = []
    for i, w in enumerate(words):
        roman = len(w) > 1 and _ROMAN.match(w) and not re.search("[dm]", w) and lex.counts.get(w, 0) < 1e-3 * lex.total
        if not roman and not re.fullmatch(r"\d{1,4}", w):
            out.append(w)
            continue
        j = i + 1
        while j < len(words) and words[j] in (GAP, *_LONE_MARKS):
            j += 1
        before, after = [x for x in out if x != GAP], [x for x in words[j:] if x != GAP]
        while before and before[-1] in _LONE_MARKS:
            before.pop()
        beside = GAP in out[-2:] or GAP in words[i + 1 : j]
        prev, nxt = before[-1] if before else "", after[0] if after else ""
        if prev[-1:] in ("=", ":", "/", "+", "*", "(", "%") or nxt[:1] in ("=", ":", "/", "+", "*", "%", ")"):
            out.append(w)
            continue
        a, b = _last(before), _first(after)
        told = a not in (None, ".", "#") and prev[-1] not in HYPHENS and (lex.told(a, "#", a) if beside else lex.expects_number(a)) or b is not None and a != "." and not beside and lex.takes_number(b)
        year = len(w) == 4
        ends = a in (None, ".") and (b is None or nxt[:1].isupper() and (a is None or lex.fluent(".", b)))
        if not (beside and not told or not year and (ends and (before or after) or not told and a != "." and _parts_words(before, after, lex))):
            out.append(w)
            continue
        kinds.add("page_number")
        if out and out[-1] in _LONE_MARKS:
            out.pop()
        out.append(GAP)
    lone = [w for k, w in enumerate(out) if w != GAP and not (w in _LONE_MARKS and GAP in (out[k - 1] if k else "", out[k + 1] if k + 1 < len(out) else ""))]
    return lone, kinds


def _paragraphs(lines: list[str]) -> list[list[str]]:
    """Dynamic programme: the boundaries that make each paragraph's lines full but the last, at a price per paragraph."""
    full = [ln for ln in lines if ln.strip()]
    if not full:
        return []
    width = max(len(ln) for ln in full)
    price = 0.8
    n = len(lines)
    cost, prev = [0.0] + [math.inf] * n, [0] * (n + 1)
    # Price of letting the paragraph go on behind a line, and of ending there.
    go_on, end = [], []
    for k, ln in enumerate(lines):
        nxt = lines[k + 1].strip() if k + 1 < n else ""
        blank = not ln.strip() or not nxt
        closes = bool(re.search(r"[.!?:]['\"”’)]*\s*$", ln))
        short = 1 - len(ln.strip()) / width
        item = bool(re.match(r"([-•*·]|\d+[.)]|\([a-z]\))\s", nxt))
        go_on.append(6.0 if blank or item else 6.0 * max(0.0, short - 0.2) if closes else 0.0)
        end.append(0.0 if blank or item else 0.6 if closes and nxt[:1].isupper() else 5.0)
    # A paragraph of lines i to j - 1 goes on behind all of them but the last: prices so far, less those before it.
    so_far, least, at = 0.0, math.inf, 0
    for j in range(1, n + 1):
        if cost[j - 1] - so_far < least + 1e-9:
            least, at = cost[j - 1] - so_far, j - 1
        cost[j], prev[j] = least + so_far + price + (end[j - 1] if j < n else 0.0), at
        so_far += go_on[j - 1]
    cuts, j = [], n
    while j > 0:
        cuts.append((prev[j], j))
        j = prev[j]
    return [p for a, b in reversed(cuts) if (p := [ln for ln in lines[a:b] if ln.strip()])]


def _furniture(lines: list[str], lex: Lexicon, headers: frozenset[str]) -> tuple[list[str], set[str]]:
    """The lines without those that are a page's header or number."""
    kinds: set[str] = set()
    filled = [k for k, ln in enumerate(lines) if ln.strip()]
    if len(filled) < 2:
        return lines, kinds
    width = max(len(lines[k].strip()) for k in filled)
    gone: set[int] = set()
    prose = lambda ln: len(_WORDS.findall(ln)) >= 2
    for i, k in enumerate(filled):
        bare = lines[k].strip()
        around = [lines[filled[x]] for x in (i - 2, i - 1, i + 1, i + 2) if 0 <= x < len(filled)]
        number = bool(PAGE_LINE.match(bare) or _ROMAN.match(bare))
        if number and any(map(prose, around)):
            kinds.add("page_number")
            gone.add(k)
    for i, k in enumerate(filled):
        if k in gone:
            continue
        bare = lines[k].strip()
        rest = _page_split(bare)
        key = title_key(rest) if rest is not None else None
        paged = key is not None
        key = key or title_key(bare)
        if key is None:
            continue
        above = next((lines[x].split() for x in reversed(filled[:i]) if x not in gone), [])
        below = next((lines[x].split() for x in filled[i + 1 :] if x not in gone), [])
        if not above and not below:
            continue
        # A line in capitals, or one on which the next word had room.
        early = bool(below) and (bare.isupper() or len(bare) + 1 + len(below[0]) <= width)
        by_number = any(0 <= x < len(filled) and filled[x] in gone and filled[x] in (k - 1, k + 1) for x in (i - 1, i + 1))
        if key in headers or paged and (above or below) and rest.strip() or by_number or early and _parts_words(above, below, lex):
            kinds.add("running_header")
            gone.add(k)
            if paged:
                kinds.add("page_number")
    return [ln for k, ln in enumerate(lines) if k not in gone], kinds


def repair(text: str | None, lex: Lexicon, headers: frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """The text as continuous paragraphs, and the kinds of noise taken out, sorted; ``headers`` are the keys evidenced for its document."""
    if text is None:
        return None, []
    lines, kinds = _furniture(re.split(r"\r\n|\r|\n", unicodedata.normalize("NFC", text)), lex, headers)
    done = []
    for para in _paragraphs(lines):
        tokens: list[tuple[str, bool]] = []
        if len(para) == 1:
            words, found = _inline(para[0].split(), lex, headers)
            kinds |= found
            tokens = [(w, k == len(words) - 1) for k, w in enumerate(words)]
        else:
            for ln in para:
                t = ln.split()
                tokens += [(w, False) for w in t[:-1]]
                if t:
                    tokens.append((t[-1], True))
        words, found = decode(tokens, lex)
        kinds |= found
        done.append(" ".join(words))
    return "\n\n".join(done), [k for k in KINDS if k in kinds]


def lexicon(texts: DataFrame, text: str) -> tuple[dict, dict, int, int, np.ndarray | None, np.ndarray]:
    """Of words and hyphened compounds: counts and counts in small letters, at most LEXICON_SHARE entries by the threshold, the hashed counts of all below it, and those of neighbours."""
    joined = F.regexp_replace(F.col(text), f"[{HYPHENS}]\\s+", "")
    words = texts.select(F.explode(F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))).alias("w"))
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.lower("w").alias("w")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)).alias("l")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(total / LEXICON_SHARE))
    rows = counts.filter(F.col("n") >= least).collect()  # at most LEXICON_SHARE rows
    table = lambda c: {r["w"]: r[c] for r in rows if r[c]}
    two = lambda h, m: F.array(h.bitwiseAND(F.lit(m - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(m - 1)))
    rare = None
    if least > 1:
        sums = counts.filter(F.col("n") < least).select(F.posexplode(two(F.xxhash64("w"), SLOTS)).alias("k", "slot"), "n", "l").groupBy("k", "slot").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).toPandas()  # at most 2 * SLOTS rows
        rare = np.zeros((2, 2, SLOTS), np.int32)
        for q, c in enumerate("nl"):
            rare[q, sums["k"].to_numpy(np.int64), sums["slot"].to_numpy(np.int64)] = np.minimum(sums[c].to_numpy(np.int64), 2**31 - 1)
    said = F.transform(F.regexp_extract_all(F.lower(joined), F.lit(r"\p{L}+(?:-\p{L}+)*|\d+|[.!?]"), F.lit(0)), lambda w: F.when(w.rlike(r"^\d"), "#").when(w.rlike("^[!?]"), ".").otherwise(w))
    beside = texts.select(said.alias("t")).filter(F.size("t") > 1).select(F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    sums = beside.select(F.posexplode(two(F.col("h"), PAIR_SLOTS)).alias("k", "slot"), "n").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * PAIR_SLOTS rows
    pairs = np.zeros((2, PAIR_SLOTS), np.int32)
    pairs[sums["k"].to_numpy(np.int64), sums["slot"].to_numpy(np.int64)] = np.minimum(sums["n"].to_numpy(np.int64), 2**31 - 1)
    return table("n"), table("l"), max(1, total), least, rare, pairs


def scan_noise(texts: DataFrame, text: str = "text", document: str | None = None) -> DataFrame:
    """texts with two more columns, ``repaired`` string and ``noise`` array<string> (of KINDS).

    ``document`` names the column of the material a text was taken from; headers recur within it (within the whole
    collection where it is left out). Evidence is counted over all texts and joined by document and header, so no
    document's texts are gathered anywhere.
    Defined cases: a null text stays null without noise, an empty or blank one becomes empty; texts of a null
    document count as those of one; texts are read whole; repeated rows stay repeated; an empty table gives no row.
    All columns pass through; existing columns named repaired or noise are replaced.
    """
    keep = [c for c in texts.columns if c not in ("repaired", "noise")]
    doc = F.coalesce(F.col(document).cast("string"), F.lit("")) if document else F.lit("")
    body = stored(texts.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), F.col(text).cast("string").alias("text"), F.struct(*keep).alias("all")))
    shared = texts.sparkSession.sparkContext.broadcast(lexicon(body.select("text"), "text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        for b in batches:
            rows = [(r, d, *s) for r, d, t in zip(*(b.column(k).to_pylist() for k in range(3))) for s in sites(t, lex)]
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row", "doc", "key", "near", "strong", "edge"])

    titled = body.select("row", "doc", "text").filter(F.col("text").rlike(r"\p{Lu}"))
    seen = stored(titled.mapInArrow(look, "row bigint, doc string, key string, near string, strong boolean, edge boolean"))
    of_key = seen.filter("near IS NOT NULL").groupBy("doc", "key").agg(F.min("near").alias("a"), F.max("near").alias("b"), F.count_if("strong").alias("strong"), F.count_if("edge").alias("edge"))
    evident = of_key.filter("a != b AND (strong >= 1 OR edge >= 2)").select("doc", "key")
    headers = seen.select("row", "doc", "key").distinct().join(evident, ["doc", "key"]).groupBy("row").agg(F.collect_set("key").alias("headers"))
    src = body.join(headers, "row", "left").select("text", "headers", "all")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        for b in batches:
            done = [repair(t, lex, frozenset(h or ())) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.column(2).flatten(), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=[*keep, "repaired", "noise"])

    return src.mapInArrow(run, f"{fields}, repaired string, noise array<string>")
