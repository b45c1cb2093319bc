"""Evaluation items that occur in a corpus, word for word or with their parameters changed.

Texts are brought into a canonical template: numbers, names and units become typed placeholders,
everything but letters and digits is dropped. Windows over the template are hashed and thinned by
winnowing, which picks the same windows on both sides of any long enough common run. Windows of
the corpus that may occur in an item are found with a bit table of fixed size and joined with the
items' windows by hash. The stretches of text around them are laid against the items along the
shared windows, and the fillings of the slots are compared: all alike in a verbatim passage, one
for one in a question asked again with other parameters.

There are two templates. The first works on the bare stream of letters and digits, so that no
spacing, case, line end or invisible character hides a passage; its window length follows from
the items and guarantees that every common run of ``min_run`` characters shares a window. For
verbatim passages it is the only one and replaces numbers and the names and units that the items
hold (a passage of an item holds no others), taken from them by the rules of the second; beside
the second it replaces numbers only. The second replaces any names and units, by rules and
without word lists of a domain: identifiers with an underscore, capitalised words (words of
grammar aside), phrases of kanji and katakana, and what is counted after a number.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, ship, spread

#: Consecutive characters in common that make a leak.
MIN_RUN = 60
#: Template tokens in common, and window length, of a re-parameterised question.
MIN_TEMPLATE = 64
TEMPLATE_WINDOW = 28
#: Of the phrases (which are also wording) in such a run, this share must be filled alike.
SAME_PHRASES = 0.5
#: Bits of the table that thins the corpus's windows; its size does not follow the data.
TABLE_BITS = 24
#: Windows of items that are broadcast; more are joined by shuffle.
MAX_BROADCAST_WINDOWS = 2_000_000
#: Letters and digits of a part of a name that becomes a placeholder of the first template; longer ones could fill a whole run.
NAME_SIZES = (3, 24)
#: Tokens of the first template that any ``MIN_RUN`` characters of an item keep; names that leave fewer are no placeholders there.
LEAST_TOKENS = 24
#: Names and units, most frequent first, that the first template knows; no choice of them changes what is found.
MAX_WORDS = 1 << 15

_NUMBER, _NAME, _UNIT, _PHRASE = 0x110001, 0x110002, 0x110003, 0x110004
_BASE = 0x9E3779B97F4A7C15 | 1
#: Fixed list: words of grammar and question words, which are no names though capitalised.
_GRAMMAR = frozenset(
    """a an the this that these those it its he she they we you i his her their our your my who whom whose which what when where why how if then else while after before because since until although though
    and or but nor so yet for of in on at by to from with without within into onto over under between among as than about against per via not no is are was were be been being do does did has have had can could may might must shall should will would
    let find give given show state calculate compute determine explain describe consider suppose assume note each every all both any some one two three first second next last also however therefore thus there here""".split()
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """1 for letters, 2 for numbers, 0 for all else, by code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x40000):  # beyond these planes are no letters and digits
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            out[c] = 1 if k == "L" else 2
    return out


@lru_cache(maxsize=1)
def _written() -> tuple[np.ndarray, np.ndarray]:
    """Flags by code point: kanji and katakana; letters and digits of ASCII."""
    cjk, plain = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for first, last in ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFD), (0x30A1, 0x30FA), (0x30FC, 0x30FE), (0x3005, 0x3007)):
        cjk[first : last + 1] = True
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        plain[first : last + 1] = True
    return cjk & (_classes() == 1), plain


def fold(text: str) -> str:
    """NFKC and lower case."""
    return unicodedata.normalize("NFKC", text).lower()


def titled(text: str) -> list[tuple[int, int]]:
    """Spans of capitalised words in NFKC, those one blank apart taken together; the spans hold for the folded text too.

    Words of grammar and words all in capitals are none. None where lower case has another length.
    """
    t = unicodedata.normalize("NFKC", text)
    if t.islower() or len(t.lower()) != len(t):
        return []
    found: list[tuple[int, int]] = []
    for m in re.finditer(r"(?<![^\W_])[A-Z\u00c0-\u00de\u0391-\u03a9\u0410-\u042f][^\W\d_]+(?![^\W_])", t):
        w = m.group()
        if w[1:].islower() and w.lower() not in _GRAMMAR:
            if found and found[-1][1] + 1 == m.start() and t[m.start() - 1] == " ":
                found[-1] = (found[-1][0], m.end())
            else:
                found.append(m.span())
    return found


def bare(folded: str) -> str:
    """Letters and digits only."""
    cp = _points(folded)
    return cp[_classes()[cp] > 0].tobytes().decode("utf-32-le", "surrogatepass")


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Template:
    """Tokens with the span of the folded text that each stands for."""

    tokens: np.ndarray
    start: np.ndarray
    end: np.ndarray


#: Stands between texts that are worked on together; no letter, digit or blank.
_BETWEEN = "\0"


def number_template(folded: str, collapse: bool = True, owner: np.ndarray | None = None, words: Words | None = None) -> Template:
    """Letters as they are and every run of digits, whatever stands between them, as one token.

    With ``words`` their names, and their units after a number, are tokens as well; names that overlap are one.
    ``owner`` numbers the texts of a joined string, by character; no run passes from one to the next.
    """
    cp = _points(folded)
    cls = _classes()[cp]
    at = np.flatnonzero(cls)
    tok = cp[at].astype(np.int64)
    if not collapse:
        return Template(tok, at, at + 1)
    num = cls[at] == 2
    tok[num] = _NUMBER
    if words is not None:
        named, unit, begins = words.cover(cp[at], num, None if owner is None else owner[at])
        tok[unit] = _UNIT
        tok[named] = _NAME
    first = np.ones(len(at), bool)
    first[1:] = (tok[1:] < _NUMBER) | (tok[1:] != tok[:-1])
    if words is not None:
        first |= begins
    if owner is not None:
        first[1:] |= owner[at[1:]] != owner[at[:-1]]
    head = np.flatnonzero(first)
    last = np.append(head, len(at))[1:] - 1
    return Template(tok[head], at[head], at[last] + 1)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and end of every run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def full_template(folded: str, titles: list[tuple[int, int]] = ()) -> Template:
    """Numbers, names and units as typed placeholders, other letters as they are.

    A name is an identifier with an underscore or one of the spans in ``titles``; a phrase is a run
    of two or more kanji and katakana, runs joined by の together; a unit is the word or run that
    follows a number, one blank between them at most.
    """
    cp = _points(folded)
    n = len(cp)
    cls = _classes()[cp]
    cjk, plain = (flags[cp] for flags in _written())
    tok = np.where(cls > 0, cp, 0).astype(np.int64)
    end = np.arange(1, n + 1)
    at = lambda flags, k: np.concatenate([flags[k:], np.zeros(k, bool)]) if k > 0 else np.concatenate([np.zeros(-k, bool), flags[:k]])
    taken = np.zeros(n, bool)

    def put(first: np.ndarray, last: np.ndarray, kind: int) -> None:
        size = last - first
        over = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else first
        taken[over] = True
        tok[over] = 0
        tok[first], end[first] = kind, last

    under = cp == 0x5F
    if under.any():
        joint = under & at(plain, 1) & at(plain, -1)
        first, last = _runs(plain | joint)
        named = np.concatenate([[0], np.cumsum(joint)])
        ok = (named[last] > named[first]) & (cls[first] == 1) if len(first) else np.zeros(0, bool)
        put(first[ok], last[ok], _NAME)
    if len(titles):
        first, last = np.array(titles, np.int64).T
        used = np.concatenate([[0], np.cumsum(taken)])
        ok = used[last] == used[first]
        put(first[ok], last[ok], _NAME)
    digit = (cls == 2) & ~taken
    if digit.any():
        # signs are looked at only where they stand between digits: 1,234 or 3.8e+05
        number = digit.copy()
        joint = np.flatnonzero(at(digit, 1) & at(digit, -1) & ~digit)
        number[joint[np.isin(cp[joint], _JOINTS)]] = True
        power = np.flatnonzero((cp == 0x65) & at(digit, -1))
        one = power[(power + 1 < n) & digit[np.minimum(power + 1, n - 1)]]
        two = power[(power + 2 < n) & np.isin(cp[np.minimum(power + 1, n - 1)], _SIGNS) & digit[np.minimum(power + 2, n - 1)]]
        number[np.concatenate([one, two, two + 1])] = True
        first, last = _runs(number)
        put(first, last, _NUMBER)
    else:
        last = np.zeros(0, np.int64)
    no = (cp == 0x306E) & at(cjk, 1) & at(cjk, -1)
    phrase = (cjk | no) & ~taken
    begins, ends = _runs(phrase)
    words_at, words_end = _runs(plain & (cls == 1) & ~taken)
    if len(last):
        after = np.concatenate([last, last[last < n][cp[last[last < n]] == 0x20] + 1])
        for first, stop in ((begins, ends), (words_at, words_end)):
            counted = np.isin(first, after)
            put(first[counted], stop[counted], _UNIT)
        free = ~np.isin(begins, after)
        begins, ends = begins[free], ends[free]
    long = ends - begins >= 2
    put(begins[long], ends[long], _PHRASE)
    keep = np.flatnonzero(tok)
    return Template(tok[keep], keep, end[keep])


#: What may stand between the digits of one number.
_SIGNS = np.array([0x2B, 0x2D], np.uint32)
_JOINTS = np.array([ord(c) for c in ".,:/-"], np.uint32)


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


_NEVER = np.uint64(2**64 - 1)


def window_hashes(tokens: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hash of every window of ``width`` tokens, from prefix sums over powers of an odd base."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64)
    sums, down = _sums(tokens, salt)
    with np.errstate(over="ignore"):
        return _mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _slide(h: np.ndarray, span: int, best, fill) -> np.ndarray:
    """Least or greatest of every ``span`` consecutive values, in three passes whatever the span."""
    n = len(h)
    rows = np.concatenate([h, np.full(-n % span, fill, h.dtype)]).reshape(-1, span)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - span + 1], ahead[span - 1 : n])


def winnow(h: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the least hash of some ``span`` consecutive ones, equal ones included; all of them where there are fewer."""
    n = len(h)
    if n <= span:
        return np.arange(n)
    least = _slide(h, span, np.minimum, _NEVER)
    # a position is chosen if the greatest of the minima of the spans it lies in is its own hash
    pad = np.zeros(span - 1, h.dtype)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), span, np.maximum, h.dtype.type(0)) == h)


@lru_cache(maxsize=MAX_WORDS)
def _word_hashes(word: str) -> tuple[np.uint64, np.uint64]:
    """Hashes of a whole word and of its first three characters."""
    cp = _points(word)
    return window_hashes(cp, len(cp), 7)[0], window_hashes(cp[:3], len(cp[:3]), 8)[0]


@dataclass(frozen=True)
class Words:
    """Names and units of items, as letters and digits only, and where they stand in other such streams.

    What covers a character follows from the characters around it alone, not from spacing, case or
    where a text begins: away from its ends, a common run has the same slots on either side.
    """

    names: tuple[str, ...]
    units: tuple[str, ...]

    @cached_property
    def _hashes(self) -> list[dict[int, np.ndarray]]:
        """Sorted hashes by length, of names and of units."""
        out = []
        for words in (self.names, self.units):
            sizes: dict[int, list] = {}
            for w in words:
                sizes.setdefault(len(w), []).append(_word_hashes(w)[0])
            out.append({n: np.sort(np.array(h, np.uint64)) for n, h in sorted(sizes.items())})
        return out

    @cached_property
    def _begins(self) -> np.ndarray:
        """By the low bits of a hash of three characters: whether a name begins so."""
        out = np.zeros(1 << 18, bool)
        for w in self.names:
            out[_word_hashes(w)[1] & np.uint64((1 << 18) - 1)] = True
        return out

    @cached_property
    def _cut(self) -> tuple[set[str], set[str], int]:
        """Ends and beginnings of names and units as an edge of a run may cut them, and the longest's length."""
        ends = {w[k:] for w in self.names for k in range(1, len(w))} | {w[k:] for w in self.units for k in range(len(w))}
        return ends, {w[:k] for w in (*self.names, *self.units) for k in range(1, len(w))}, max(map(len, (*ends, "")))

    def cover(self, cp: np.ndarray, digit: np.ndarray, owner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the characters lie in a name, which in a unit after a number, and at which a name begins where one before ends."""
        n = len(cp)
        after = np.flatnonzero(digit[:-1] & ~digit[1:]) + 1 if n else np.zeros(0, np.int64)
        if owner is not None:
            after = after[owner[after] == owner[after - 1]]
        begins = window_hashes(cp, 3, 8) if self.names else np.zeros(0, np.uint64)
        begins = np.flatnonzero(self._begins[begins & np.uint64((1 << 18) - 1)])
        sums, down = _sums(cp, 7)
        out = []
        for at, sizes in zip((begins, after), self._hashes):
            begun, ended = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            for size, known in sizes.items():
                here = at[at + size <= n]
                if owner is not None:
                    here = here[owner[here] == owner[here + size - 1]]
                with np.errstate(over="ignore"):
                    h = _mix((sums[here + size] - sums[here]) * down[here])
                here = here[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                begun[here] += 1
                ended[here + size] += 1
            over = np.cumsum(begun - ended)[:n]  # how many words cover a character
            met = over > 0
            met[1:] &= (over[:-1] > 0) & (ended[1:n] == over[:-1])
            out.append((over > 0, met))
        (named, begins), (unit, _) = out
        return named, unit & ~named, begins & named

    def cut_off(self, b: str) -> tuple[np.ndarray, np.ndarray]:
        """By position, how far a name or unit cut off there may reach on, and how far back one that is cut off there."""
        ends, beginnings, longest = self._cut
        on, back = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
        for i in range(len(b)):
            for k in range(1, min(longest, len(b) - i) + 1):
                w = b[i : i + k]
                if w in ends:
                    on[i] = k
                if w in beginnings:
                    back[i + k] = max(back[i + k], k)
        return on, back


def _sums(tokens: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which :func:`window_hashes` makes the hash of any window, and the factors for its beginning."""
    n = len(tokens)
    up, down = _powers(1 << max(12, int(n).bit_length()))
    with np.errstate(over="ignore"):
        value = _mix(tokens.astype(np.uint64) + np.uint64(salt << 32))
        return np.concatenate([[np.uint64(0)], np.cumsum(value * up[:n], dtype=np.uint64)]), down


def _exact(t: Template, text: str) -> np.ndarray:
    """The tokens of a number template with slots told apart by what fills them, the same in every process."""
    out = t.tokens.copy()
    at = np.flatnonzero(out >= _NUMBER)
    if len(at):
        cp = _points(text)
        digit = np.flatnonzero(_classes()[cp])
        first, last = np.searchsorted(digit, t.start[at]), np.searchsorted(digit, t.end[at])
        with np.errstate(over="ignore"):
            # Horner's rule over each slot's characters at once, by their distance from its end
            n = last - first
            upto = np.concatenate([[0], np.cumsum(n)[:-1]])
            k = np.arange(n.sum()) - np.repeat(upto, n)
            back = np.repeat(n, n) - 1 - k
            up = _powers(1 << max(12, int(back.max(initial=0)).bit_length()))[0]
            value = np.add.reduceat(_mix(cp[digit[np.repeat(first, n) + k]].astype(np.uint64)) * up[back], upto)
        out[at] = (value >> np.uint64(2)).astype(np.int64) | (1 << 62)
    return out


@dataclass(frozen=True)
class Plan:
    """Window length and winnowing span of both templates; all sides use the same."""

    collapse: bool
    width: int
    span: int
    width_full: int = TEMPLATE_WINDOW
    span_full: int = MIN_TEMPLATE - TEMPLATE_WINDOW + 1
    #: Verbatim runs share windows of the first template; the full one is for other parameters.
    verbatim_only: bool = False
    #: Names and units that are slots of the first template, where it has others than numbers.
    words: Words | None = None

    def windows(self, folded: list[str], titles: list[list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, ...]:
        """Chosen windows of both templates: text number, hash, fill, the span of its text that each covers, and its reach.

        ``fill`` is a hash of what fills the slots of a window of the number template (0 for the
        other): windows of a verbatim passage have it in common.

        The reach of a window of the full template is the span of the ``span_full - 1`` tokens on
        either side, so that any ``MIN_TEMPLATE`` tokens around it lie within; windows of the number
        template have none (-1), as they are measured in characters.
        Texts are joined and worked on together, as most are short; windows don't pass from one to the next.
        """
        joined = _BETWEEN.join(folded)
        sizes = np.array([len(f) + 1 for f in folded], np.int64)
        owner = np.repeat(np.arange(len(folded)), sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        sides = [(1, number_template(joined, self.collapse, owner, self.words), self.width, self.span)]
        if not self.verbatim_only:
            marks = [(a + off, z + off) for spans, off in zip(titles or [], begin.tolist()) for a, z in spans]
            sides.append((2, full_template(joined, marks), self.width_full, self.span_full))
        out = []
        for salt, t, width, span in sides:
            h = window_hashes(t.tokens, width, salt)
            text = owner[t.start]
            within = text[: len(h)] == text[width - 1 :] if len(h) else np.zeros(0, bool)
            h[~within] = _NEVER  # never the least of its span
            at = winnow(h, span)
            at = at[within[at]]
            own, offset = text[at], begin[text[at]]
            fill = window_hashes(_exact(t, joined), width, salt)[at] if salt == 1 else np.zeros(len(at), np.uint64)
            lo = hi = np.full(len(at), -1)
            if salt == 2 and len(at):
                lo = t.start[np.maximum(at - (span - 1), np.searchsorted(text, own))] - offset
                hi = t.end[np.minimum(at + width + span - 1, np.searchsorted(text, own, side="right")) - 1] - offset
            out.append((own, h[at].astype(np.int64), fill.astype(np.int64), t.start[at] - offset, t.end[at + width - 1] - offset, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*out))

    def alike(self, folded: list[str]) -> _Joined:
        """The texts laid out together for :func:`_verbatim_runs`."""
        joined = _BETWEEN.join(folded)
        owner = np.repeat(np.arange(len(folded)), [len(f) + 1 for f in folded])
        t = number_template(joined, self.collapse, owner, self.words)
        n = self.width + self.span - 1
        h, text = window_hashes(_exact(t, joined), n, 5), owner[t.start]
        at = np.flatnonzero(text[: len(h)] == text[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        letters = np.concatenate([[0], np.cumsum(_classes()[_points(joined)] > 0)])
        first = letters[np.concatenate([[0], np.cumsum([len(f) + 1 for f in folded])[:-1]]).astype(np.int64)] if folded else np.zeros(0, np.int64)
        return _Joined(text[at], h[at], at, letters[t.start], letters[t.end], np.concatenate([[0], np.cumsum(t.tokens >= _NUMBER)]), bare(joined), np.append(first, letters[-1]))


@dataclass
class _Joined:
    """Texts laid out together: every run of the first template as long as a verbatim passage is sure to have, and where the tokens are."""

    #: Text number, hash with slots told apart by what fills them, and first token of each such run.
    text: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    #: Where tokens begin and end among letters and digits, and how many slots stand before each.
    start: np.ndarray
    end: np.ndarray
    slots: np.ndarray
    #: The letters and digits, and where those of each text begin.
    bare: str
    first: np.ndarray


def _verbatim_runs(s: _Joined, t: _Joined, width: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """:func:`longest_verbatim` of all texts of ``s`` against all of ``t`` at once, by their numbers, where ``width`` tokens are alike."""
    order = np.argsort(t.hash, kind="stable")
    lo, hi = (np.searchsorted(t.hash[order], s.hash, side=x) for x in ("left", "right"))
    n = hi - lo
    if not n.any():
        return {}
    i = np.repeat(np.arange(len(n)), n)
    j = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    p, q = s.at[i], t.at[j]
    order = np.lexsort((p, q - p, t.text[j], s.text[i]))
    i, j, p, q = i[order], j[order], p[order], q[order]
    # what goes on token by token in the same two texts is one run
    on = (np.diff(p) == 1) & (np.diff(q) == 1) & (np.diff(s.text[i]) == 0) & (np.diff(t.text[j]) == 0)
    head = np.flatnonzero(np.concatenate([[True], ~on]))
    last = p[np.append(head[1:], len(p)) - 1] + width
    p, q, x, y = p[head], q[head], s.text[i[head]], t.text[j[head]]
    rows = (x, y, s.start[p], s.end[last - 1], t.start[q], s.first[x], s.first[x + 1], t.first[y], t.first[y + 1], last - p, s.slots[last] - s.slots[p])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x, y, a, z, b, a0, a1, b0, b1, tokens, slots in zip(*(r.tolist() for r in rows)):
        size = z - a
        size += _common(s.bare, t.bare, a - 1, b - 1, -1, a - a0, b - b0) + _common(s.bare, t.bare, z, b + z - a, 1, a1 - z, b1 - b - (z - a))
        best[x, y] = max(best.get((x, y), (0, 0, 0)), (size, tokens, slots))
    return best


def _chunks(texts: list[str], size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about so many characters, each with the number of its first."""
    start, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        n += len(t)
        if n >= size:
            yield start, held
            start, held, n = i + 1, [], 0
    if held:
        yield start, held


def safe_length(folded: str, min_run: int, collapse: bool, words: Words | None = None) -> int:
    """Fewest template tokens that any ``min_run`` characters of the text are sure to have wherever they stand.

    Left out is what the characters beyond an end may change there: numbers, names and units that
    they may be part of.
    """
    return int(_safe_lengths(folded, min_run, collapse, words).min(initial=1 << 30))


def _safe_lengths(folded: str, min_run: int, collapse: bool, words: Words | None) -> np.ndarray:
    """The tokens meant in :func:`safe_length`, of every run."""
    t = number_template(folded, collapse, words=words)
    cls = _classes()[_points(folded)]
    at = np.flatnonzero(cls)
    if len(at) < min_run:
        return np.zeros(0, np.int64)
    start, end = np.searchsorted(at, t.start), np.searchsorted(at, t.end)
    slot = t.tokens >= _NUMBER
    a = np.arange(len(at) - min_run + 1)
    b = a + min_run
    if words is not None:
        on, back = words.cut_off(bare(folded))
        a, b = a + on[a], b - back[b]
    # a slot that touches the edge may go on beyond it
    lo = np.searchsorted(start, a, side="left")
    at_lo = np.minimum(lo, len(start) - 1)
    lo += (lo < len(start)) & slot[at_lo] & (start[at_lo] == a)
    hi = np.searchsorted(end, b, side="right")
    hi -= (hi > 0) & slot[hi - 1] & (end[hi - 1] == b)
    return np.maximum(hi - lo, 0)


def too_dense(folded: str, min_run: int, words: Words, least: int = LEAST_TOKENS) -> set[str]:
    """Names to leave out so that every run of the text keeps ``least`` tokens: those that take the most characters of the runs with the fewest."""
    b, names, out = bare(folded), list(words.names), set()
    while True:
        n = _safe_lengths(folded, min_run, True, Words(tuple(names), words.units))
        if n.min(initial=least) >= least:
            return out
        run = b[(at := int(n.argmin())) : at + min_run]
        held = [w for w in names if w in run]
        if not held:
            return out
        most = max(held, key=lambda w: ((len(w) - 1) * run.count(w), w))
        names.remove(most)
        out.add(most)


def words_of(text: str) -> list[tuple[str, str]]:
    """(kind, word) of the names and units in an item by the rules of the full template, as letters and digits only.

    Identifiers come apart at their underscores, capitalised names at blanks, phrases at の.
    """
    folded = fold(text)
    t = full_template(folded, titled(text))
    out = []
    for kind, a, b in zip(t.tokens.tolist(), t.start.tolist(), t.end.tolist()):
        if kind in (_NAME, _UNIT, _PHRASE):
            parts = [bare(w) for w in re.split(r"[_ の]+", folded[a:b])]
            if kind == _UNIT and parts[0] and parts[0] not in _GRAMMAR:
                out.append(("unit", parts[0]))
            out += [("name", w) for w in parts[kind == _UNIT :] if NAME_SIZES[0] <= len(w) <= NAME_SIZES[1] and w not in _GRAMMAR]
    return out


def item_words(items: DataFrame, text: str, min_run: int = MIN_RUN) -> Words:
    """Names and units of the items; whatever a verbatim passage holds, it holds no others.

    Names are left out until every run of every item keeps ``LEAST_TOKENS``, in a few rounds at most.
    """

    def per_item(of: Callable[[str], Iterable[tuple[str, str]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [w for t in b.column("text").to_pylist() for w in of(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in found], pa.string()) for i in (0, 1)], names=["kind", "word"])

        return spread(items.select(F.col(text).alias("text"))).mapInArrow(run, "kind string, word string").groupBy("kind", "word").count()

    rows = per_item(words_of).orderBy(F.desc("count"), "kind", "word").limit(MAX_WORDS).collect()
    names, units = ({r.word for r in rows if r.kind == kind} for kind in ("name", "unit"))
    words = Words(tuple(sorted(names)), tuple(sorted(units)))
    for _ in range(4):
        dense = {r.word for r in per_item(lambda t, w=words: [("name", x) for x in too_dense(fold(t), min_run, w)]).collect()}
        if not dense:
            break
        words = Words(tuple(sorted(names := names - dense)), words.units)
    return words


def plan_for(items: DataFrame, text: str, min_run: int = MIN_RUN, verbatim_only: bool = False) -> Plan:
    """Windows such that every ``min_run`` common characters share a chosen one, whatever the items are.

    The least number of template tokens in any such run of any item is found over all items. Where
    only verbatim passages are looked for, the one template has the items' names and units as
    slots beside the numbers; items so full of them that the least number falls below 16 leave the
    numbers only, and items so full of digits make the template keep its digits.
    """
    ship(items.sparkSession)

    def fewest(words: Words | None) -> int | None:
        @F.pandas_udf("bigint")
        def least(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: safe_length(fold(t or ""), min_run, True, words)).astype("int64")

        return items.agg(F.min(least(F.col(text)))).first()[0]

    if verbatim_only:
        words = item_words(items, text, min_run)
        n = fewest(words)
        if n is not None and n >= 16:
            n = min(n, min_run)
            return Plan(True, n // 2, n - n // 2 + 1, verbatim_only=True, words=words)
    n = fewest(None)
    if n is not None and n < 16:
        return Plan(False, min_run // 2, min_run - min_run // 2 + 1, verbatim_only=verbatim_only)
    n = min(n if n is not None else min_run, min_run)
    return Plan(True, n // 2, n - n // 2 + 1, verbatim_only=verbatim_only)


def _table_places(h: np.ndarray, fill: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    u = h.astype(np.uint64)
    if fill is not None:
        u = _mix(u ^ (fill.astype(np.uint64) >> np.uint64(1)))
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return u & mask, (u >> np.uint64(TABLE_BITS)) & mask


def item_windows(items: DataFrame, item_id: str, text: str, plan: Plan) -> DataFrame:
    """(hash, fill, item_id) of all items; each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for start, group in _chunks([fold(t or "") for t in texts]):
                text, h, fill, *_ = plan.windows(group, None if plan.verbatim_only else [titled(t or "") for t in texts[start : start + len(group)]])
                rows = np.unique(np.stack([text, h, fill]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[2]), b.column("item_id").take(pa.array(rows[0] + start))], names=["hash", "fill", "item_id"])

    kind = dict(items.dtypes)[item_id]
    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("item_id").isNotNull()).mapInArrow(run, f"hash bigint, fill bigint, item_id {kind}").distinct()


def _bit_table(windows: DataFrame, filled: bool = False) -> bytes:
    """A bit table of fixed size in which every item's window has two bits set; with ``filled`` windows differ by what fills their slots."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << TABLE_BITS, bool)
        for b in batches:
            for p in _table_places(b.column("hash").to_numpy(), b.column("fill").to_numpy() if filled else None):
                bits[p] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], names=["bits"])

    # few partitions, so that as few tables of fixed size come to the driver
    parts = windows.select("hash", "fill").coalesce(4).mapInArrow(fill, "bits binary").collect()
    out = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for r in parts:
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _around(s: str, h: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_run: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Spans of the text that hold the windows and their reach; what overlaps is one.

    Windows without a reach get ``min_run`` letters and digits on either side. No span begins or
    ends within a word, a number or a phrase, so that its template is that of the text.
    """
    kind = _classes()[_points(s)] > 0
    counts = np.concatenate([[0], np.cumsum(kind)])
    lo = np.where(lo < 0, np.maximum(np.searchsorted(counts, counts[start] - min_run, side="left"), 0), lo)
    hi = np.where(hi < 0, np.minimum(np.searchsorted(counts, counts[end] + min_run, side="left"), len(s)), hi)
    # out to the nearest blank or sign that joins nothing
    gaps = np.concatenate([[0], np.flatnonzero(~(kind | np.isin(_points(s), _WITHIN))) + 1, [len(s) + 1]])
    lo, hi = gaps[np.searchsorted(gaps, lo, side="right") - 1], gaps[np.searchsorted(gaps, hi, side="right")] - 1
    order = np.argsort(lo, kind="stable")
    h, lo, hi = h[order], lo[order], hi[order]
    reach = np.maximum.accumulate(hi)
    head = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    for a, z in zip(head, np.append(head[1:], len(h))):
        yield int(lo[a]), int(hi[a:z].max()), h[a:z]


#: Signs that a word or number may hold.
_WITHIN = np.array([ord(c) for c in "_.,:/-+"], np.uint32)


def _stretches(plan: Plan, table, min_run: int):
    """Stretches of a document around windows that some item may hold, with the capitalised names in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(table.value, np.uint8)).view(bool)
        for b in batches:
            raw = b.column("text").to_pylist()
            owner, texts, found, names = [], [], [], []
            for begin, group in _chunks([fold(t or "") for t in raw]):
                titles = [[] if plan.verbatim_only else titled(t or "") for t in raw[begin : begin + len(group)]]
                text, h, fill, start, end, left, right = plan.windows(group, titles)
                one, two = _table_places(h, fill if plan.verbatim_only else None)
                hit = np.flatnonzero(bits[one] & bits[two])
                hit = hit[np.lexsort((start[hit], text[hit]))]
                for rows in np.split(hit, np.flatnonzero(np.diff(text[hit])) + 1) if len(hit) else []:
                    no = int(text[rows[0]])
                    for lo, hi, own in _around(group[no], rows, start[rows], end[rows], left[rows], right[rows], min_run):
                        owner.append(begin + no)
                        texts.append(group[no][lo:hi])
                        found.append(np.unique(np.stack([h[own], fill[own]]), axis=1))
                        names.append([x - lo for span in titles[no] if lo <= span[0] and span[1] <= hi for x in span])
            flat = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum([f.shape[1] for f in found])]), pa.int32())
            windows = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], ["hash", "fill"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(texts, pa.string()), pa.array(names, pa.list_(pa.int32())), windows], names=["doc_id", "stretch", "titles", "windows"])

    return run


def candidates(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, plan: Plan, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, stretch, titles, item_ids): stretches of documents and the items they share a template window with.

    For verbatim passages a shared window must also have its slots filled alike. The items'
    windows are broadcast after they were counted, so that a window which many documents hold
    stays spread as the documents are; beyond ``MAX_BROADCAST_WINDOWS`` the join shuffles and is left
    to the planner's splitting of skewed partitions. A stretch names each item once.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = cut(item_windows(items, item_id, item_text, plan), "item-windows")
    table = spark.sparkContext.broadcast(_bit_table(windows, plan.verbatim_only))
    kind = dict(docs.dtypes)[doc_id]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    found = spread(src).mapInArrow(_stretches(plan, table, min_run), f"doc_id {kind}, stretch string, titles array<int>, windows array<struct<hash: bigint, fill: bigint>>")
    found = cut(found.withColumn("no", F.monotonically_increasing_id()), "stretches")
    side = windows.select("hash", "fill", "item_id") if plan.verbatim_only else windows.select("hash", "item_id").distinct()
    side = F.broadcast(side) if windows.count() <= MAX_BROADCAST_WINDOWS else side
    exploded = spread(found.select("no", "windows")).select("no", F.inline("windows"))
    pairs = exploded.join(side, ["hash", "fill"] if plan.verbatim_only else "hash").groupBy("no").agg(F.collect_set("item_id").alias("item_ids"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return found.select("no", "doc_id", "stretch", "titles").repartition(parts, "no").join(pairs, "no").select("doc_id", "stretch", "titles", "item_ids")


@dataclass(frozen=True)
class Slots:
    """A template run in common and how its slots are filled on either side; ``verbatim`` is the longest run of equal characters."""

    verbatim: int
    tokens: int
    slots: int
    changed: int
    consistent: bool


class _Side:
    """A text laid out for comparison: both templates, and what fills their slots."""

    def __init__(self, folded: str, titles: list[tuple[int, int]], collapse: bool = True, words: Words | None = None) -> None:
        self.text, self.titles, self.collapse, self.words = folded, titles, collapse, words
        self._marks: tuple | None = None

    @cached_property
    def letters(self) -> np.ndarray:
        """How many letters and digits stand before each position."""
        return np.concatenate([[0], np.cumsum(_classes()[_points(self.text)] > 0)])

    @cached_property
    def bare(self) -> str:
        return bare(self.text)

    @cached_property
    def numbers(self) -> Template:
        return number_template(self.text, self.collapse, words=self.words)

    @cached_property
    def exact(self) -> np.ndarray:
        return _exact(self.numbers, self.text)

    def marks(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the first template's windows with their slots filled: by position, sorted, and the order. Kept for the width asked for last."""
        if self._marks is None or self._marks[0] != width:
            h = window_hashes(self.exact, width, 3)
            order = np.argsort(h, kind="stable")
            self._marks = width, (h, h[order], order)
        return self._marks[1]

    @cached_property
    def full(self) -> Template:
        return full_template(self.text, self.titles)

    def long_windows(self) -> np.ndarray:
        """Hashes of all runs long enough to count: of letters and digits, and of template tokens."""
        cp = _points(self.text)
        runs = window_hashes(cp[_classes()[cp] > 0].astype(np.int64), MIN_RUN, 5)
        return np.concatenate([runs, window_hashes(self.full.tokens, MIN_TEMPLATE, 6)])

    def fill(self, k: int) -> str:
        return self.text[self.full.start[k] : self.full.end[k]].strip()


def _diagonals(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Offsets of ``b`` against ``a`` at which some window of ``width`` tokens is the same."""
    hb = window_hashes(b, width, 3)
    order = np.argsort(hb, kind="stable")
    return _offsets(window_hashes(a, width, 3), hb[order], order)


def _offsets(ha: np.ndarray, hb: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Offsets at which hashes ``ha`` are among the sorted ``hb``, whose positions are in ``order``."""
    lo, hi = (np.searchsorted(hb, ha, side=s) for s in ("left", "right"))
    n = hi - lo
    i = np.repeat(np.arange(len(ha)), n)
    j = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(i) else i
    return np.unique(j - i)


def _along(a: np.ndarray, b: np.ndarray, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Runs of equal tokens where ``b`` lies ``d`` further: the first position in ``a``, and the runs from there."""
    first = max(0, -d)
    n = min(len(a) - first, len(b) - first - d)
    lo, hi = _runs(a[first : first + n] == b[first + d : first + d + n])
    return first, lo, hi


def _common(x: str, y: str, i: int, j: int, step: int, *most: int) -> int:
    """How many characters from ``x[i]`` and ``y[j]`` on are the same, in steps of 1 or -1, ``most`` at most."""
    n, most = 0, min(most or (len(x),))
    while n < most and 0 <= i < len(x) and 0 <= j < len(y) and x[i] == y[j]:
        n, i, j = n + 1, i + step, j + step
    return n


def longest_verbatim(s: _Side, t: _Side, width: int) -> tuple[int, int, int]:
    """The longest run of equal letters and digits, its template tokens and its slots.

    Runs of the first template are laid along its windows with their slots filled alike; a slot
    filled otherwise ends a run, which then reaches into it as far as the characters are the same.
    Exact for every run that holds a whole window of ``width`` tokens.
    """
    best = (0, 0, 0)
    a, b = s.numbers, t.numbers
    for d in _offsets(s.marks(width)[0], *t.marks(width)[1:]).tolist():
        first, lo, hi = _along(a.tokens, b.tokens, d)
        lo, hi = (at[hi - lo >= width] for at in (lo, hi))
        for x, y in zip((first + lo).tolist(), (first + hi).tolist()):
            slots = x + np.flatnonzero(a.tokens[x:y] >= _NUMBER)
            other = slots[s.exact[slots] != t.exact[slots + d]].tolist()
            for i, z in zip([x, *[k + 1 for k in other]], [*other, y]):
                if z - i >= width:
                    p, q = int(s.letters[a.start[i]]), int(t.letters[b.start[i + d]])
                    n = int(s.letters[a.end[z - 1]]) - p
                    n += _common(s.bare, t.bare, p - 1, q - 1, -1) + _common(s.bare, t.bare, p + n, q + n, 1)
                    best = max(best, (n, z - i, int(np.searchsorted(slots, z) - np.searchsorted(slots, i))))
    return best


def _fillings(s: _Side, t: _Side, i: int, j: int, n: int) -> tuple[int, int, bool]:
    """Slots of a run, how many are filled otherwise, and whether names and units are replaced one for one and most phrases kept."""
    forth: dict = {}
    slots = changed = phrases = kept = 0
    consistent = True
    for k in np.flatnonzero(t.full.tokens[j : j + n] >= _NUMBER).tolist():
        kind, a, b = int(t.full.tokens[j + k]), t.fill(j + k), s.fill(i + k)
        slots, changed = slots + 1, changed + (a != b)
        phrases, kept = phrases + (kind == _PHRASE), kept + (kind == _PHRASE and a == b)
        if kind != _NUMBER:  # a number may stand for several quantities, a name or unit for one
            consistent &= forth.setdefault((kind, a), b) == b
    return slots, changed, consistent and kept >= SAME_PHRASES * phrases


def lay(s: _Side, t: _Side, width: int, width_full: int = TEMPLATE_WINDOW, verbatim_only: bool = False) -> Slots:
    """A stretch against an item: the longest verbatim run, and the longest template run, a consistent one of enough tokens first.

    With ``verbatim_only`` tokens and slots are those of the verbatim run, which are all filled alike.
    """
    exact, tokens, slots = longest_verbatim(s, t, width)
    best = (exact > 0, tokens, slots, 0)
    if not verbatim_only:
        best = (False, 0, 0, 0)
        for d in _diagonals(s.full.tokens, t.full.tokens, width_full).tolist():
            first, lo, hi = _along(s.full.tokens, t.full.tokens, d)
            for x, y in zip(lo.tolist(), hi.tolist()):
                n = y - x
                if n < best[1] and (best[0] or n < MIN_TEMPLATE):
                    continue
                slots, changed, consistent = _fillings(s, t, first + x, first + x + d, n)
                best = max(best, (consistent and n >= MIN_TEMPLATE, n, slots, changed))
    return Slots(exact, best[1], best[2], best[3], best[0])


def compare_slots(stretch: str, item: str, width: int = TEMPLATE_WINDOW) -> Slots:
    """A folded stretch without capitalised names against an item."""
    return lay(_Side(stretch, []), _Side(fold(item), titled(item)), width)


#: Characters of items that are laid against the stretches at a time; more items come in several blocks.
BLOCK_CHARACTERS = 1 << 25


def _laying(block, plan: Plan):
    """Every stretch against the items of a block that it names: (doc_id, item_id, verbatim, tokens, slots, changed, consistent).

    With ``verbatim_only`` they are laid along the shared runs of the first template, all at once.
    Else hashes of all runs that are long enough, of a stretch at once against those of all items of
    the block, tell which items are worth laying out; those are laid along the shared windows.
    """

    def verbatim(sides: list[_Side], number: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        every = plan.alike([s.text for s in sides])
        for b in batches:
            stretches, named = (b.column(c).to_pylist() for c in ("stretch", "item_ids"))
            for begin, group in _chunks(stretches):
                runs = _verbatim_runs(plan.alike(group), every, plan.width + plan.span - 1)
                wanted = [{k for x in ids for k in number.get(x, ())} for ids in named[begin : begin + len(group)]]
                yield b, [(begin + i, k, Slots(size, tokens, slots, 0, True)) for (i, k), (size, tokens, slots) in runs.items() if k in wanted[i]]

    def both(sides: list[_Side], number: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        runs = [s.long_windows() for s in sides]
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        every = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for b in batches:
            rows = []
            for i, (stretch, titles, named) in enumerate(zip(b.column("stretch").to_pylist(), b.column("titles").to_pylist(), b.column("item_ids").to_pylist())):
                side = _Side(stretch, list(zip(titles[::2], titles[1::2])), plan.collapse)
                mine = np.unique(side.long_windows())
                lo, hi = (np.searchsorted(every, mine, side=x) for x in ("left", "right"))
                n = hi - lo
                at = np.unique(owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]) if n.any() else []
                for k in {k for x in named for k in number.get(x, ())}.intersection(map(int, at)):
                    rows.append((i, k, lay(side, sides[k], plan.width)))
            yield b, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = block.value
        number: dict = {}  # an id may stand for several texts
        for i, x in enumerate(ids):
            number.setdefault(x, []).append(i)
        sides = [_Side(fold(t), titled(t), plan.collapse) for t in texts]
        for b, laid in (verbatim if plan.verbatim_only else both)(sides, number, batches):
            docs, found, rows = ([r[n] for r in laid] for n in range(3))
            cols = [pa.array([getattr(r, c) for r in rows], t) for c, t in (("verbatim", pa.int32()), ("tokens", pa.int32()), ("slots", pa.int32()), ("changed", pa.int32()), ("consistent", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(docs, pa.int64())), pa.array([ids[k] for k in found], b.column("item_ids").type.value_type), *cols], names=["doc_id", "item_id", "verbatim", "tokens", "slots", "changed", "consistent"])

    return run


def laid_out(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, verbatim_only: bool = False) -> DataFrame:
    """(doc_id, item_id, verbatim, tokens, slots, changed, consistent) of every candidate stretch and item with a long enough run.

    Items travel to the workers in blocks of ``BLOCK_CHARACTERS``, one for any usual evaluation set.
    """
    spark = docs.sparkSession
    plan = plan_for(items, item_text, verbatim_only=verbatim_only)
    pairs = candidates(docs, doc_id, text, items, item_id, item_text, plan)
    kinds = {"doc_id": dict(pairs.dtypes)["doc_id"], "item_id": dict(items.dtypes)[item_id]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, verbatim int, tokens int, slots int, changed int, consistent boolean"
    texts = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item")).where(F.col("item_id").isNotNull() & (F.length("item") > 0)).distinct()
    size = texts.agg(F.sum(F.length("item"))).first()[0] or 0
    n_blocks = size // BLOCK_CHARACTERS + 1
    out = []
    for k in range(n_blocks):
        block = [tuple(r) for r in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()]
        sent = spark.sparkContext.broadcast(([i for i, _ in block], [t for _, t in block]))
        out.append(pairs.mapInArrow(_laying(sent, plan), schema))
    return reduce(DataFrame.unionByName, out)


def verbatim_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) of documents and items with at least ``MIN_RUN`` consecutive characters in common.

    Both sides in NFKC and lower case, letters and digits only. Each pair comes out once. Null,
    empty and short texts leak nothing; rows with a null id on either side take part nowhere;
    repeated rows count as one; other columns cannot clash.
    """
    seen = laid_out(docs, doc_id, text, items, item_id, item_text, verbatim_only=True)
    return seen.where(F.col("consistent") & (F.col("verbatim") >= MIN_RUN)).select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id)).distinct()


def template_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Every leak with its kind: (doc_id, item_id, kind, template_tokens, slots, changed_slots).

    ``verbatim`` as in :func:`verbatim_leaks`; ``reparameterised`` where no such run is shared, but
    at least ``MIN_TEMPLATE`` template tokens in a row, at least two slots and one of them filled
    otherwise, names and units replaced one for one and ``SAME_PHRASES`` of the phrases kept. One row a pair, the longest run counts.
    """
    seen = laid_out(docs, doc_id, text, items, item_id, item_text).withColumn("exact", F.col("verbatim") >= MIN_RUN)
    ok = (F.col("tokens") >= MIN_TEMPLATE) & (F.col("slots") >= 2) & (F.col("changed") > 0) & F.col("consistent")
    best = seen.where(F.col("exact") | ok).groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"), F.max(F.struct("tokens", "slots", "changed")).alias("s"))
    return best.select(
        F.col("doc_id").alias(doc_id),
        F.col("item_id").alias(item_id),
        F.when(F.col("exact"), "verbatim").otherwise("reparameterised").alias("kind"),
        F.col("s.tokens").cast("bigint").alias("template_tokens"),
        F.col("s.slots").cast("bigint").alias("slots"),
        F.col("s.changed").cast("bigint").alias("changed_slots"),
    )
