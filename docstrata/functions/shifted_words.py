"""The ordered rules of ``shifted`` for one word and the steps of a line up to its joins, for Arrow batches: the same word is repaired once a batch, and words met lately are known.

``shifted`` is the definition; this is its reading for Spark, held to it by tests.
A result depends on the word alone, so what is remembered changes nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc

from docstrata.functions import scalars as f
from docstrata.functions import shifted as s
from docstrata.functions.dialect import WS

#: Words that a worker remembers.
KNOWN = 1 << 17

_ESCAPED = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)
_UNSHIFT, _LOWER, _DIGITS = str.maketrans(f.SHIFTED, f.UNSHIFTED), str.maketrans(s.RAISED, s.LOWERED), str.maketrans("MNOPQRSTUVI", "0123456789,")
_SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPOKEN = re.compile(rf"[^\W_](?:[^{_ESCAPED}]*[^\W_])?")
_NOISE = re.compile(f.NOISE.replace(r"\x{FFFD}", "\ufffd"))
_SMALL, _CAPITALS = re.compile(s.SMALL), re.compile(s.CAPITALS)
_AROUND = re.compile(r"([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)", re.S)
_LED = re.compile(r"[^\W\d_]––$")
_PERIOD, _QUARTER = re.compile(r"e[0-9][(]"), re.compile(r"Q[34]")
_BARE, _NUMBER = re.compile(r"^[,;:()]+|[,;:()]+$"), re.compile(r"-?[0-9]+(?:[.]?|[.][0-9]+|,[0-9]+[.]?)")
_IDENTIFIER, _COMMA = re.compile(r"[A-Z0-9_./$-]+"), re.compile(r"[M-V]*I[M-V]+")
_ACRONYM, _SHORT_CAPITALS = re.compile(r"[A-Z]{2,3}[0-9]"), re.compile(r"[A-Z]{2,3}")
_LABEL, _LOWERED = re.compile(r"[A-Z][0-9]{1,2}"), re.compile(r"-?[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?")
_CAN_RAISE, _SOME, _LETTER, _DIGIT, _LOW = re.compile("[B-Zb-z]"), re.compile("[A-Za-z0-9]"), re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[a-z]")
_UP, _STRUCTURE, _PUNCTUATION, _SIGN = re.compile("[A-Z]"), re.compile(r"[\[\]<>{}]"), re.compile(s.PUNCTUATION), re.compile(s.SHIFTED_SIGNS)
_USEFUL, _PIECE, _VOWEL = re.compile("|".join(s.USEFUL)), re.compile("[!-`]+|[^!-`]+"), re.compile("[aeiou]")
_COMMON, _KNOWN_SHORT = frozenset(f.COMMON), dict(s.SHORT)


def score(x: str) -> int:
    """``scalars.text_score``."""
    low = x.translate(_SMALL_LETTERS)
    out = -10 * len(_NOISE.findall(x))
    for w in (low,) if low.isascii() and low.isalnum() else _SPOKEN.findall(low):
        out += (12 if w in _COMMON else 0) + (3 if _VOWEL.search(w) else -8 if len(w) >= 8 or len(w.encode()) >= 8 else 0)
    # The least embedded word has three letters.
    if len(low) > 2:
        for w in f.EMBEDDED:
            if w in low:
                out += 6
    return out


def _signed(x: str) -> bool:
    return bool(_PUNCTUATION.search(x) and _UP.search(x)) or len(_SIGN.findall(x)) >= 3


def _marked(x: str) -> bool:
    if _LOW.search(x):
        return False
    return _signed(x) or not _STRUCTURE.search(x) and (u := x.translate(_UNSHIFT)) != x and score(u) > score(x)


def _useful(x: str) -> bool:
    return bool(_USEFUL.search(x.translate(_UNSHIFT).lower()))


def _part(p: str) -> str:
    if not "!" <= p[0] <= "`" or p.isascii() and p.isalpha() and not _marked(p) and not _useful(p):
        return p
    o = p.translate(_UNSHIFT)
    return o if o != p and (score(o) >= score(p) or _useful(p)) else p


def _parts(x: str) -> str:
    return "".join(map(_part, _PIECE.findall(x)))


def _symbol(x: str) -> str:
    if x == "Ł":
        return "•"
    return x[:-2] + "......" if _LED.search(x) else x.replace(">&", "(").replace(">'", ")")


def _raised(c: str, low: str) -> bool:
    if not _CAN_RAISE.search(c) or _SHORT_CAPITALS.fullmatch(c) and c not in ("QP", "QQ"):
        return False
    return bool(_LABEL.fullmatch(low) or _LOWERED.fullmatch(low) and len(low.removeprefix("-")) >= 2)


def repaired(x: str) -> tuple[int, str]:
    """The number of the first rule that holds of a word, 0 if none does, and the repaired word."""
    if _SMALL.match(x):
        return 12, x
    if not _CAPITALS.match(x):
        if (y := _symbol(x)) != x:
            return 1, y
        if not _SOME.search(x):
            return 2, x
        before, c, after = _AROUND.fullmatch(x).groups()
        if _PERIOD.match(c) and _QUARTER.search(c):
            return 3, f"{before}H{c[1:]}{after}"
        if len(c) == 2 and c in ("Q1", "Q2", "Q3", "Q4"):
            return 4, x
        if _NUMBER.fullmatch(_BARE.sub("", x)):
            return 5, x
        if _DIGIT.search(x) and _IDENTIFIER.fullmatch(x) and len(x) >= 4:
            return 6, x
        if 3 <= len(c) <= 5 and _COMMA.fullmatch(c):
            return 7, f"{before}{'0' if c[0] == 'I' else ''}{c.translate(_DIGITS)}{after}"
        if _ACRONYM.match(c):
            return 8, x
        if _raised(c, low := c.translate(_LOWER)):
            return 9, f"{before}{low}{after}"
        if _LETTER.search(x) and _DIGIT.search(x) and ("." in x or "," in x):
            return 10, x
    if len(x) <= 6 and x.isascii() and x.isalpha() and x.isupper():
        return 11, x
    if _LOW.search(x):
        return 12, x
    if x in _KNOWN_SHORT:
        return 14, _KNOWN_SHORT[x]
    structural = bool(_STRUCTURE.search(x))
    if x.isascii():
        other = x.translate(_UNSHIFT)
        gain = score(other) - score(x) if other != x else None
        if not (_signed(x) or not structural and gain is not None and gain > 0):
            return 18, x
        if gain is not None and (gain > 0 or gain == 0 and not structural):
            return 15, other
    elif not _marked(x):
        return 18, x
    else:
        return 16, _parts(x)
    if structural:
        return 17, _parts(x)
    if len(x) < 4:
        return 18, x
    return (19, other) if _useful(x) else (0, x)


_HALVES, _FISCAL, _LINE_LABEL = re.compile(s.HALVES), re.compile(s.FISCAL), re.compile(r"[A-Z][0-9]{1,2}")
_HYPHENS = [re.compile(f"{sign}({'|'.join(f.HYPHENATED)})") for sign in ("- ", " -")]


def _period_of(c: str) -> str | None:
    low = c.translate(_LOWER)
    return low if _FISCAL.match(low) else None


def _fiscal_one(x: str) -> str:
    if not _HALVES.search(x):
        return x
    before, c, after = _AROUND.fullmatch(x).groups()
    low = _period_of(c)
    return x if low is None else f"{before}{low}{after}"


def _fiscal_two(x: str, y: str) -> str | None:
    if not _HALVES.search(x + y) or not (_CAN_RAISE.search(x) or _CAN_RAISE.search(y)):
        return None
    (before, c, after), (head, e, tail) = _AROUND.fullmatch(x).groups(), _AROUND.fullmatch(y).groups()
    low = None if after or head else _period_of(c + e)
    return None if low is None else f"{before}{low}{tail}"


def _fiscal(ws: list[str]) -> list[str]:
    """Pairs of words that are a fiscal period, from the left, then single ones."""
    # Only where a half year stands, within a word or where two meet, can a period be.
    halves = [m.start() for m in _HALVES.finditer("".join(ws))]
    if not halves:
        return ws
    ends = list(accumulate(map(len, ws)))
    near = {bisect_right(ends, at + k) for at in halves for k in (0, 1)}
    pairs = {i for k in near for i in (k - 1, k) if 0 <= i < len(ws) - 1}
    if all(_fiscal_one(ws[i]) == ws[i] for i in near) and all(_fiscal_two(ws[i], ws[i + 1]) is None for i in pairs):
        return ws
    out, i = [], 0
    while i < len(ws):
        two = _fiscal_two(ws[i], ws[i + 1]) if i + 1 < len(ws) else None
        out.append(_fiscal_one(ws[i]) if two is None else two)
        i += 1 if two is None else 2
    return out


def _connected(ws: list[str]) -> list[str]:
    """C between two labels is an ampersand."""
    if "C" not in ws:
        return ws
    label = [_LINE_LABEL.fullmatch(w) is not None for w in ws] + [False]
    return ["&" if w == "C" and i and label[i - 1] and label[i + 1] else w for i, w in enumerate(ws)]


def _joins(x: str) -> str:
    """``shifted.joins``."""
    for pattern in _HYPHENS if "- " in x or " -" in x else ():
        x = pattern.sub(r"-\1", x)
    for old, new in (*f.SPLIT_CAPITALS, *f.JOINED_PROSE):
        if old in x:
            x = x.replace(old, new)
    return x


def line(ws: list[str]) -> str:
    """A line of repaired words: fiscal periods, ampersands, joins."""
    return _joins(" ".join(_connected(_fiscal(ws))))


def _remembering() -> Callable[[list], list[tuple[int, str | None]]]:
    """Rules and repairs of words, those met lately from memory."""
    known: dict[str, tuple[int, str]] = {}

    def of(w: str | None) -> tuple[int, str | None]:
        if w is None:
            return 0, None
        found = known.get(w)
        if found is None:
            if len(known) >= KNOWN:
                known.clear()
            found = known[w] = repaired(w)
        return found

    return lambda words: [of(w) for w in words]


def repairing() -> Callable[[pa.Array], pa.Array]:
    """A function of lists of words: structs (rule, fixed)."""
    found_of = _remembering()

    def run(lists: pa.Array) -> pa.Array:
        met = lists.flatten().dictionary_encode()
        # The last entry stands for words that are null.
        found = found_of([*met.dictionary.to_pylist(), None])
        made = pa.StructArray.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], ["rule", "fixed"])
        values = made.take(pc.fill_null(met.indices, len(found) - 1))
        edges = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())])
        return pa.ListArray.from_arrays(edges, values, mask=pc.is_null(lists)) if lists.null_count else pa.ListArray.from_arrays(edges, values)

    return run


def repairing_lines() -> Callable[[pa.Array], pa.Array]:
    """A function of lists of words: ``line`` of each list's words, repaired."""
    found_of = _remembering()

    def run(lists: pa.Array) -> pa.Array:
        met = lists.flatten().dictionary_encode()
        fixed, indices, at, out = [w for _, w in found_of(met.dictionary.to_pylist())], met.indices.to_pylist(), 0, []
        for n in pc.list_value_length(lists).to_pylist():
            out.append(None if n is None else line([fixed[k] for k in indices[at : at + n] if k is not None]))
            at += n or 0
        return pa.array(out, pa.string())

    return run
