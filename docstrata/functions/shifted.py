"""Repair of text whose letters stand 29 codes too low, or whose digits stand 29 codes too high.

A word goes through ordered rules; the first that applies gives its number and the
repaired word. Words with a small letter are never decoded as a whole, so the later
rules are reached by words without any. Where only a part of a word is shifted, its
pieces of codes 0x21 to 0x60 are decoded one by one. Lines go through eleven steps.
A word that isn't ASCII is scored with its other signs as they are.
"""

from __future__ import annotations

from docstrata.functions.scalars import JOINED_PROSE, SPLIT_CAPITALS, hyphenated, literal, parenthesis_spacing, period_spacing, squeeze, text_score, unshift

#: What digits and the signs of numbers look like 29 codes up.
RAISED = "BCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWERED = "".join(chr(ord(c) - 29) for c in RAISED)
#: Short words that are known in their shifted form.
SHORT = (("DQ", "any"), ("DQ\\", "any"), ("EH", "be"), ("EXW", "but"), ("LQ", "in"), ("LW", "it"), ("QR", "not"), ("RI", "of"), ("RU", "or"), ("WR", "to"))
#: Terms that make a decoded piece plausible.
USEFUL = "agreement agreements changed either made other accountants accounts agents applicable authorized available breach contained covenant certain confidential consideration conclusion construed contract copies disclosing disclosure documents delivered destroyed developed drawings employees exchange efforts furnished forth information including independently instructions limitation limited mutual officers party parties process property provided produced product promptly prevent purpose receiving relating remain representatives requisitions results specifications shall sole such survive the therefore this transaction under warranties will with written".split()

#: The rules in their order; number 0 is a word that none changes or stops at.
RULES = ("symbol", "no letter or digit", "fiscal period", "quarter", "number", "identifier", "shifted number", "acronym and digits", "raised digits", "decimal", "short capitals", "small letters", "at", "short word", "whole word", "parts of a word beyond ASCII", "parts of a structural word", "structural or too short", "useful term")


def lower_digits(d, x):
    return f"translate({x}, {d.text(RAISED)}, {d.text(LOWERED)})"


def core(d, x):
    """The word from its first to its last ASCII letter or digit."""
    return d.sub(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def head(d, x):
    return d.get(x, "^([^A-Za-z0-9]*)", 1)


def tail(d, x):
    return f"CASE WHEN {d.like(x, '[A-Za-z0-9]')} THEN {d.get(x, '([^A-Za-z0-9]*)$', 1)} ELSE '' END"


def around(d, x, inner):
    return f"concat({head(d, x)}, {inner}, {tail(d, x)})"


def numeric_token(d, x):
    """Digits, a sign before them, one decimal point or comma, and signs of a sentence around them."""
    bare = d.sub(x, "^[,;:()]+|[,;:()]+$", "")
    return d.like(bare, r"^-?[0-9]+(?:[.]?|[.][0-9]+|,[0-9]+[.]?)$")


def _count(d, x, pattern):
    return d.size(d.every(x, pattern))


def marked(d, x):
    """Whether a text without small letters has signs of being shifted."""
    if d.names:
        gain = d.let(unshift(d, x), "u", lambda u: f"({u} <> {x} AND {text_score(d, u)} > {text_score(d, x)})")
        return f"(NOT {d.like(x, '[a-z]')} AND ({_signs(d, x)} OR NOT {structural(d, x)} AND {gain}))"
    punctuation = f"({d.like(x, '[$&' + chr(39) + '%*+]')} AND {d.like(x, '[A-Z]')})"
    many = f"({_count(d, x, '[$&' + chr(39) + '()+,<]')} >= 3)"
    gain = f"(NOT {structural(d, x)} AND {unshift(d, x)} <> {x} AND {text_score(d, unshift(d, x))} > {text_score(d, x)})"
    return f"(NOT {d.like(x, '[a-z]')} AND ({punctuation} OR {many} OR {gain}))"


#: Signs that shifted letters and spaces give, and both sets in one.
PUNCTUATION, SHIFTED_SIGNS, SIGNS = "[$&'%*+]", "[$&'()+,<]", "[$&'%*()+,<]"


def structural(d, x):
    return d.like(x, r"[\[\]<>{}]")


def useful(d, x):
    return d.like(f"lower({unshift(d, x)})", "|".join(USEFUL))


def ascii_only(d, x):
    return f"(NOT {d.like(x, r'[^\x00-\x7F]')})"


def parts(d, x):
    """A word decoded piece by piece; pieces are runs of codes 0x21 to 0x60, or of others."""
    p, other = "p", unshift(d, "p")
    if d.names:
        plain = f"({d.like(p, '^[A-Za-z]+$')} AND NOT {marked(d, p)} AND NOT {useful(d, p)})"
        better = d.let(other, "o", lambda o: f"CASE WHEN {o} <> {p} AND ({text_score(d, o)} >= {text_score(d, p)} OR {useful(d, p)}) THEN {o} ELSE {p} END")
        return d.join(d.map(d.every(x, "[!-`]+|[^!-`]+"), p, f"CASE WHEN NOT {d.like(p, '^[!-`]')} OR {plain} THEN {p} ELSE {better} END"), "")
    plain = f"({d.like(p, '^[A-Za-z]+$')} AND NOT {marked(d, p)} AND NOT {useful(d, p)})"
    better = f"({other} <> {p} AND ({text_score(d, other)} >= {text_score(d, p)} OR {useful(d, p)}))"
    piece = f"CASE WHEN NOT {d.like(p, '^[!-`]')} OR {plain} THEN {p} WHEN {better} THEN {other} ELSE {p} END"
    return d.join(d.map(d.every(x, "[!-`]+|[^!-`]+"), p, piece), "")


def _symbol(d, x):
    return f"CASE WHEN {x} = 'Ł' THEN '•' WHEN {d.like(x, r'\p{L}––$')} THEN {d.sub(x, '––$', '......')} ELSE {d.replace(d.replace(x, '>&', '('), '>' + chr(39), ')')} END"


def _period(d, x, c):
    return around(d, x, f"concat('H', substr({c}, 2))")


def _shifted_number(d, x, c):
    return around(d, x, f"concat(CASE WHEN {c} LIKE 'I%' THEN '0' ELSE '' END, translate({c}, 'MNOPQRSTUVI', '0123456789,'))")


def _raised(d, x, c):
    """Whether the word reads as a number or as a letter and one or two digits once its digits are lowered."""
    low = lower_digits(d, c)
    if d.names:
        fits = d.let(low, "low", lambda low: f"({d.like(low, '^[A-Z][0-9]{1,2}$')} OR {d.like(low, r'^-?[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?$')} AND length({d.sub(low, '^-', '')}) >= 2)")
        return f"({d.like(c, '[B-Zb-z]')} AND NOT ({d.like(c, '^[A-Z]{2,3}$')} AND {c} NOT IN ('QP', 'QQ')) AND {fits})"
    number = f"({d.like(low, r'^-?[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?$')} AND length({d.sub(low, '^-', '')}) >= 2)"
    label = d.like(low, "^[A-Z][0-9]{1,2}$")
    return f"({d.like(c, '[B-Zb-z]')} AND NOT ({d.like(c, '^[A-Z]{2,3}$')} AND {c} NOT IN ('QP', 'QQ')) AND ({number} OR {label}))"


def ladder(d, x, c=None):
    """(test, result) of every rule, in order; ``c`` is the word's core where that has a name."""
    c, other = c or core(d, x), unshift(d, x)
    gain = f"({text_score(d, other)} - {text_score(d, x)})"
    short = "CASE " + " ".join(f"WHEN {x} = {d.text(a)} THEN {d.text(b)}" for a, b in SHORT) + " END"
    listed = ", ".join(d.text(a) for a, _ in SHORT)
    whole = f"({ascii_only(d, x)} AND {marked(d, x)} AND {other} <> {x} AND CASE WHEN {structural(d, x)} THEN {gain} > 0 ELSE {gain} >= 0 END)"
    return (
        (f"{_symbol(d, x)} <> {x}", _symbol(d, x)),
        (f"NOT {d.like(x, '[A-Za-z0-9]')}", x),
        (f"({d.like(c, '^e[0-9][(]')} AND {d.like(c, 'Q[34]')})", _period(d, x, c)),
        (d.like(c, "^Q[1-4]$"), x),
        (numeric_token(d, x), x),
        (f"({d.octets(x)} >= 4 AND {d.like(x, '[0-9]')} AND {d.like(x, r'^[A-Z0-9_./$-]+$')})", x),
        (f"({d.like(c, '^[M-V]*I[M-V]+$')} AND length({c}) BETWEEN 3 AND 5)", _shifted_number(d, x, c)),
        (d.like(c, "^[A-Z]{2,3}[0-9]"), x),
        (_raised(d, x, c), around(d, x, lower_digits(d, c))),
        (f"({d.like(x, '[A-Za-z]')} AND {d.like(x, '[0-9]')} AND {d.like(x, '[.,]')})", x),
        (d.like(x, "^[A-Z]{1,6}$"), x),
        (d.like(x, "[a-z]"), x),
        (f"{x} = 'DW'", "'at'"),
        (f"{x} IN ({listed})", short),
        (whole, other),
        (f"(NOT {ascii_only(d, x)} AND {marked(d, x)})", parts(d, x)),
        (f"({structural(d, x)} AND {marked(d, x)})", parts(d, x)),
        (f"({structural(d, x)} OR {d.octets(x)} < 4 OR NOT {marked(d, x)})", x),
        (useful(d, x), other),
    )


#: Words of which no rule before "small letters" holds; of capitals, of which none before "short capitals" does nor, beyond six, any up to "short word".
SMALL, CAPITALS = "^[A-Z]?[a-z]+[.,;:]?$", "^[I-V]*[A-HW-Z][A-Z]*$"


def _signs(d, x):
    """Whether a text has the signs of being shifted that need no score."""
    return f"({d.like(x, SIGNS)} AND ({d.like(x, '[A-Z]')} AND {d.like(x, PUNCTUATION)} OR {_count(d, x, SHIFTED_SIGNS)} >= 3))"


def _first(d, x, pick):
    """``pick(k, result)`` of the first rule ``k`` that holds. The core and the gain of the whole word get names; words that are plain by their letters skip rules."""
    when = lambda part: " ".join(f"WHEN {test} THEN {pick(k, result)}" for k, (test, result) in part)
    rules = list(enumerate(ladder(d, x), 1))
    whole, beyond, inner, short, term = (pick(k, result) for k, (_, result) in rules[14:])
    gain = d.let(unshift(d, x), "u", lambda u: f"CASE WHEN {u} <> {x} THEN {text_score(d, u)} - {text_score(d, x)} END")

    def scored(g):
        marks = f"(NOT {d.like(x, '[a-z]')} AND ({_signs(d, x)} OR NOT {structural(d, x)} AND coalesce({g} > 0, false)))"
        return f"CASE WHEN NOT {marks} THEN {short} WHEN {g} > 0 OR {g} = 0 AND NOT {structural(d, x)} THEN {whole} WHEN {structural(d, x)} THEN {inner} WHEN {d.octets(x)} < 4 THEN {short} WHEN {useful(d, x)} THEN {term} ELSE {pick(0, x)} END"

    last = f"CASE WHEN {x} IS NULL THEN {pick(0, x)} WHEN {ascii_only(d, x)} THEN {d.let(gain, 'g', scored)} WHEN {marked(d, x)} THEN {beyond} ELSE {short} END"
    asked = lambda c: f"CASE {when(list(enumerate(ladder(d, x, c), 1))[:14])} ELSE {last} END"
    return f"CASE WHEN {d.like(x, SMALL)} THEN {pick(12, x)} WHEN {d.like(x, CAPITALS)} THEN CASE WHEN {d.octets(x)} <= 6 THEN {pick(11, x)} ELSE {last} END ELSE {d.let(core(d, x), 'c', asked)} END"


def rule(d, x):
    if d.names:
        return _first(d, x, lambda k, _: str(k))
    return "CASE " + " ".join(f"WHEN {test} THEN {k}" for k, (test, _) in enumerate(ladder(d, x), 1)) + " ELSE 0 END"


def word(d, x):
    if d.names:
        return _first(d, x, lambda _, result: result)
    return "CASE " + " ".join(f"WHEN {test} THEN {result}" for test, result in ladder(d, x)) + f" ELSE {x} END"


def rule_and_word(d, x):
    """Both in one struct (rule, fixed), for which the rules are asked once."""
    return _first(d, x, lambda k, result: f"named_struct('rule', {k}L, 'fixed', {result})")


# Lines


def _digits(d, x):
    return f"translate({x}, 'MNOPQRSTUV', '0123456789')"


def markers(d, x):
    """Shifted page numbers after leaders and between ligature signs, and numbers of recitals."""
    if d.names:
        return _markers_once(d, x)
    bare = d.sub(x, r"\s+$", "")
    led = f"CASE WHEN {d.contains(bare, d.text('...'))} AND {bare} LIKE '% NO' THEN concat(substr({bare}, 1, length({bare}) - 2), '12', substr({x}, length({bare}) + 1)) ELSE {x} END"
    paged = d.join(d.map(d.every(led, "Œ[0-9M-V]{1,4}Œ|[^Œ]+|Œ"), "p", f"CASE WHEN {d.like('p', '^Œ.+Œ$')} THEN concat('– ', {_digits(d, 'substr(p, 2, length(p) - 2)')}, ' –') ELSE p END"), "")
    recital = "^E[0-9M-V]{1,4}F$"
    words = d.join(d.map(d.split(squeeze(d, paged), " "), "p", f"CASE WHEN {d.like('p', recital)} THEN concat('(', {_digits(d, 'substr(p, 2, length(p) - 2)')}, ')') ELSE p END"), " ")
    return f"CASE WHEN {d.like(paged, r'(?:^|\s)E[0-9M-V]{1,4}F(?:\s|$)')} THEN {words} ELSE {paged} END"


def _markers_once(d, x):
    """The same with each step's text worked out once, and only for lines that have its signs."""
    shown = lambda p: _digits(d, f"substr({p}, 2, length({p}) - 2)")
    leaders = d.let(d.sub(x, r"\s+$", ""), "bare", lambda bare: f"CASE WHEN {bare} LIKE '% NO' THEN concat(substr({bare}, 1, length({bare}) - 2), '12', substr({x}, length({bare}) + 1)) ELSE {x} END")
    led = f"CASE WHEN {d.contains(x, d.text('...'))} THEN {leaders} ELSE {x} END"
    paged = d.join(d.map(d.every("led", "Œ[0-9M-V]{1,4}Œ|[^Œ]+|Œ"), "p", f"CASE WHEN {d.like('p', '^Œ.+Œ$')} THEN concat('– ', {shown('p')}, ' –') ELSE p END"), "")
    paged = d.let(led, "led", lambda led: f"CASE WHEN {d.contains(led, d.text('Œ'))} THEN {paged} ELSE {led} END")
    words = lambda x: d.join(d.map(d.split(squeeze(d, x), " "), "p", f"CASE WHEN {d.like('p', '^E[0-9M-V]{1,4}F$')} THEN concat('(', {shown('p')}, ')') ELSE p END"), " ")
    return d.let(paged, "paged", lambda paged: f"CASE WHEN {d.like(paged, r'(?:^|\s)E[0-9M-V]{1,4}F(?:\s|$)')} THEN {words(paged)} ELSE {paged} END")


_HALF = r"20[0-9]{2}H[12]"
#: What a half year's H and its number are before their digits are lowered; every fiscal period has them, within a word or where two meet.
HALVES = "e[12NO]"
FISCAL = rf"^(?:H[12][(]Q[1-4][+]Q[1-4][)]|[=(\[<>/≤≥]*{_HALF})$"


def fiscal_one(d, x):
    """The word with lowered digits if that is a fiscal period, else null."""
    c = core(d, x)
    if d.names:
        return f"CASE WHEN {d.like(x, HALVES)} AND {d.like(lower_digits(d, c), FISCAL)} THEN {around(d, x, lower_digits(d, c))} END"
    return f"CASE WHEN {d.like(x, '[B-Zb-z]')} AND {d.like(lower_digits(d, c), FISCAL)} THEN {around(d, x, lower_digits(d, c))} END"


def fiscal_two(d, x, y):
    """Two words as one such period, else null: nothing but letters and digits may stand where they meet."""
    both = f"concat({core(d, x)}, {core(d, y)})"
    meets = f"({tail(d, x)} = '' AND {head(d, y)} = '' AND ({d.like(x, '[B-Zb-z]')} OR {d.like(y, '[B-Zb-z]')}))"
    if d.names:
        meets = f"({d.like(f'concat({x}, {y})', HALVES)} AND {meets})"
    return f"CASE WHEN {meets} AND {d.like(lower_digits(d, both), FISCAL)} THEN concat({head(d, x)}, {lower_digits(d, both)}, {tail(d, y)}) END"


def label(d, x):
    return d.like(x, "^[A-Z][0-9]{1,2}$")


def prose_words(d, words):
    """How many words have three letters or more."""
    return d.size(d.keep(words, "w", f"{d.chars(d.sub('w', r'[^\p{L}]', ''))} >= 3"))


def joins(d, x):
    """Steps three to five: hyphens, capitals, prose run together."""
    return literal(d, literal(d, hyphenated(d, x), SPLIT_CAPITALS), JOINED_PROSE)


def spaces(d, x):
    """Steps seven to nine."""
    return markers(d, period_spacing(d, parenthesis_spacing(d, x)))


def opens(d, x, words):
    """Whether a text may have an opening parenthesis that reads E."""
    return f"({x} LIKE '%)%' AND {x} NOT LIKE '%=%' AND {prose_words(d, words)} >= 4)"


def text(d, x):
    """A whole string of a file: markers, else its structural pieces, else all of it if that reads better."""
    if d.names:
        gains = lambda u: d.let(f"CASE WHEN {u} <> {x} THEN {text_score(d, u)} - {text_score(d, x)} END", "g", lambda g: f"CASE WHEN {g} > 0 AND ({g} > 8 OR {marked(d, x)}) THEN {u} ELSE {x} END")
        return d.let(markers(d, x), "m", lambda m: f"""CASE WHEN {m} <> {x} THEN {m} WHEN {structural(d, x)} THEN CASE WHEN {marked(d, x)} THEN {parts(d, x)} ELSE {x} END
          WHEN {d.like(x, '[a-z]')} OR {d.octets(x)} < 4 OR NOT ({d.like(x, r'\s')} OR {marked(d, x)}) THEN {x} ELSE {d.let(unshift(d, x), "u", gains)} END""")
    other, gain = unshift(d, x), f"({text_score(d, unshift(d, x))} - {text_score(d, x)})"
    return f"""CASE WHEN {markers(d, x)} <> {x} THEN {markers(d, x)} WHEN {structural(d, x)} AND {marked(d, x)} THEN {parts(d, x)} WHEN {structural(d, x)} THEN {x}
      WHEN {d.like(x, '[a-z]')} OR {d.octets(x)} < 4 OR NOT ({d.like(x, r'\s')} OR {marked(d, x)}) THEN {x}
      WHEN {other} <> {x} AND {gain} > CASE WHEN {marked(d, x)} THEN 0 ELSE 8 END THEN {other} ELSE {x} END"""
