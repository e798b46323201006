"""Text scalars of the document operators, by inventory number; each takes a dialect and SQL for its input."""

from __future__ import annotations

from docstrata.functions.dialect import WS

# --- white space, cleaning, comparing ---------------------------------------


def squeeze(d, x):
    return f"trim({d.sub(x, f'[{WS}]+', ' ')})"


def trim_ends(d, x):
    return d.sub(x, f"^[{WS}]+|[{WS}]+$", "")


def fold(d, x):
    """Case folding of Latin text: lower case, sharp s as ss."""
    return d.replace(f"lower({x})", "ß", "ss")


#: References decoded by the cleaner; the ampersand last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(d, x):
    for name, sign in NAMED:
        x = d.replace(x, name, sign)
    return x


def clean_text(d, x):
    x = d.replace(unescape(d, x), "\u00a0", " ")
    x = d.sub(x, r"[ \x09\x0C\x0B\x0D]+", " ")
    x = d.sub(x, r" +([.,;:!?])", r"\1")
    x = d.sub(x, r" *\n *", "\n")
    return trim_ends(d, d.sub(x, r"\n{3,}", "\n\n"))


def normalize_line(d, x):
    return squeeze(d, d.sub(squeeze(d, fold(d, x)), rf"[^\p{{L}}\p{{N}}_{WS}]+", ""))


def tokens(d, x):
    return d.every(fold(d, x), r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]")


def classify_score(d, x):
    return f"CASE WHEN {x} >= 95 THEN 'Very close' WHEN {x} >= 80 THEN 'Mostly similar' WHEN {x} >= 60 THEN 'Partly similar' ELSE 'Substantially different' END"


# --- predicates on lines ------------------------------------------------------


#: Signs that structure a line, and signs that wrongly decoded text is full of.
STRUCTURE = r"[<>\[\]()/+\-.:•◦▪□☐☑☒✓✔]"
NOISE = r"[}\]^~\x{FFFD}]"


def readable(d, x):
    visible, alnum = d.chars(d.sub(x, f"[{WS}]", "")), d.chars(d.sub(x, r"[^\p{L}\p{N}]", ""))
    return f"({visible} > 0 AND NOT {d.like(x, r'[\x00-\x08\x0E-\x1F\x7F\x{80}-\x{84}\x{86}-\x{9F}]')} AND ({alnum} * 2 >= {visible} OR {d.like(x, STRUCTURE)}))"


def symbol_noise(d, x):
    noise, visible = d.size(d.every(x, NOISE)), d.chars(d.sub(x, f"[{WS}]", ""))
    return f"(NOT {d.like(x, r'[\[{0-9]')} AND ({noise} >= 2 OR ({noise} = 1 AND {visible} <= 5)))"


#: Common words of the text score, and words that count wherever they stand.
COMMON = "a an and are as be by for from in is it not of or shall the this to with agreement confidential equipment information party".split()
EMBEDDED = "agreement confidential equipment information party shall the this".split()


def text_score(d, x):
    """How much like English a text reads: common words and words with vowels against long words without and signs of noise."""
    low = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    if d.names:
        return d.let(low, "low", lambda low: _score_once(d, x, low))
    words = d.keep(d.map(d.split(squeeze(d, low), " "), "w", d.sub("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), "w", "w <> ''")
    count = lambda test: d.size(d.keep(words, "w", test))
    listed = ", ".join(f"'{w}'" for w in COMMON)
    embedded = " + ".join(f"CASE WHEN {d.contains(low, d.text(w))} THEN 1 ELSE 0 END" for w in EMBEDDED)
    vowel = d.like("w", "[aeiou]")
    return f"(12 * {count(f'w IN ({listed})')} + 6 * ({embedded}) + 3 * {count(vowel)} - 8 * {count(f'{d.octets("w")} >= 8 AND NOT {vowel}')} - 10 * {d.size(d.every(x, NOISE))})"


def _score_once(d, x, low):
    """The score in one pass over the words: from a first letter or digit to the last one before white space."""
    listed = ", ".join(f"'{w}'" for w in COMMON)
    embedded = " + ".join(f"CASE WHEN {d.contains(low, d.text(w))} THEN 6L ELSE 0L END" for w in EMBEDDED)
    words = d.every(low, rf"[\p{{L}}\p{{N}}](?:[^{WS}]*[\p{{L}}\p{{N}}])?")
    worth = f"CASE WHEN w IN ({listed}) THEN 12L ELSE 0L END + CASE WHEN {d.like('w', '[aeiou]')} THEN 3L WHEN {d.octets('w')} >= 8 THEN -8L ELSE 0L END"
    return f"(aggregate({words}, 0L, (n, w) -> n + {worth}) + {embedded} - 10 * {d.size(d.every(x, NOISE))})"


def heading_ending(d, x):
    return f"(NOT {d.like(trim_ends(d, x), '[,;:]$')} AND {d.size(d.keep(d.split(squeeze(d, x), ' '), 'w', 'w != ' + chr(39) * 2))} <= 12)"


def list_marker(d, x):
    return f"CASE WHEN {d.like(x, f'^[{WS}]*[-*+•o] ')} THEN 'unordered' WHEN {d.like(x, f'^[{WS}]*[0-9]+[.)] ')} THEN 'ordered' ELSE 'none' END"


def bullet_prose(d, x):
    return f"({d.like(x, f'^[{WS}]*[•o] ')} AND {_worded(d, x)} >= 4 AND {d.like(x, r'\p{Ll}')})"


def page_number_footer(d, x):
    return d.like(x, rf"^[{WS}]*[0-9]*[{WS}]* P a g e[{WS}]*$")


def dash_page_number(d, x):
    return d.like(squeeze(d, x), r"^[–-] ?[0-9]{1,4} ?[–-]$")


def fraction_footer(d, x):
    last = d.item(d.split(squeeze(d, x), " "), -1)
    a, b = d.whole(d.get(last, "^([0-9]{1,9})/[0-9]{1,9}$")), d.whole(d.get(last, "^[0-9]{1,9}/([0-9]{1,9})$"))
    return f"coalesce({d.octets(squeeze(d, x))} <= 100 AND {a} >= 1 AND {a} <= {b}, false)"


def xml_line(d, x):
    return f"({d.like(x, f'^[{WS}]*<')} OR {d.like(x, f'^[{WS}]*(?:xmlns|xsi:|schemaLocation|targetNamespace)')})"


def link_uri(d, x):
    return f"({d.like(x, r'^(?:https?://|mailto:|www[.])')} AND NOT {d.like(x, r'[\x00-\x1F\x7F]')})"


def column_start(d, x):
    return d.like(x, r"^[-–—:;,(\[]*(?:[0-9A-Z]|www[.]|http)|^[-–—:;,(\[]*[^-–—:;,(\[].*://")


def domain_like(d, x):
    return d.like(x, r"www[.]|://|[.](?:com|org|net|ch|io)")


def _worded(d, x):
    """How many words have two letters or more."""
    return d.size(d.keep(d.split(squeeze(d, x), " "), "w", f"{d.chars(d.sub('w', r'[^\p{L}]', ''))} >= 2"))


def definition_prose(d, x, font="12"):
    return f"({font} BETWEEN 7 AND 12.5 AND NOT {d.like(x, '[=+]')} AND NOT {domain_like(d, x)} AND {leader_page(d, x)} = '' AND {d.like(x, r'\p{Ll}')} AND {d.chars(x)} >= 42 AND {_worded(d, x)} >= 6)"


def numeric_cells(d, x):
    return d.like(x, r"^[0-9.,%+\- ]+$")


def plain_number(d, x):
    return d.like(x, r"^[+-]?[0-9]+(?:[.,][0-9]+)*%?$")


def plain_identifier(d, x):
    return f"({d.chars(x)} >= 4 AND {d.like(x, '[0-9]')} AND {d.like(x, r'^[A-Z0-9_./$-]+$')})"


def fill_sign(d, x):
    return d.like(x, "B{4}")


# --- rewriting ---------------------------------------------------------------


def squeezed_key(d, x):
    """Counters of an already squeezed line read ``#``; lines without digits stay as they are."""
    pair = r"^([0-9]{1,9})/([0-9]{1,9})$"
    counter = f"({d.like('w', '^[0-9]+$')} OR ({d.like('w', pair)} AND {d.whole(d.get('w', pair, 1))} >= 1 AND {d.whole(d.get('w', pair, 1))} <= {d.whole(d.get('w', pair, 2))}))"
    return f"CASE WHEN {d.like(x, '[0-9]')} THEN {d.join(d.map(d.split(x, ' '), 'w', f'CASE WHEN {counter} THEN ' + d.text('#') + ' ELSE w END'), ' ')} ELSE {x} END"


def furniture_key(d, x):
    return squeezed_key(d, squeeze(d, x))


def license_runs(d, x):
    """Runs of 12 or more quote, dash, comma and backtick signs go."""
    return f"trim({d.sub(x, rf'[{WS}]*[`,\-' + chr(39) + '’“”]{12,}' + rf'[{WS}]*', ' ')})"


def joined_words(d, x):
    x = d.sub(x, r"([0-9])([a-z])", r"\1 \2")
    return d.sub(x, r"([a-z])([0-9]{2,}|[0-9]+[.])", r"\1 \2")


def joined_pairs(d, x):
    return d.sub(d.sub(x, r"(?i)\b(and)(can)\b", r"\1 \2"), r"(?i)\b(of)(over)\b", r"\1 \2")


def parenthesis_spacing(d, x):
    return d.replace(d.replace(x, "( ", "("), " )", ")")


def period_spacing(d, x):
    return d.sub(x, "([Ll]ast)([0-9])", r"\1 \2")


def note_markers(d, x):
    return d.sub(x, r"\b(Note)([0-9]+)([a-z])", r"\1 \2 \3")


def caption_dash(d, x):
    return d.sub(x, r"\b((?:Figure|Table) [0-9]+)Œ", r"\1 –")


def acronym_title(d, x):
    return d.sub(x, r"^([A-Z]{2,5})([A-Z][a-z])", r"\1 \2")


def url_text(d, x):
    return d.sub(f"lower({d.sub(x, f'[{WS}]', '')})", r"[./]+$", "")


def link_target(d, x):
    return d.sub(x, "^https?://", "")


def outer_prefix(d, x):
    return d.get(x, "^([^A-Za-z0-9]*)", 1)


def outer_suffix(d, x):
    return d.get(x, "([^A-Za-z0-9]*)$", 1)


def leader_label(d, x):
    return _leaders(d, x, 1)


def leader_page(d, x):
    return _leaders(d, x, 2)


def _leaders(d, x, part):
    """Label (1) or last word (2) of a line with three dots in a row whose last word is a page number; '' for others."""
    shape = r"^(.*[^. ]) *[. ]*[.][. ]* ([^ ]+) *$"
    return f"CASE WHEN {d.contains(x, d.text('...'))} AND {marker_digits(d, d.get(x, shape, 2))} <> '' THEN {d.get(x, shape, part)} ELSE '' END"


def marker_digits(d, x):
    """A number as it is or with all its digits shifted to capitals, without the signs around it; '' for others."""
    bare = d.sub(x, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return f"CASE WHEN {d.like(bare, '^[0-9]+$')} THEN {bare} WHEN {d.like(bare, '^[M-V]+$')} THEN translate({bare}, 'MNOPQRSTUV', '0123456789') ELSE '' END"


def document_title(d, x):
    bare = trim_ends(d, d.sub(trim_ends(d, x), "^Microsoft (?:Word|PowerPoint|Excel) -", ""))
    return f"CASE WHEN lower({bare}) IN ('', 'english', 'draft', 'untitled') OR {d.like(f'lower({bare})', r'[.](?:doc|docx|xls|xlsx|ppt|pptx|pdf|pages|key|numbers)$')} THEN NULL ELSE {bare} END"


# --- widths --------------------------------------------------------------------


def text_width(d, x, font="12"):
    return f"{d.chars(x)} * CAST({font} AS DOUBLE) * CAST(0.45 AS DOUBLE)"


# --- Markdown lines -----------------------------------------------------------------


def heading_depth(d, x):
    return d.chars(d.get(x, rf"^[{WS}]*(#{{1,6}}) ", 1))


def heading_text(d, x):
    return trim_ends(d, d.get(x, rf"^[{WS}]*#{{1,6}} (.*)$", 1))


def rule(d, x):
    return d.like(x, rf"^[{WS}]*(?:-{{3,}}|\*{{3,}}|_{{3,}})[{WS}]*$")


def unquote(d, x):
    return d.sub(x, rf"^[{WS}]*> ?", "")


def fence(d, x):
    return d.get(x, rf"^[{WS}]*(```|~~~)", 1)


def fence_language(d, x):
    return trim_ends(d, d.get(x, rf"^[{WS}]*(?:```|~~~)(.*)$", 1))


def item_text(d, x):
    return d.get(x, rf"^[{WS}]*(?:[-*+]|[0-9]+[.]) (.*)$", 1)


def item_start(d, x):
    return d.whole(d.get(x, rf"^[{WS}]*([0-9]{{1,9}})[.] ", 1))


def task_state(d, x):
    box = d.get(item_text(d, x), r"^\[([ xX])\] ", 1)
    return f"CASE {box} WHEN ' ' THEN 'open' WHEN 'x' THEN 'done' WHEN 'X' THEN 'done' ELSE 'none' END"


def cells(d, x):
    return d.map(d.split(f"trim(BOTH '|' FROM {trim_ends(d, x)})" if type(d).__name__ == "Spark" else f"trim({trim_ends(d, x)}, '|')", "|"), "c", trim_ends(d, "c"))


def alignment(d, x):
    return f"CASE WHEN {d.like(x, '^:-+:$')} THEN 'center' WHEN {d.like(x, '^-+:$')} THEN 'right' WHEN {d.like(x, '^:-+$')} THEN 'left' ELSE '' END"


def link_label(d, x):
    return d.get(x, r"\[([^\]]*)\]\(([^)]*)\)", 1)


def link_href(d, x):
    return d.item(d.split(d.get(x, r"\[([^\]]*)\]\(([^)]*)\)", 2), " "), 0)


# --- names, paths, encodings ----------------------------------------------------


def extension(d, x):
    return f"lower({d.get(x, r'[.]([^./]+)$', 1)})"


def source_format(d, x):
    return f"CASE {extension(d, x)} WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'docx' THEN 'docx' WHEN 'pdf' THEN 'pdf' ELSE 'unknown' END"


def media_type(d, x):
    return f"CASE {extension(d, x)} WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'svg' THEN 'image/svg+xml' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END"


def strip_extension(d, x):
    return d.sub(x, r"[.][^.\\/]+$", "")


def strip_variant(d, x):
    return d.sub(x, r"(?i)[.]include-images$", "")


def match_key(d, x):
    x = d.replace(f"lower({strip_variant(d, strip_extension(d, x))})", "\\", "/")
    return d.sub(d.sub(x, "[^a-z0-9/]+", "-"), "^-+|-+$", "")


def file_name(d, x):
    return d.item(d.keep(d.split(d.replace(x, "\\", "/"), "/"), "p", "p NOT IN ('', '.', '..')"), -1)


def package_target(d, x):
    return f"CASE WHEN substr({x}, 1, 1) = '/' THEN substr({x}, 2) WHEN substr({x}, 1, 5) = 'word/' THEN {x} ELSE concat('word/', {x}) END"


def heading_style(d, x):
    digits = d.whole(f"substr({d.sub(x, '[^0-9]', '')}, 1, 3)")
    return f"CASE WHEN substr(lower({x}), 1, 7) = 'heading' THEN coalesce(least(6, greatest(1, {digits})), 1) END"


def report_name(d, x, host):
    stem = d.sub(d.sub(strip_extension(d, x), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return f"concat({stem}, '-vs-', {host}, '.html')"


def url_host(d, x):
    return d.get(x, "^https?://([^/?#:]+)", 1)


def data_uri(d, x):
    return f"concat('data:text/plain;base64,', {d.base64(x)})"


def fuzzy_score(d, x, query):
    low = f"lower({x})"
    size = d.octets(low)
    follows = ".*".join(query)
    return f"CAST(CASE WHEN {low} = '{query}' THEN 10000 WHEN substr({low}, 1, {len(query)}) = '{query}' THEN 5000 - {size} WHEN {d.contains(low, d.text(' ' + query))} THEN 3000 - {size} WHEN {d.contains(low, d.text(query))} THEN 1000 - {size} WHEN {d.like(low, '(?s)' + follows)} THEN 100 ELSE 0 END AS BIGINT)"


# --- HTML -----------------------------------------------------------------------


def strip_tags(d, x):
    return d.sub(x, "<[^>]*>", "")


def visible_text(d, x):
    x = d.sub(x, r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>", "")
    x = d.sub(x, r"(?i)<(?:br|/p|/h[1-6]|/li|/div|/tr)\b[^>]*>", "\n")
    return clean_text(d, strip_tags(d, x))


def page_title(d, x):
    return squeeze(d, unescape(d, d.get(x, r"(?is)<title[^>]*>(.*?)</title", 1)))


def article(d, x):
    return d.get(x, r"(?is)<article[^>]*>(.*)</article>", 1)


def attribute(d, x, name):
    return d.get(x, rf'(?i)\b{name}="([^"]*)"', 1)


def tag_name(d, x):
    return f"lower({d.get(x, '^</?([A-Za-z][A-Za-z0-9]*)', 1)})"


def escape_html(d, x):
    return d.replace(d.replace(d.replace(x, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def escape_attribute(d, x):
    return d.replace(escape_html(d, x), '"', "&quot;")


# --- colours and geometry ------------------------------------------------------------


def hex_channel(d, x, k):
    return d.hex(f"substr({x}, {2 + 2 * k}, 2)")


def luminance(d, x):
    return d.div(f"({hex_channel(d, x, 0)} * 299 + {hex_channel(d, x, 1)} * 587 + {hex_channel(d, x, 2)} * 114)", "1000")


def neutral(d, x):
    r, g, b = (hex_channel(d, x, k) for k in range(3))
    return f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}) <= 6)"


def _byte(x):
    return f"floor(least(1.0, greatest(0.0, {x})) * 255 + 0.5)"


def rgb(d, r, g, b):
    return f"concat('#', {', '.join(d.hex2(_byte(x)) for x in (r, g, b))})"


def cmyk(d, c, m, y, k):
    return rgb(d, *(f"(1 - least(1.0, {x} + {k}))" for x in (c, m, y)))


def normalized_rotation(d, x):
    turn = f"({x} % 360)"
    return f"CASE WHEN {turn} > 180 THEN {turn} - 360 WHEN {turn} <= -180 THEN {turn} + 360 ELSE {turn} END"


def overlap_area(d, a, b):
    x = f"greatest(0.0, least({a[0]} + {a[2]}, {b[0]} + {b[2]}) - greatest({a[0]}, {b[0]}))"
    y = f"greatest(0.0, least({a[1]} + {a[3]}, {b[1]} + {b[3]}) - greatest({a[1]}, {b[1]}))"
    return f"{x} * {y}"


# --- repairs of shifted and split text ----------------------------------------------

#: Codes 0x21 to 0x61 and what stands 29 above them.
SHIFTED = "".join(map(chr, range(0x21, 0x62)))
UNSHIFTED = "".join(map(chr, range(0x21 + 29, 0x62 + 29)))
#: Literal repairs in their order.
SYMBOLS = (("Ł", "•"), ("––", "......"), (">&", "("), (">'", ")"))
SPLIT_WORDS = (("h a r m o n i c", "harmonic"),)


#: Word endings that follow their hyphen, words split after a capital, words run together.
HYPHENATED = ("down", "wise", "frame", "phase", "committee")
SPLIT_CAPITALS = (
    ("D igital", "Digital"), ("D imming", "Dimming"), ("D im ming", "Dimming"), ("C ommunication", "Communication"), ("P rotocol", "Protocol"), ("o ther", "other"),
    ("overDigital", "over Digital"), ("Read igital Dimming", "Read Digital Dimming"), ("Read igital", "Read Digital"), ("DigitalDimming", "Digital Dimming"),
    ("level D, returns", "level, returns"), ("levelD , returns", "level, returns"), ("levelD, returns", "level, returns"), ("level D I returns", "level, returns"),
    ("level DI returns", "level, returns"), ("levelD I returns", "level, returns"), ("levelDI returns", "level, returns"), ("between0-200", "between 0-200"), ("0 - 200", "0-200"),
)
JOINED_PROSE = (
    ("purpose ofthis", "purpose of this"), ("Regulationis", "Regulation is"), ("ensurea", "ensure a"), ("elementsand", "elements and"), ("solutionsshould", "solutions should"),
    ("definedas", "defined as"), ("byor", "by or"), ("of the productwith", "of the product with"), ("productwith", "product with"), ("behalf ofthe", "behalf of the"),
    ("elementsconcerned", "elements concerned"), ("concerned I the", "concerned, the"), ("Union™s", "Union's"), ("EU™s", "EU's"), ("user™s", "user's"),
    ("manufacturer™s", "manufacturer's"), ("aservicedeveloped", "a service developed"), ("within thescope", "within the scope"), ("withinthescope", "within the scope"), ("scope ofthis", "scope of this"),
)


def hyphenated(d, x):
    return d.sub(d.sub(x, f"- ({'|'.join(HYPHENATED)})", r"-\1"), f" -({'|'.join(HYPHENATED)})", r"-\1")


def unshift(d, x):
    return f"translate({x}, {d.text(SHIFTED)}, {d.text(UNSHIFTED)})"


def shift_wins(d, score, other, gain):
    return f"CASE WHEN {other} >= {score} + {gain} THEN 'shifted' ELSE 'plain' END"


def literal(d, x, table):
    for old, new in table:
        x = d.replace(x, old, new)
    return x


def shifted_number(d, x):
    return f"CASE WHEN {d.like(x, '^[M-V]+(?:I[M-V]+)?$')} THEN replace(translate({x}, 'MNOPQRSTUV', '0123456789'), 'I', ',') ELSE {x} END"


def fiscal_period(d, x):
    return d.sub(x, r"\be([0-9])[(](Q[0-9])", r"H\1(\2")


def number_markers(d, x):
    return d.sub(x, "Œ([0-9]+)Œ", r"– \1 –")


# --- boxes, rules, matrices -------------------------------------------------------

#: The page that boxes are measured against.
PAGE_WIDTH, PAGE_HEIGHT = 612, 792


def dark(d, colour):
    return f"({luminance(d, colour)} < 48)"


def hairline(d, fill, stroke, w, h):
    """A dark horizontal hairline: filled, not stroked, 40 wide and 1.5 high at most."""
    return f"coalesce({stroke} IS NULL AND {fill} IS NOT NULL AND {dark(d, fill)} AND {w} >= 40 AND {h} <= 1.5, false)"


def long_rule_above(d, a, b, page_height=PAGE_HEIGHT):
    """Whether rule b (x, y, w, h) runs above the right end of the short hairline a."""
    gap = f"(({page_height} - {a}.y - {a}.h) - ({page_height} - {b}.y - {b}.h))"
    return f"({gap} BETWEEN 6 AND 24 AND {b}.w >= 3.5 * {a}.w AND {b}.w >= 320 AND {a}.x >= {b}.x + 0.75 * {b}.w AND {a}.x + {a}.w <= {b}.x + {b}.w + 80 AND {a}.x <= {b}.x + {b}.w + 8)"


def in_header(a, page_height=PAGE_HEIGHT):
    return f"({page_height} - {a}.y - {a}.h <= 0.16 * {page_height} AND {a}.w <= 180)"


def container(d, fill, stroke, w, h):
    return f"({fill} IS NOT NULL AND {stroke} IS NULL AND {w} * {h} >= {PAGE_WIDTH * PAGE_HEIGHT} * 0.015 AND {w} >= {PAGE_WIDTH} * 0.12 AND {h} >= {PAGE_HEIGHT} * 0.035)"


def content_image(d, y, w, h, page_width=PAGE_WIDTH, page_height=PAGE_HEIGHT):
    """An image that is part of the text: neither small nor a mark in the header."""
    page = page_width * page_height
    return f"({w} >= 24 AND {h} >= 18 AND NOT ({w} * {h} < {page} * 0.01 AND {w} < {page_width} * 0.22) AND (greatest(0, {page_height} - {y} - {h}) >= 72 OR {w} * {h} >= {page} * 0.04))"


def background(d, fill, stroke, w, h, page_width=PAGE_WIDTH, page_height=PAGE_HEIGHT):
    return f"({fill} IS NOT NULL AND {stroke} IS NULL AND {w} >= {page_width} * 0.95 AND {h} >= {page_height} * 0.95)"


def black_box(d, fill, stroke, w, h, page_width=PAGE_WIDTH, page_height=PAGE_HEIGHT):
    return f"({fill} IN ('#000000', '#000') AND {stroke} IS NULL AND {w} >= 6 AND {h} >= 8 AND NOT {background(d, fill, stroke, w, h, page_width, page_height)})"


def white_box(d, fill, stroke, w, h):
    return f"({fill} IN ('#ffffff', '#fff') AND {stroke} IS NULL AND {w} >= 3 AND {h} >= 3)"


def holds_box(d, a, b):
    """Whether box a (x, y, w, h) holds box b, within 1.5 points, b being no larger."""
    return f"({b}.x + 1.5 >= {a}.x AND {b}.y + 1.5 >= {a}.y AND {b}.x + {b}.w <= {a}.x + {a}.w + 1.5 AND {b}.y + {b}.h <= {a}.y + {a}.h + 1.5 AND {b}.w <= {a}.w AND {b}.h <= {a}.h)"


def line_width(m, width):
    """The width of a line under a matrix (a, b, c, d, e, f): by its larger scale, 0.01 at least."""
    a, b, c, d_, _, _ = m
    return f"{width} * greatest(sqrt({a} * {a} + {b} * {b}), sqrt({c} * {c} + {d_} * {d_}), CAST(0.01 AS DOUBLE))"


def plausible_anchor(d, a, page_width=PAGE_WIDTH):
    return f"({a} BETWEEN 0.35 * {page_width} AND 0.68 * {page_width})"


def anchor_inside(d, anchors, x, width, font="12", page_width=PAGE_WIDTH):
    """The least anchor of a right column that lies inside a segment; null without any."""
    fits = d.keep(anchors, "a", f"{plausible_anchor(d, 'a', page_width)} AND a > {x} + 0.22 * {page_width} AND a < {x} + {width} - 2 * {font}")
    return d.smallest(fits)


def wide_clip(d, w, h):
    return f"({w} >= 100 AND {h} >= 20 AND {w} / greatest({h}, 1.0) >= 3)"


def times(m, n):
    """The product of two matrices (a, b, c, d, e, f), n applied first."""
    (a, b, c, d, e, f_), (o, p, q, r, s_, t) = m, n
    return (f"({a} * {o} + {c} * {p})", f"({b} * {o} + {d} * {p})", f"({a} * {q} + {c} * {r})", f"({b} * {q} + {d} * {r})", f"({a} * {s_} + {c} * {t} + {e})", f"({b} * {s_} + {d} * {t} + {f_})")


def moved(m, x, y):
    return f"({m[0]} * {x} + {m[2]} * {y} + {m[4]})", f"({m[1]} * {x} + {m[3]} * {y} + {m[5]})"


def moved_box(m, x, y, w, h):
    """left, bottom, width, height of the box around a moved box."""
    corners = [moved(m, a, b) for a in (x, f"({x} + {w})") for b in (y, f"({y} + {h})")]
    xs, ys = ", ".join(c[0] for c in corners), ", ".join(c[1] for c in corners)
    return f"least({xs})", f"least({ys})", f"(greatest({xs}) - least({xs}))", f"(greatest({ys}) - least({ys}))"


def advance(d, text, width, char_space, word_space, scaling, scale_x):
    """Points that a shown text moves on: its width, a space after each character but the last, and one for each space sign."""
    spacing = f"(greatest({d.chars(text)} - 1, 0) * {char_space} + ({d.chars(text)} - {d.chars(d.replace(text, ' ', ''))}) * {word_space})"
    return f"(({width} + {spacing}) * greatest({scaling} / 100.0, 0.01) * {scale_x})"


def drawn_line(x1, y1, x2, y2, width):
    """left, bottom, width, height of a drawn line as a box; null where it is slanted or too short."""
    thick = f"greatest({width}, 0.25)"
    level, upright = f"(abs({y1} - {y2}) < 0.1)", f"(abs({x1} - {x2}) < 0.1)"
    pick = lambda a, b: f"CASE WHEN {level} THEN CASE WHEN abs({x1} - {x2}) >= 0.25 THEN {a} END WHEN {upright} AND abs({y1} - {y2}) >= 0.25 THEN {b} END"
    return pick(f"least({x1}, {x2})", f"{x1} - {thick} / 2"), pick(f"{y1} - {thick} / 2", f"least({y1}, {y2})"), pick(f"abs({x1} - {x2})", thick), pick(thick, f"abs({y1} - {y2})")
