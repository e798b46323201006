r"""Personal data: patterns propose spans, checksums confirm, context words score.

Everything is Spark SQL expressions over one row at a time: no shuffle.
Per kind, ``regexp_extract_all`` gives the leftmost non-overlapping matches and a
split at the same pattern the gaps before them, from whose lengths the code point
offsets follow; only texts that can have a match are looked through. Patterns are the plain ones with possessive quantifiers and a
look-behind where that cannot change a match, so that long runs stay linear and
off the Java stack.

Kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to
15 digits) are the base kinds and are always reported. The method adds ``iban``
(mod-97), ``ssn`` (3-2-4 digits) and ``secret`` (keys of well-known shapes, and long
values given to a name such as token or password). An iban is tried at every place that looks
like its start, and ends at a word's end: the one at its country's length, else the
last one within 34 signs or, for a country that isn't in IBAN_LENGTHS, the last one
that passes. A span's score, 0 to 100, is its kind's prior, moved up when one of the
kind's context words stands within CONTEXT code points before or after it (between
it and the kind's next match; before it alone for an iban) and down by DOUBT when
none does; added kinds are reported from a score of MIN_SCORE, base kinds at any
score, and ``scores`` tells them apart.

Offsets are running sums over blocks of BLOCK matches, so that the work grows with
the matches alone.

Defined cases: a null text is empty and has no spans; repeated rows are answered
one by one; an empty table gives an empty result; other columns are ignored by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.session import table

CONTEXT = 40
MIN_SCORE = 50
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    #: Java pattern without capturing groups.
    pattern: str
    #: A cheap pattern without which there is no match.
    needs: str
    prior: int
    context: str


#: Kinds in the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90, r"\b(?:mail|email|e-mail|contact|write)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9][.][0-9]", 60, r"\b(?:ip|address|host|server|ping)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]", 80, r"\b(?:card|visa|credit|debit|mastercard|amex)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]", 70, r"\b(?:phone|tel|call|mobile|fax)\b"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "[A-Z]{2}[0-9]{2}", 80, r"\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[0-9]-[0-9]{2}-[0-9]", 40, r"\b(?:ssn|social security|tax id)\b"),
    Kind(
        "secret",
        r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|(?i:api_?key|secret|token|passw(?:or)?d|pwd)[\"\x27]?\x20?[:=]\x20?[\"\x27]?[A-Za-z0-9+/_.-]{16,}",
        "[:=AgsxP](?:(?<=[:=])\\x20?[\"\\x27]?[A-Za-z0-9+/_.-]{16}|(?<=A)(?:KIA|SIA|Iza)|(?<=g)h[pousr]_|(?<=s)k-|(?<=x)ox[abprs]-|(?<=P)RIVATE KEY)", 80, r"\b(?:key|secret|token|password|credentials?)\b",
    ),
)
#: ISO 13616 lengths by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
BASE = ("email", "ip", "card", "phone")
BOOST, DOUBT = 30, 10


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.when(c.try_cast("int") >= 5, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces passes mod-97."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).when(c == "", acc).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,score:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _score(kind: Kind, near: Column) -> Column:
    return F.least(F.lit(100), F.lit(kind.prior) + F.when(F.lower(near).rlike(kind.context), BOOST).otherwise(-DOUBT))


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind,start,end,score>> of a kind, in text order."""
    found = F.regexp_extract_all(text, F.lit("(" + kind.pattern + ")"), F.lit(1))
    # What stands before each match; the tail after the last one has no match and goes.
    gaps = F.split(text, kind.pattern, -1)
    zero, none = F.lit(0), F.array().cast(_SPANS)
    state = lambda at, i: F.struct(at.alias("at"), i.alias("i"), none.alias("spans"))

    def fold(every: Column, some: Column, start: Column) -> Column:
        """The spans of some of the matches, from a position and a number on."""

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["g"])
            end = at + F.length(x["m"])
            after = F.coalesce(F.left(F.get(every, acc["i"] + 1)["g"], F.lit(CONTEXT)), F.substring(text, end + 1, F.lit(CONTEXT)))
            score = _score(kind, F.concat(F.right(x["g"], F.lit(CONTEXT)), F.lit(" "), after))
            keep = F.coalesce(_valid(kind.name, x["m"]), F.lit(False))
            if kind.name not in BASE:
                keep = keep & (score >= MIN_SCORE)
            one = F.struct(F.lit(kind.name).alias("kind"), at.alias("start"), end.alias("end"), score.alias("score"))
            return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(keep, F.array_append(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(some, start, step, lambda acc: acc["spans"])

    def in_blocks(every: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(every) - 1) / BLOCK).cast("int"))
        block = lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda a, x: a + F.length(x["m"]) + F.length(x["g"])))
        start = lambda sums, b: state(F.aggregate(F.slice(sums, F.lit(1), b), zero, lambda a, x: a + x), b * BLOCK)
        return _let(sums, lambda sums: F.flatten(F.transform(blocks, lambda b: fold(every, block(b), start(sums, b)))))

    both = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda x: x["m"].isNotNull())
    folded = _let(both, lambda z: F.when(F.size(z) <= BLOCK, fold(z, z, state(zero, zero))).otherwise(in_blocks(z)))
    return F.when(text.rlike(kind.needs), folded).otherwise(none)


def _iban_spans(kind: Kind, text: Column) -> Column:
    """As ``_spans``; a match that fails is tried with its other ends, and what it ran over is read again."""
    head, rest = kind.pattern[: kind.pattern.index("(?:")], kind.pattern[kind.pattern.index("(?:") :]
    # Every place that looks like a start, with the longest match from there; only the start is used up.
    found = F.regexp_extract_all(text, F.lit(f"(?=({kind.pattern})){head}"), F.lit(1))
    gaps = F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?){head}(?={rest})"), F.lit(1))
    spans = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.lit("").alias("seen"), spans.alias("spans"))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def best(m: Column) -> Column:
        """Length of the span that starts the match, 0 if there is none."""
        words = F.split(m, " ")
        ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
        passed = F.filter(ends, lambda e: F.coalesce(_valid("iban", e), F.lit(False)))
        own = F.try_element_at(lengths, F.substring(m, 1, 2))
        of_country = F.filter(passed, lambda e: F.length(F.replace(e, F.lit(" "), F.lit(""))) == own)
        others = F.when(own.isNull(), passed).otherwise(F.filter(passed, lambda e: e == m))
        return F.coalesce(F.length(F.try_element_at(of_country, F.lit(-1))), F.length(F.try_element_at(others, F.lit(-1))), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        m, seen = x["m"], F.right(F.concat(acc["seen"], x["g"]), F.lit(CONTEXT))
        at = acc["at"] + F.length(x["g"])
        size = F.when(at >= acc["free"], best(m)).otherwise(0)
        score = _score(kind, seen)
        keep = (size > 0) & (score >= MIN_SCORE)
        one = F.struct(F.lit(kind.name).alias("kind"), at.cast("int").alias("start"), (at + size).cast("int").alias("end"), score.alias("score"))
        return F.struct((at + 4).alias("at"), F.when(keep, at + size).otherwise(acc["free"]).alias("free"), F.concat(seen, F.left(m, F.lit(4))).alias("seen"), F.when(keep, F.array_append(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    folded = F.aggregate(F.arrays_zip(found.alias("m"), gaps.alias("g")), start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(kind.needs), folded).otherwise(spans)


#: What all patterns but some of ``secret`` have: two digits in a row or with a sign between them, or one after a plus, a value after a colon or an equals sign, the end of a key's prefix.
_MAY = r"[0-9+:=_-](?:(?<=[0-9])[\x20.-]?[0-9]|(?<=[+])[0-9]|(?<=[:=])\x20?[\"\x27]?[A-Za-z0-9+/_.-]{16}|(?<=gh[pousr]_)|(?<=sk-)|(?<=xox[abprs]-))"
#: What else has to stand in a text with a span.
_MAY_HOLD = ("@", "KIA", "SIA", "Iza", "PRIVATE KEY")


def _may(text: Column) -> Column:
    """Whether any kind's ``needs`` can hold: most texts are looked through once."""
    out = text.rlike(_MAY)
    for part in _MAY_HOLD:
        out = text.contains(part) | out
    return out


def _all_spans(text: Column) -> Column:
    every = F.concat(*(_iban_spans(k, text) if k.name == "iban" else _spans(k, text) for k in KINDS))
    return F.when(_may(text), every).otherwise(F.array().cast(_SPANS))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and spans array<struct<kind,start,end,score>> by kind, then start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.select("doc_id", text.alias("text"))
    every = _all_spans(F.col("text"))
    # Generate is a barrier: the spans are made once, however often they are used.
    return parts.select("doc_id", "text", F.explode(F.array(every)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``[KIND]``; overlapping spans become one, named after the first; n_chars follows the new text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = F.array_sort(F.transform(_all_spans(text), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    names = docs.columns
    marked = docs.select("*", F.explode(F.array(every)).alias("__docstrata_spans"))
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"])
        end = F.greatest(acc["at"], -s["back"])
        return F.struct(F.when(inside, end).otherwise(-s["back"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"))

    clean = F.when(F.size("__docstrata_spans") > 0, F.aggregate("__docstrata_spans", init, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))).otherwise(F.col("text"))
    out = marked.withColumn("text", clean).drop("__docstrata_spans")
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def _sql_kind(name: str, pattern: str, keep: str) -> str:
    order = [k.name for k in KINDS].index(name)
    kind = KINDS[order]
    near = "ctx" if name == "iban" else "ctx || ' ' || aft"
    return rf"""{name} AS (
  SELECT rid, count(*) AS n, list(struct_pack(o := {order}, s := s, k := '{name}:' || s || ':' || (s + length(m)), c := CAST(score AS VARCHAR))) AS spans FROM (
    SELECT *, least(100, {kind.prior} + CASE WHEN regexp_matches(lower({near}), '{kind.context}') THEN {BOOST} ELSE -{DOUBT} END) AS score FROM (
      SELECT rid, m, ctx, s, CASE WHEN i < total THEN left(nxt, {CONTEXT}) ELSE substr(text, s + length(m) + 1, {CONTEXT}) END AS aft FROM (
        SELECT rid, text, i, len(ms) AS total, ms[i] AS m, right(gs[i], {CONTEXT}) AS ctx, gs[i + 1] AS nxt,
             CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS s
        FROM (SELECT rid, text, gs, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT rid, text, regexp_extract_all(text, '(?s)(.*?)({pattern})', 1) AS gs, regexp_extract_all(text, '(?s)(.*?)({pattern})', 2) AS ms FROM d))))
  ) WHERE {keep} GROUP BY rid)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 % 10 + CAST(CAST(c AS INT) >= 5 AS INT) END)) % 10 = 0"
_BARE = "replace(m, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"
SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),\n"
    + ",\n".join(
        (
            _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _sql_kind("ip", r"[0-9]+(?:\.[0-9]+){3}", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || ltrim(p, '0')[1:3] AS INT) <= 255))"),
            _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
            _sql_kind("phone", KINDS[3].pattern, f"length({_DIGITS}) BETWEEN 8 AND 15"),
            _sql_kind("iban", KINDS[4].pattern, f"length({_BARE}) BETWEEN 15 AND 34 AND {_MOD97}"),
            _sql_kind("ssn", KINDS[5].pattern, f"score >= {MIN_SCORE}"),
            _sql_kind("secret", KINDS[6].pattern, f"score >= {MIN_SCORE}"),
        )
    )
    + """
SELECT d.doc_id, coalesce(email.n, 0) AS n_email, coalesce(ip.n, 0) AS n_ip, coalesce(card.n, 0) AS n_card, coalesce(phone.n, 0) AS n_phone,
  sha256(coalesce(array_to_string(list_transform(list_sort(list_concat(list_concat(email.spans, ip.spans), list_concat(card.spans, phone.spans))), lambda x: x.k), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(every, lambda x: x.k), ','), '') AS spans, coalesce(array_to_string(list_transform(every, lambda x: x.c), ','), '') AS scores
FROM (SELECT d.rid, list_sort(list_concat(list_concat(list_concat(list_concat(email.spans, ip.spans), list_concat(card.spans, phone.spans)), list_concat(iban.spans, ssn.spans)), secret.spans)) AS every
  FROM d LEFT JOIN email USING (rid) LEFT JOIN ip USING (rid) LEFT JOIN card USING (rid) LEFT JOIN phone USING (rid) LEFT JOIN iban USING (rid) LEFT JOIN ssn USING (rid) LEFT JOIN secret USING (rid)) e
JOIN d USING (rid) LEFT JOIN email USING (rid) LEFT JOIN ip USING (rid) LEFT JOIN card USING (rid) LEFT JOIN phone USING (rid)
"""
)
