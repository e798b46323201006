"""Repair of shifted words and lines, on words of the documents that Spark shifts itself.

Word ``i`` of a line stays, or all its codes or only its digits are set off by 29, or it
gets shifted signs around it, by ``i % 6``; what the repair gives is compared with SQL
that walks rows with windows where the plan keeps a line's words in one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import scalars as f
from docstrata.functions import shifted as s
from docstrata.functions.dialect import SPARK
from docstrata.functions.shifted_words import repairing, repairing_lines
from docstrata.plans.catalogue import QUERIES, _lines, _register
from docstrata.session import table


def _off(d, w: str, i: str) -> str:
    """The word as a broken file would give it."""
    half = s.RAISED, s.LOWERED
    up = lambda x: f"translate({x}, {d.text(half[1])}, {d.text(half[0])})"
    down = f"translate({w}, {d.text(f.UNSHIFTED)}, {d.text(f.SHIFTED)})"
    return f"""CASE {i} % 6 WHEN 1 THEN {down} WHEN 2 THEN {up(f"concat(CAST(length({w}) * 37 AS VARCHAR(12)), '.', CAST(length({w}) AS VARCHAR(12)))")} WHEN 3 THEN concat('é', {down}, '<')
      WHEN 4 THEN {up(f"concat('20', CAST(10 + length({w}) % 80 AS VARCHAR(12)), 'H')")} WHEN 5 THEN {up(f"CAST(1 + length({w}) % 2 AS VARCHAR(12))")} ELSE {w} END"""


def _broken(d) -> str:
    """doc_id, line_no, ws: the words of each line, broken."""
    if d is SPARK:
        return f"SELECT doc_id, line_no, transform(filter(split({f.squeeze(d, 'line')}, ' '), w -> w <> ''), (w, i) -> {_off(d, 'w', 'i')}) AS ws FROM ({_lines(d)})"
    return f"SELECT doc_id, line_no, list_transform(list_filter(string_split({f.squeeze(d, 'line')}, ' '), lambda w: w <> ''), lambda w, i: {_off(d, 'w', '(i - 1)')}) AS ws FROM ({_lines(d)})"


def _words(d) -> str:
    if d is SPARK:
        return f"SELECT doc_id, line_no, CAST(pos AS BIGINT) AS seq, w FROM ({_broken(d)}) LATERAL VIEW posexplode(ws) t AS pos, w"
    return f"SELECT doc_id, line_no, i - 1 AS seq, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM ({_broken(d)}))"


def _spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("docstrata_documents")
    return spark.sql(text.replace("@documents", "docstrata_documents").replace("VARCHAR(12)", "STRING"))


def shifted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's rule and repair; a batch of lines repairs each of its words once."""
    found = F.arrow_udf(repairing(), "array<struct<rule:bigint,fixed:string>>")("ws")
    return _spark(spark, sf_dir, _broken(SPARK)).select("doc_id", "line_no", F.posexplode(found).alias("pos", "r")).selectExpr("doc_id", "line_no", "CAST(pos AS BIGINT) AS seq", "r.rule", "r.fixed")


_register("f14_f15_f17_f18_f20_shifted_words", lambda d: f"SELECT doc_id, line_no, seq, CAST({s.rule(d, 'w')} AS BIGINT) AS rule, {s.word(d, 'w')} AS fixed FROM ({_words(d)}) b")
QUERIES["f14_f15_f17_f18_f20_shifted_words"] = shifted_words
_register("f25_structural_markers", lambda d: f"SELECT doc_id, line_no, {s.markers(d, 'x')} AS fixed FROM (SELECT doc_id, line_no, concat(CASE line_no % 2 WHEN 0 THEN 'E' ELSE 'Œ' END, translate(CAST(length(line) AS VARCHAR(12)), '0123456789', 'MNOPQRSTUV'), CASE line_no % 2 WHEN 0 THEN 'F ' ELSE 'Œ ' END, line, CASE line_no % 3 WHEN 0 THEN ' ... NO' ELSE '' END) AS x FROM ({_lines(d)}) l) b")
_register("f03_file_strings", lambda d: f"SELECT doc_id, line_no, {s.text(d, 'x')} AS fixed FROM (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN line WHEN 1 THEN translate(translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), {d.text(f.UNSHIFTED)}, {d.text(f.SHIFTED)}) ELSE translate(line, {d.text(f.UNSHIFTED + ' ')}, {d.text(f.SHIFTED + ' ')}) END AS x FROM ({_lines(d)}) l) b")


def _at(i: str) -> str:
    return f"coalesce(get(ws, {i}), '')"


def _connected(d) -> str:
    """C between two labels is an ampersand."""
    return f"array_join(transform(ws, (w, i) -> CASE WHEN w = 'C' AND i > 0 AND {s.label(d, _at('i - 1'))} AND {s.label(d, _at('i + 1'))} THEN '&' ELSE w END), ' ')"


def _opened(d) -> str:
    """E after a word with letters and before a word that begins with a capital is an opening parenthesis, in prose with a closing one."""
    return f"CASE WHEN {d.like('x', '(?:^| )E(?: |$)')} AND {s.opens(d, 'x', 'ws')} THEN array_join(transform(ws, (w, i) -> CASE WHEN w = 'E' AND i > 0 AND {d.like(_at('i - 1'), r'\p{L}')} AND {d.like(_at('i + 1'), r'^[^\p{L}]*\p{Lu}')} THEN '(' ELSE w END), ' ') ELSE x END"


def _spark_lines(d, joined: str = "") -> str:
    """All eleven steps in one row, without a shuffle: the words of a line in an array, its consuming pairs told by a pattern over their flags. ``joined`` names rows (doc_id, line_no, x) that are past the joins already."""
    steps: list[tuple[str, str]] = [
        ("two", f"transform(ws, (w, i) -> CASE WHEN i + 1 < size(ws) THEN {s.fiscal_two(d, 'w', _at('i + 1'))} END)"),
        ("flags", "split(regexp_replace(array_join(transform(two, t -> CASE WHEN t IS NULL THEN '-' ELSE 'x' END), ''), 'x.', 'TS'), '')"),
        ("ws", f"filter(transform(ws, (w, i) -> CASE get(flags, i) WHEN 'T' THEN get(two, i) WHEN 'S' THEN null ELSE coalesce({s.fiscal_one(d, 'w')}, w) END), w -> w IS NOT NULL)"),
        ("x", _connected(d)),
        ("x", s.joins(d, "x")),
        ("ws", "split(x, ' ')"),
        ("x", _opened(d)),
        ("x", s.spaces(d, "x")),
    ]
    out, have = f"SELECT doc_id, line_no, transform(ws, w -> {s.word(d, 'w')}) AS ws FROM ({_marked_words(d)}) m", ["ws"]
    if joined:
        out, have, steps = f"SELECT doc_id, line_no, x FROM {joined}", ["x"], steps[5:]
    for k, (name, expression) in enumerate(steps, 1):
        kept = [c for c in have if c != name]
        out = f"SELECT doc_id, line_no{''.join(f', {c}' for c in kept)}, {expression} AS {name} FROM ({out}) b{k}"
        have = [*kept, name]
    return f"SELECT doc_id, line_no, x AS fixed FROM ({out}) b"


def _marked_words(d) -> str:
    """The words of each broken line after the step before their repair."""
    return f"SELECT doc_id, line_no, filter(split({f.squeeze(d, s.markers(d, 'x'))}, ' '), w -> w <> '') AS ws FROM (SELECT doc_id, line_no, array_join(ws, ' ') AS x FROM ({_broken(d)}) b0) j"


def shifted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of every line; a batch of lines repairs each of its words once and joins what is split."""
    words = _spark(spark, sf_dir, _marked_words(SPARK))
    words.select("doc_id", "line_no", F.arrow_udf(repairing_lines(), "string")("ws").alias("x")).createOrReplaceTempView("docstrata_joined_lines")
    return spark.sql(_spark_lines(SPARK, "docstrata_joined_lines"))


def _duck_lines(d) -> str:
    """The same by rows: a word's pair is taken if an even number of pairs in a row end before it."""
    return f"""WITH a AS (SELECT doc_id, line_no, {f.squeeze(d, s.markers(d, "array_to_string(ws, ' ')"))} AS x FROM ({_broken(d)})),
    r AS (SELECT doc_id, line_no, i, string_split(x, ' ')[i] AS v FROM (SELECT *, unnest(range(1, len(string_split(x, ' ')) + 1)) AS i FROM a)),
    w AS (SELECT doc_id, line_no, i, {s.word(d, 'v')} AS v FROM r WHERE v <> ''),
    n AS (SELECT *, lead(v) OVER o AS v2 FROM w WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    p AS (SELECT *, CASE WHEN v2 IS NOT NULL THEN {s.fiscal_two(d, 'v', 'v2')} END AS two FROM n),
    q AS (SELECT *, max(CASE WHEN two IS NULL THEN i END) OVER o AS gap FROM p WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    t AS (SELECT *, two IS NOT NULL AND (i - coalesce(gap, 0)) % 2 = 1 AS taken FROM q),
    u AS (SELECT *, coalesce(lag(taken) OVER o, false) AS gone FROM t WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    f AS (SELECT doc_id, line_no, i, CASE WHEN taken THEN two ELSE coalesce({s.fiscal_one(d, 'v')}, v) END AS v FROM u WHERE NOT gone),
    c AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after FROM f WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    j AS (SELECT doc_id, line_no, string_agg(CASE WHEN v = 'C' AND coalesce({s.label(d, 'before')}, false) AND coalesce({s.label(d, 'after')}, false) THEN '&' ELSE v END, ' ' ORDER BY i) AS x FROM c GROUP BY ALL),
    k AS (SELECT doc_id, line_no, {s.joins(d, "coalesce(x, '')")} AS x FROM (SELECT doc_id, line_no FROM a) LEFT JOIN j USING (doc_id, line_no)),
    z AS (SELECT doc_id, line_no, x, i, string_split(x, ' ')[i] AS v FROM (SELECT *, unnest(range(1, len(string_split(x, ' ')) + 1)) AS i FROM k)),
    y AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after FROM z WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    e AS (SELECT doc_id, line_no, any_value(x) AS x, string_agg(CASE WHEN v = 'E' AND coalesce({d.like('before', r'\p{L}')}, false) AND coalesce({d.like('after', r'^[^\p{L}]*\p{Lu}')}, false) THEN '(' ELSE v END, ' ' ORDER BY i) AS opened FROM y GROUP BY ALL)
    SELECT doc_id, line_no, {s.spaces(d, f"CASE WHEN {s.opens(d, 'x', "string_split(x, ' ')")} THEN opened ELSE x END")} AS fixed FROM e"""


_register("f04_w15_w16_w17_shifted_lines", _duck_lines)
QUERIES["f04_w15_w16_w17_shifted_lines"] = shifted_lines


def _connectors(d) -> str:
    """Both rules alone, on lines that begin with what they change and with what they don't."""
    x = "concat(CASE line_no % 2 WHEN 0 THEN 'A1 C B22 then Sales C Marketing and profit E Loss) ' ELSE 'C A1 C b2 E Loss = ' END, line)"
    if d is SPARK:
        rows = f"SELECT doc_id, line_no, split({f.squeeze(d, x)}, ' ') AS ws FROM ({_lines(d)}) l"
        return f"SELECT doc_id, line_no, {_opened(d)} AS fixed FROM (SELECT doc_id, line_no, x, split(x, ' ') AS ws FROM (SELECT doc_id, line_no, {_connected(d)} AS x FROM ({rows}) r) c) b"
    near = "WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)"
    rows = f"SELECT doc_id, line_no, i, string_split(x, ' ')[i] AS v FROM (SELECT *, unnest(range(1, len(string_split(x, ' ')) + 1)) AS i FROM (SELECT doc_id, line_no, {f.squeeze(d, x)} AS x FROM ({_lines(d)}) l))"
    one = f"SELECT doc_id, line_no, i, CASE WHEN v = 'C' AND {s.label(d, "coalesce(lag(v) OVER o, '')")} AND {s.label(d, "coalesce(lead(v) OVER o, '')")} THEN '&' ELSE v END AS v FROM ({rows}) r {near}"
    two = f"SELECT *, CASE WHEN v = 'E' AND {d.like("coalesce(lag(v) OVER o, '')", r'\p{L}')} AND {d.like("coalesce(lead(v) OVER o, '')", r'^[^\p{L}]*\p{Lu}')} THEN '(' ELSE v END AS opened FROM ({one}) c {near}"
    return f"SELECT doc_id, line_no, CASE WHEN {s.opens(d, 'x', "string_split(x, ' ')")} THEN opened ELSE x END AS fixed FROM (SELECT doc_id, line_no, string_agg(v, ' ' ORDER BY i) AS x, string_agg(opened, ' ' ORDER BY i) AS opened FROM ({two}) t GROUP BY doc_id, line_no)"


_register("w15_w17_connectors", _connectors)
