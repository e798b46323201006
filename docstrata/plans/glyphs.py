"""Text out of codes and outlines: decoding with counters, and glyphs told by their outline.

A word is a string of codes. A code of two signs is known if it is a pair of letters of
``benchmark``, one of a single sign if it is a small letter up to m; the longest known
code is read first. Of the rest, digits have a predefined meaning, the signs of a
sentence none, and what is left is given raw.
"""

from __future__ import annotations

from docstrata.functions.dialect import SPARK
from docstrata.plans.catalogue import _lines, _register

def _known(d) -> str:
    """code, its text: pairs of letters, each once."""
    if d is SPARK:
        rows = "SELECT DISTINCT code FROM (SELECT explode(transform(sequence(1, greatest(1, length(text) - 1)), i -> substr(text, i, 2))) AS code FROM @benchmark WHERE text IS NOT NULL)"
    else:
        rows = "SELECT DISTINCT code FROM (SELECT unnest(list_transform(range(1, greatest(1, length(text) - 1) + 1), lambda i: substr(text, i, 2))) AS code FROM @benchmark WHERE text IS NOT NULL)"
    return f"SELECT code, upper(substr(code, 1, 1)) AS shown FROM ({rows}) r WHERE {d.like('code', '^[a-z]{2}$')} AND substr(code, 1, 1) <> substr(code, 2, 1)"


def _decoded(d) -> str:
    """Per document: how many codes were read in each way, and the text."""
    single = "CASE WHEN {c} BETWEEN 'a' AND 'm' THEN 'm' WHEN {c} BETWEEN '0' AND '9' THEN 'f' WHEN {c} IN ('.', ',', ';', ':') THEN 'n' ELSE 'r' END"
    if d is SPARK:
        # At most 650 codes are known, so all are one pattern, which eats a line from the left as the decoder does; each shows one letter.
        firsts = f"SELECT concat(substr(code, 1, 1), '[', array_join(array_sort(collect_set(substr(code, 2, 1))), ''), ']') AS some FROM ({_known(d)}) k GROUP BY substr(code, 1, 1)"
        pattern = f"(SELECT coalesce(concat('(?:', nullif(array_join(array_sort(collect_list(some)), '|'), ''), ')'), '(?!)') FROM ({firsts}) f)"
        rest = f"SELECT doc_id, length(line) AS n, regexp_replace(line, {pattern}, '') AS left FROM ({_lines(d)}) l WHERE line <> ''"
        count = lambda signs: f"length(left) - length(regexp_replace(left, '[{signs}]', ''))"
        ways = f"SELECT doc_id, (n - length(left)) div 2 AS pairs, length(left) AS single, {count('a-m')} AS known, {count('0-9')} AS fallback, {count('.,;:')} AS notdef FROM ({rest}) r"
        return f"SELECT doc_id, CAST(sum(pairs + known) AS BIGINT) AS mapped, CAST(sum(fallback) AS BIGINT) AS fallback, CAST(sum(notdef) AS BIGINT) AS notdef, CAST(sum(single - known - fallback - notdef) AS BIGINT) AS raw, CAST(sum(pairs + single - notdef) AS BIGINT) AS n_shown FROM ({ways}) w GROUP BY doc_id"
    signs = f"SELECT doc_id, line_no, i, string_split(line, '')[i] AS c, string_split(line, '')[i + 1] AS c2 FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM ({_lines(d)}) l WHERE line <> '')"
    return f"""WITH k AS ({_known(d)}), s AS (SELECT s.*, k.shown FROM ({signs}) s LEFT JOIN k ON k.code = c || c2),
    g AS (SELECT *, max(CASE WHEN shown IS NULL THEN i END) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS gap FROM s),
    t AS (SELECT *, shown IS NOT NULL AND (i - coalesce(gap, 0)) % 2 = 1 AS taken FROM g),
    u AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY doc_id, line_no ORDER BY i), false) AS gone, {single.format(c='c')} AS kind FROM t),
    v AS (SELECT *, CASE WHEN taken THEN 'T' ELSE kind END AS k FROM u WHERE NOT gone)
    SELECT doc_id, count(*) FILTER (k IN ('T', 'm')) AS mapped, count(*) FILTER (k = 'f') AS fallback, count(*) FILTER (k = 'n') AS notdef, count(*) FILTER (k = 'r') AS raw,
      CAST(sum(length(CASE k WHEN 'T' THEN shown WHEN 'n' THEN '' ELSE c END)) AS BIGINT) AS n_shown FROM v GROUP BY doc_id"""


_register("g23_m31_decode_counts", _decoded)


def _outlines(d) -> str:
    """An order is a glyph, its lines are the commands of its outline; the priority of orders that are done is what they show."""
    step = "concat(CASE WHEN l_returnflag = 'A' THEN 'M' WHEN l_returnflag = 'N' THEN 'L' ELSE 'Q' END, CAST(CAST(round(l_quantity / 8) AS BIGINT) AS VARCHAR(12)), ',', CAST(CAST(round(l_tax * 20) AS BIGINT) AS VARCHAR(12)))"
    if d is SPARK:
        made = f"array_join(transform(array_sort(collect_list(struct(l_linenumber, {step} AS step))), s -> s.step), ' ')"
    else:
        made = f"string_agg({step}, ' ' ORDER BY l_linenumber, {step})"
    text = "CASE WHEN o_custkey % 5 = 0 THEN substr(o_orderpriority, 1, 2) ELSE substr(o_orderpriority, 1, 1) END"
    glyphs = f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN {text} END AS text, signature FROM @orders JOIN (SELECT l_orderkey, md5({made}) AS signature FROM @lineitem GROUP BY l_orderkey) g ON o_orderkey = l_orderkey"
    # One row for each outline that all known glyphs of one sign agree on; the many glyphs of a frequent outline meet that row.
    agreed = f"SELECT signature, min(text) AS text FROM ({glyphs}) k WHERE length(text) = 1 GROUP BY signature HAVING count(DISTINCT text) = 1"
    return f"SELECT u.o_orderkey, a.text FROM ({glyphs}) u JOIN ({agreed}) a ON u.signature = a.signature WHERE u.text IS NULL"


_register("u08_outline_signatures", _outlines)
