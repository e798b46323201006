"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. The token budget goes down from the root:
at each node the children share it by weight, no child gets more than its
subtree can supply (its tokens times MAX_EPOCHS), and what one child cannot use
goes to its siblings by their weights. A node's budget is fixed by its parent
before, so shortages reach other subtrees only when the whole node is short.
The shares are closed-form water levels over the children sorted by supply per
weight, in whole numbers (rounded down; at most one token per child stays over).

A leaf takes as many whole epochs as its budget holds and, of the next epoch's
seeded order, the shortest prefix of documents that reaches the rest of the
budget. The order is that of a hash of seed, epoch and doc_id (without one: of the
text). The prefix is found without gathering a leaf: tokens are summed per leaf
and hash slice, and only the rows of the slice in which the cut falls are ordered. That gives a leaf's last hash, and every
document knows its copies from its own hash and one row a leaf: documents pass in
one narrow step, without a shuffle of texts.

Only rows that share the last hash (repeated doc_ids, or copies of one text
without any) and lie on both sides of the cut are numbered.

All is SQL expressions; only ids and token counts are shuffled, and the tree.

Defined cases: a null lang or source is the node ``?``; a null text has no
tokens; documents without tokens are never chosen; repeated rows and rows without
doc_id are chosen one by one, so that the budget holds for them too; a budget
over the whole supply takes the supply; an empty table gives an empty result;
other columns are ignored by ``select`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.session import cut, table

SEED = 17
MAX_EPOCHS = 2
#: Share of the corpus's tokens that is asked for.
BUDGET = 0.6
DOMAINS = 4
#: Weights by domain (others: 1) and language (others: 1); sources weigh alike.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
#: Slices of a leaf's epoch by the first hex digits of the hash: COARSE parts of FINE ones.
COARSE, FINE = 2, 1
#: Leaves of the tree up to which the plan (a row a leaf) is broadcast.
BROADCAST_LEAVES = 100_000
LEAF = ("domain", "lang", "source")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("bigint")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens of every document with tokens."""
    return _keyed(docs).select("doc_id", *LEAF, "tokens")


def _some() -> Column:
    return F.col("text").cast("string").rlike("[^\\x09-\\x0D ]")


def _leaf() -> dict[str, Column]:
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("?")), F.coalesce(F.col("lang").cast("string"), F.lit("?"))
    return {"domain": F.concat(F.lit("d"), F.crc32(source.cast("binary")) % DOMAINS), "lang": lang, "source": source}


def _tokens() -> Column:
    return F.size(F.split(F.trim(F.regexp_replace(F.col("text").cast("string"), "[\\x09-\\x0D ]+", " ")), " ")).cast("bigint")


def _mark() -> Column:
    """What a document is ordered by: its id, or its text's digest."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.md5(F.col("text").cast("string").cast("binary"))))


def _digest() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    made = {"doc_id": F.col("doc_id")} | _leaf() | {"tokens": _tokens(), "mark": _mark(), "digest": _digest()}
    return docs.where(_some()).select(*[c.alias(name) for name, c in made.items()])


def shares(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """nodes (parent..., name, weight, supply) with ``got``: the budget of a node's parent, shared by weight up to the supplies."""
    order = Window.partitionBy(*parent).orderBy((F.col("supply") / F.col("weight")), *[c for c in ("domain", "lang", "source") if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        nodes.withColumn("_budget", budget)
        .withColumn("_used", F.coalesce(F.sum("supply").over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # A child is full when the water level would pass its supply; the first one that is not sets the level for the rest.
    full = F.col("supply").cast("decimal(38,0)") * F.col("_left") <= (F.col("_budget") - F.col("_used")).cast("decimal(38,0)") * F.col("weight")
    rows = rows.withColumn("_full", full).withColumn("_open", F.min(F.when(~F.col("_full"), F.struct("_used", "_left"))).over(Window.partitionBy(*parent)))
    level = F.expr("cast((_budget - _open._used) * cast(weight as decimal(20,0)) as decimal(38,0)) div _open._left").cast("bigint")
    return rows.withColumn("got", F.when(F.col("_open").isNull() | (F.col("_full") & (F.col("_used") < F.col("_open._used"))) | F.col("_full"), F.col("supply")).otherwise(level)).drop("_budget", "_used", "_left", "_full", "_open")


def budgets(leaves: DataFrame, budget: float = BUDGET, epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with ``got`` tokens for each."""
    leaves = leaves.withColumn("supply", F.col("tokens") * epochs).withColumn("weight", F.lit(1).cast("bigint"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight("lang", LANG_WEIGHTS))
    domains = langs.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight("domain", DOMAIN_WEIGHTS))
    total = F.floor(F.sum("tokens").over(Window.partitionBy()) * F.lit(budget)).cast("bigint")
    top = shares(domains.withColumn("_total", total), [], F.col("_total")).select("domain", F.col("got").alias("_have"))
    mid = shares(langs.join(top, "domain"), ["domain"], F.col("_have")).select("domain", "lang", F.col("got").alias("_have"))
    return shares(leaves.join(mid, ["domain", "lang"]), ["domain", "lang"], F.col("_have")).select("domain", "lang", "source", "tokens", "got")


def _hash(whole: Column, mark: Column, seed: int) -> Column:
    """A document's place in the seeded order of the epoch that is cut."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), mark).cast("binary"))


def _met(rows: DataFrame, leaves: DataFrame, n_leaves: int, on: list[str]) -> DataFrame:
    """Rows with their leaf's columns: one row a leaf is broadcast up to BROADCAST_LEAVES of them."""
    return rows.join(F.broadcast(leaves) if n_leaves <= BROADCAST_LEAVES else leaves, on)


def _cut_slice(sums: DataFrame) -> DataFrame:
    """leaf, prefix, before: the slice in which a leaf's cut falls and the tokens ahead of it, from sums (leaf, rest, slice, n).

    A leaf has at most 16 ** COARSE parts of at most 16 ** FINE sums; the sums of each part are put together first.
    """
    leaf, zero = list(LEAF), F.lit(0).cast("bigint")
    fine = sums.groupBy(*leaf, "rest", F.substring("slice", 1, COARSE).alias("part")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("slice", "n"))).alias("slices"))
    whole = fine.groupBy(*leaf, "rest").agg(F.sort_array(F.collect_list(F.struct("part", "n", "slices"))).alias("parts"))

    def reach(parts: Column, start: Column, rest: Column) -> Column:
        """The first element up to which the sum reaches the rest, and the sum before it."""
        none = F.filter(parts, lambda x: F.lit(False))
        init = F.struct(start.alias("before"), none.alias("at"))

        def step(acc: Column, x: Column) -> Column:
            done = F.size(acc["at"]) > 0
            reached = ~done & (acc["before"] + x["n"] >= rest)
            return F.struct(F.when(done | reached, acc["before"]).otherwise(acc["before"] + x["n"]).alias("before"), F.when(reached, F.array(x)).otherwise(acc["at"]).alias("at"))

        return F.aggregate(parts, init, step)

    part = whole.select(*leaf, "rest", reach(F.col("parts"), zero, F.col("rest")).alias("c"))
    part = part.select(*leaf, "rest", F.col("c.before").alias("ahead"), F.col("c.at")[0]["slices"].alias("slices"))
    found = part.select(*leaf, "rest", reach(F.col("slices"), F.col("ahead"), F.col("rest")).alias("c"))
    return found.select(*leaf, F.col("c.at")[0]["slice"].alias("prefix"), F.col("c.before").alias("before"))


def _cuts(rows: DataFrame, budget: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame | None, int]:
    """For keyed rows: the leaves (whole epochs, last hash of the prefix or '', whether rows of that hash are split), the split keys (of which ``more`` rows get one more copy) if there are any, and the number of leaves."""
    leaf = list(LEAF)
    plan = budgets(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), budget, epochs)
    plan = cut(plan.select(*leaf, F.expr("got div tokens").alias("whole"), F.expr("got % tokens").alias("rest")))
    n = plan.count()
    met = _met(rows, plan, n, leaf).where("rest > 0").withColumn("h", _hash(F.col("whole"), F.col("mark"), seed))
    at = _cut_slice(met.groupBy(*leaf, "rest", F.substring("h", 1, COARSE + FINE).alias("slice")).agg(F.sum("tokens").alias("n")))
    inside = _met(met, at, n, leaf).where(F.expr("startswith(h, prefix)"))
    ahead = F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("h", "doc_id", "tokens", "digest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = cut(inside.withColumn("taken", F.col("before") + ahead < F.col("rest")).select(*leaf, "mark", "tokens", "digest", "h", "taken"))
    ends = inside.groupBy(*leaf).agg(F.max(F.when(F.col("taken"), F.col("h"))).alias("last"), F.min(F.when(~F.col("taken"), F.col("h"))).alias("left"))
    ends = ends.select(*leaf, "last", F.coalesce(F.col("last") == F.col("left"), F.lit(False)).alias("split"))
    leaves = cut(plan.join(ends, leaf, "left").select(*leaf, "whole", F.coalesce("last", F.lit("")).alias("last"), F.coalesce("split", F.lit(False)).alias("split")))
    split = leaves.where("split").select(*leaf, F.col("last").alias("h"))
    if split.isEmpty():
        return leaves, None, n
    return leaves, cut(inside.join(split, [*leaf, "h"], "left_semi").groupBy(*leaf, "mark", "tokens", "digest").agg(F.sum(F.col("taken").cast("bigint")).alias("more"))), n


def _more(h: Column, last: Column) -> Column:
    return F.when(h <= last, 1).otherwise(0).cast("bigint")


def select(docs: DataFrame, budget: float = BUDGET, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies (> 0) of the chosen documents."""
    rows = cut(_keyed(docs))
    return _dealt(rows, *_cuts(rows, budget, epochs, seed), seed).select("doc_id", *LEAF, "tokens", "copies")


def mix(docs: DataFrame, budget: float = BUDGET, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The chosen documents with all their columns, and ``copies`` (in place of a column of that name): row by row those of ``select``."""
    rows = cut(_keyed(docs))
    leaves, keys, n = _cuts(rows, budget, epochs, seed)
    kept = [c for c in docs.columns if c != "copies"]
    # The columns of the documents travel in one struct, out of the way of other names.
    packed = docs.where(_some()).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *[c.alias(name) for name, c in _leaf().items()], _mark().alias("mark"), F.col("text").cast("string").alias("text"))
    return _dealt(packed, leaves, keys, n, seed).select(*[F.col("row")[c].alias(c) for c in kept], "copies")


def _dealt(rows: DataFrame, leaves: DataFrame, keys: DataFrame | None, n: int, seed: int) -> DataFrame:
    """Rows (leaf, mark, and tokens and digest or the text) that are chosen, with their copies."""
    leaf = list(LEAF)
    met = _met(rows, leaves, n, leaf).withColumn("h", _hash(F.col("whole"), F.col("mark"), seed))
    copies = (F.col("whole") + _more(F.col("h"), F.col("last"))).alias("copies")
    on_cut = F.col("split") & (F.col("h") == F.col("last"))
    plain = met.where(~on_cut).select(*rows.columns, copies).where("copies > 0")
    if keys is None:
        return plain
    edge = met.where(on_cut)
    if "digest" not in rows.columns:
        edge = edge.withColumns({"tokens": _tokens(), "digest": _digest()})
    key = [*leaf, "mark", "tokens", "digest"]
    edge = edge.join(keys, key)
    # Of the rows of one key, which are copies of one text, so many get one copy more; their other columns make the order.
    order = F.xxhash64(*([F.to_json("row")] if "row" in rows.columns else [F.lit(0)]))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    copies = (F.col("whole") + F.when(number <= F.col("more"), 1).otherwise(0)).cast("bigint").alias("copies")
    return plain.unionByName(edge.select(*rows.columns, copies).where("copies > 0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"))


def _sql_weight(column: str, weights: dict[str, int]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _sql_shares(name: str, nodes: str, parent: str, own: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_a AS (SELECT *, coalesce(sum(supply) OVER o, 0) AS used, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER o, 0) AS lft FROM ({nodes})
  WINDOW o AS ({part} ORDER BY supply / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT *, CAST(supply AS HUGEINT) * lft <= (have - used) * CAST(weight AS HUGEINT) AS isfull FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT isfull THEN used END) OVER ({part}) AS used0, max(CASE WHEN NOT isfull THEN lft END) OVER ({part}) AS lft0 FROM {name}_b),
{name} AS (SELECT *, CAST(CASE WHEN isfull THEN supply ELSE ((have - used0) * CAST(weight AS HUGEINT)) // lft0 END AS BIGINT) AS got FROM {name}_c)"""


SQL = rf"""
WITH k AS (
  SELECT doc_id, 'd' || (crc % {DOMAINS}) AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, tokens, coalesce(CAST(doc_id AS VARCHAR), '?' || md5(text)) AS mark FROM (
    SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 8 * length(coalesce(source, '?')) + 1), lambda i: CAST(((ascii(substr(coalesce(source, '?'), CAST((i - 1) // 8 + 1 AS INT), 1)) >> CAST((i - 1) % 8 AS INT)) & 1) AS BIGINT))),
        lambda c, b: xor(c >> 1, CASE WHEN ((c & 1) + b) % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)) AS raw,
      xor(raw, CAST(4294967295 AS BIGINT)) AS crc,
      CAST(len(regexp_extract_all(text, '[^\x09-\x0D ]+')) AS BIGINT) AS tokens FROM documents)
  WHERE tokens > 0
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS supply FROM k GROUP BY ALL),
langs AS (SELECT domain, lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(supply) AS BIGINT) AS supply, {_sql_weight("lang", LANG_WEIGHTS)} AS weight FROM leaves GROUP BY domain, lang),
domains AS (SELECT domain, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(supply) AS BIGINT) AS supply, {_sql_weight("domain", DOMAIN_WEIGHTS)} AS weight FROM langs GROUP BY domain),
{_sql_shares("top", f"SELECT *, CAST(floor((SELECT sum(tokens) FROM domains) * CAST({BUDGET} AS DOUBLE)) AS BIGINT) AS have FROM domains", "", "domain")},
{_sql_shares("mid", "SELECT langs.*, top.got AS have FROM langs JOIN top USING (domain)", "domain", "domain, lang")},
{_sql_shares("low", "SELECT leaves.*, 1 AS weight, mid.got AS have FROM leaves JOIN mid USING (domain, lang)", "domain, lang", "domain, lang, source")},
o AS (SELECT k.*, got // low.tokens AS whole, got % low.tokens AS rest, md5('{SEED}:' || (got // low.tokens) || ':' || mark) AS h FROM k JOIN low USING (domain, lang, source)),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM p WHERE whole > 0 OR ahead < rest
"""
