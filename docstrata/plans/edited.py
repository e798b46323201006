"""Edits of documents: each user's events are the log of edits of the document with the user's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import editor, edits
from docstrata.session import table

#: What an event does, and the kinds that lines have and blocks are turned to, in turn.
OPS = {"signup": "split", "view": "insert", "click": "backspace", "purchase": "delete", "error": "turn"}
KINDS = ("paragraph", "heading", "quote", "bullet", "numbered", "table", "code")


def logs(events: DataFrame) -> DataFrame:
    """doc_id, log: the events of each user in their order as edits."""
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("event_type")]
    whole = F.floor(F.col("value") * 100).cast("int")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.pmod(whole, F.lit(len(KINDS))))
    fields = [op.alias("op"), F.pmod(whole, F.lit(9)).alias("block"), F.pmod(F.floor(F.col("value")), F.lit(14)).cast("int").alias("at"), F.col("props").alias("text"), kind.alias("kind"), F.pmod(whole, F.lit(3)).alias("level"), F.pmod(whole, F.lit(32)).alias("style")]
    rows = events.where("user_id is not null").select(F.col("user_id").alias("doc_id"), F.struct("ts", "event_id", F.struct(*fields).alias("e")).alias("r"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["e"]).alias("log"))


def _blocks(text, made):
    """The lines of a text; line ``i`` has kind ``i`` of KINDS, in turn, and tables have no text."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def block(line, i):
        kind = F.get(kinds, F.pmod(i, F.lit(len(KINDS))))
        return F.struct(kind.alias("kind"), F.when(kind == "heading", 2).otherwise(0).alias("level"), made(F.when(kind == "table", "").otherwise(line)).alias("chars"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), block).cast(edits.BLOCKS)


def _run(line):
    """A line as one run."""
    return F.when(line != "", F.array(F.struct(line.alias("ch"), F.lit(0).alias("style")))).otherwise(F.expr(f"cast(array() as {editor.CHARS})"))


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, blocks: the lines of each document as blocks of characters."""
    return documents.where("doc_id is not null").select("doc_id", _blocks(F.col("text"), editor.styled).alias("blocks"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each edited document, and the path at the place of its last edit."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(logs(table(spark, sf_dir, "events")), "doc_id")
    last = F.element_at("log", -1)
    rows = rows.select("doc_id", edits.replay_runs(_blocks(F.col("text"), _run), F.col("log")).alias("blocks"), last["block"].alias("at_block"), last["at"].alias("at"))
    rows = rows.select("doc_id", "blocks", edits.path(F.col("blocks"), F.col("at_block"), F.col("at")).alias("path"))
    return rows.select("doc_id", "path", F.posexplode("blocks").alias("place", "b")).select("doc_id", "path", "place", "b.kind", "b.level", F.array_join(F.transform("b.chars", lambda c: c["ch"]), "").alias("text"), F.aggregate("b.chars", F.lit(0), lambda n, c: n + F.length(c["ch"]) * c["style"]).alias("styles"))


QUERIES = {"d03_d05_d06_d11_edit_logs": edited}
