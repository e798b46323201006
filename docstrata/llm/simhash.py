"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's 64 bits are two halves; of two fingerprints within 3 bits, one
half is within 1 bit. The anchors of a half are the words of the [31,26] Hamming
code (perfect, covering radius 1) times its free top bit, 2**27 of them. Each
fingerprint goes to every anchor within covering radius plus threshold,
1 + 1 = 2, of either half, at most 17 a half, so that two halves within 1 bit
meet at the anchor nearest to either. Fingerprints are compared per anchor, in
full, and leave as a spanning forest of links, never as all pairs.

Equal fingerprints are one row before any comparison. An anchor with over HOT
fingerprints is dealt out in tiles (pairs of blocks), which is exact.

Defined cases: null, empty and white text have fingerprint 0 and are linked like
any other; rows with one doc_id are one document, their groups join; a null
doc_id counts as no id (component null if nothing else is there), a doc_id that is
no integer is refused with a TypeError before any job; an empty table
gives an empty result; other columns are ignored by ``groups`` and kept by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docstrata.llm.components import components
from docstrata.llm.text import chunks, integral
from docstrata.session import cut, table

SEED = 42
SHINGLE = 3
BITS = 3
#: Fingerprints at one anchor that one task compares.
HOT = 20_000
#: Ids from here on stand for fingerprints without any doc_id.
NO_ID = 1 << 62


def fingerprint(text: bytes) -> int:
    """Majority of the XXH64 bits of a text's word shingles, as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int(sum(1 << i for i in np.flatnonzero(2 * votes > len(hashes)).tolist()))
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for every row."""
    rows = docs.select(integral(docs, "doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the byte values at each of 4 byte places; for each syndrome, the masks that lead to the code words within 2."""
    place = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for value in range(256):
            s = 0
            for bit in range(8):
                at = byte * 8 + bit  # bit 31 is free, bits 0 to 30 stand for the places 1 to 31
                if value >> bit & 1 and at < 31:
                    s ^= at + 1
            place[byte, value] = s
    masks = np.zeros((32, 17), np.uint32)
    for s in range(32):
        found = [1 << (s - 1) if s else 0]
        found.append(found[0] | 1 << 31)
        if s:
            for i in range(1, 32):
                j = i ^ s
                if i < j:
                    found.append(1 << (i - 1) | 1 << (j - 1))
        found += [found[0]] * (17 - len(found))
        masks[s] = found
    return place, masks


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, masks = _hamming_tables()
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            part = batch.slice(at, 1 << 14)
            node, fp = part.column(0).to_numpy(), part.column(1).to_numpy()
            for half in (0, 1):
                bits = (fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                syndrome = place[0, bits & 255] ^ place[1, bits >> 8 & 255] ^ place[2, bits >> 16 & 255] ^ place[3, bits >> 24]
                anchor = bits[:, None] ^ masks[syndrome]
                real = np.ones(anchor.shape, bool)
                real[:, 2:] = (syndrome != 0)[:, None]  # a code word has no other within 2
                rows, cols = np.nonzero(real)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[rows, cols].astype(np.int64) | half << 32), pa.array(node[rows]), pa.array(fp[rows])],
                    ["anchor", "node", "fp"],
                )


def _forest(node: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups within ``most`` bits of one anchor's fingerprints: each node met is linked to the one it was met from."""
    left_node, left_fp = node, fp
    while len(left_node):
        queue = [(left_node[0], left_fp[0])]
        left_node, left_fp = left_node[1:], left_fp[1:]
        while queue and len(left_node):
            at, bits = queue.pop()
            near = np.bitwise_count(left_fp ^ bits) <= most
            if near.any():
                met = left_node[near]
                yield np.full(len(met), at), met
                queue.extend(zip(met, left_fp[near], strict=True))
                left_node, left_fp = left_node[~near], left_fp[~near]


def _compare(most: int):
    """Batches (anchor, lo, hi, node, fp), equal keys together, to links (a, b)."""

    def links(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(node)]))
        size = ends - starts
        a, b = [], []
        fp = fp.view(np.uint64)  # of signed numbers bitwise_count takes the absolute value
        small = size <= 32
        group = np.repeat(np.arange(len(size)), size)
        inside = small[group]
        for shift in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero(inside[:-shift] & (group[:-shift] == group[shift:]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= most]
            a.append(node[i])
            b.append(node[i + shift])
        for k in np.flatnonzero(~small):
            for x, y in _forest(node[starts[k] : ends[k]], fp[starts[k] : ends[k]], most):
                a.append(x)
                b.append(y)
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            node, fp = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            last = int(np.flatnonzero(np.any(key != key[-1], axis=1)).max(initial=-1)) + 1  # the last key may go on
            if last:
                held.append((key[:last], node[:last], fp[:last]))
                yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [(key[last:], node[last:], fp[last:])]
            elif held and (held[-1][0][-1] != key[0]).any():
                yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [(key, node, fp)]
            else:
                held.append((key, node, fp))
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(reps: DataFrame, most: int = BITS) -> DataFrame:
    """reps (node, fp), one row per fingerprint -> links (a, b) between nodes that span all groups within ``most`` <= 3 bits."""
    if not 0 <= most <= BITS:
        raise ValueError("the anchors cover up to 3 bits")
    at = reps.select("node", "fp").mapInArrow(_anchors, "anchor bigint, node bigint, fp bigint")
    shared = at.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("_a"), F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    met = at.join(shared, F.col("anchor") == F.col("_a"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")))
    dealt = met.select("anchor", F.inline(tiles), "node", "fp").select("anchor", "lo", "hi", "node", "fp")
    return dealt.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi").mapInArrow(_compare(most), "a bigint, b bigint")


def groups(docs: DataFrame, most: int = BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of the documents."""
    prints = cut(fingerprints(docs))
    synthetic = F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(NO_ID))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).select(F.coalesce("first", synthetic).alias("node"), "fp"))
    # A doc_id with several texts joins its groups.
    same = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id")
    joined = prints.join(same, "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    found = components(links(reps, most).union(joined.select("a", "b")))
    label = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(label, "fp").select("doc_id", "fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"), "component_id")
    return out.toDF("doc_id", "fp", "component_id", "node")


def _first_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row of each key, the one whose columns have the smallest hash; partly done before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.select(key, row.alias("__docstrata_row"), F.xxhash64(F.to_json(row)).alias("__docstrata_hash")).groupBy(key).agg(F.min_by("__docstrata_row", "__docstrata_hash").alias("__docstrata_row")).select(key, *[F.col("__docstrata_row")[c].alias(c) for c in columns])


def deduplicate(docs: DataFrame, most: int = BITS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns stay. Of rows with that doc_id, or of a group in which no row has one, the row whose columns have the smallest hash stays."""
    key, columns = "__docstrata_key", docs.columns
    found = groups(docs, most)
    later = found.where("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.withColumn(key, integral(docs, "doc_id")).where(F.col(key).isNotNull())
    kept = named.join(later, key, "left_anti")
    twice = cut(named.groupBy(key).count().where("count > 1").select(key))
    if not twice.isEmpty():
        kept = kept.join(twice, key, "left_anti").unionByName(_first_of(kept.join(twice, key, "left_semi"), key, columns))
    kept = kept.select(*columns)
    alone = cut(found.where("component_id is null").select("fp", F.col("node").alias(key)).distinct())
    if alone.isEmpty():
        return kept
    schema = StructType([*docs.schema.fields, StructField("__docstrata_fp", LongType())])

    def with_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([fingerprint(t) for t in texts], pa.int64())], [*columns, "__docstrata_fp"])

    nameless = docs.where("doc_id is null").select("*", F.col("text").cast("string").alias("__docstrata_text")).mapInArrow(with_print, schema)
    nameless = nameless.join(alone, nameless["__docstrata_fp"] == alone["fp"]).select(*[nameless[c] for c in columns], key)
    return kept.unionByName(_first_of(nameless, key, columns).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
