"""Benchmark decontamination with a stored, document-sharded positional inverted index.

``index`` cuts the documents into segments of about SEGMENT_BYTES of whole texts
and stores one row per segment as Parquet in the shared folder: its documents and
their word counts, its terms, and for each term the ascending word positions. A
frequent term's list is thus split by documents, and no posting is ever shuffled.

``search`` takes the test items in blocks of at most BLOCK_BYTES of text, one
block at a time on the driver. One pass over the segments' dictionaries gives the
corpus frequency of the block's terms; a second pass looks up each window from
its rarest term in the corpus: that term's positions, less its offset in the
window, are the candidate places, and the other terms' lists, rarest first and
adjusted by their offsets, are intersected with them. Candidates never cross a
document's border. That gives exact phrase matches. The same lists give proximity
matches: a window is near a document if some stretch of the window's length plus
SLACK consecutive words of the document holds every term of the window.

``decontaminate`` (the pipeline's stage) builds the same segments and searches
them in the task that filters their documents, so that no text is shuffled.

Defined cases: a null text has no words; items that are null or have no words
have no windows; an item of fewer words than a window is one window; repeated
documents are answered one by one; repeated items count once by item_id; an
empty benchmark hits nothing; an empty table gives an empty result; other columns
of the input are ignored by ``index`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.text import chunks, packed, unpacked, words
from docstrata.session import cut, stored_path, table

WINDOW = 10
#: Words beyond the window's length within which all its terms make a proximity match.
SLACK = 5
#: Bytes of document text in one segment of the index.
SEGMENT_BYTES = 2 << 20
#: Bytes of item text that are searched for at once; larger benchmarks go block after block.
BLOCK_BYTES = 8 << 20
#: How the index is written: its rows are megabytes long, so that a row group and a page are looked at after each row, not after each hundred, and no task has
#: more than a few segments at once in the buffers of Parquet and its codec.
STORED_AS = {"parquet.block.size": 8 * SEGMENT_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Blocks that one chain of filters holds before its rows are cut to the shared folder.
CHAIN = 4
#: Candidate places compared at once.
CANDIDATES = 1 << 20


class Windows:
    """The windows of a block of items, as term ids."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        known = [(name, ws) for name, text in items if (ws := words(text))]
        self.names = sorted({name for name, _ in known})
        number = {name: i for i, name in enumerate(self.names)}
        encoded = pa.array([w for _, ws in known for w in ws], pa.binary()).dictionary_encode()
        self.vocab: list[bytes] = encoded.dictionary.to_pylist()
        ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        rows, at = [], 0
        for name, ws in known:
            own = ids[at : at + len(ws)]
            at += len(ws)
            if len(own) < window:
                own = np.concatenate((own, np.full(window - len(own), -1, np.int32)))
            views = np.lib.stride_tricks.sliding_window_view(own, window)
            rows.append(np.concatenate((np.full((len(views), 1), number[name], np.int32), views), axis=1))
        table_ = np.unique(np.concatenate(rows), axis=0) if rows else np.empty((0, window + 1), np.int32)
        self.item, self.terms = table_[:, 0].astype(np.int64), np.ascontiguousarray(table_[:, 1:])
        self.length = (self.terms >= 0).sum(axis=1)
        #: How often each term occurs in the corpus; set before a search.
        self.frequency = np.ones(len(self.vocab), np.int64)


@dataclass
class Segment:
    """Word counts of some documents, their terms, and the terms' positions one list after the other."""

    n_words: np.ndarray
    terms: pa.Array
    counts: np.ndarray
    positions: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Segment:
        split = [words(t) for t in texts]
        encoded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
        ids = encoded.indices.to_numpy(zero_copy_only=False)
        return cls(np.array([len(ws) for ws in split], np.int64), encoded.dictionary, np.bincount(ids, minlength=len(encoded.dictionary)), np.argsort(ids, kind="stable"))

    def packed(self) -> bytes:
        """The positions as differences inside each list, byte by byte from the lowest, which is what compresses well."""
        if not len(self.positions):
            return b""
        gaps = np.diff(self.positions, prepend=0)
        first = np.cumsum(self.counts) - self.counts
        gaps[first] = self.positions[first]
        return np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()

    @classmethod
    def unpacked(cls, n_words: np.ndarray, terms: pa.Array, counts: np.ndarray, data: bytes) -> Segment:
        gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        sums = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        # Each list starts anew: what had been summed up before it goes.
        before = (sums[first] - gaps[first]) if len(first) else first
        return cls(n_words, terms, counts, sums - np.repeat(before, counts))


@dataclass
class Found:
    """Disjoint hit stretches (document, start, end), and (document, item) pairs of exact and of proximity matches."""

    stretches: tuple[np.ndarray, np.ndarray, np.ndarray]
    exact: np.ndarray
    near: np.ndarray


def find(segment: Segment, index: Windows, slack: int) -> Found:
    """All matches of the windows in a segment; no proximity matches if slack is negative."""
    width = index.terms.shape[1]
    gap = width + max(0, slack)
    at_vocab = pc.index_in(segment.terms, value_set=pa.array(index.vocab, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
    use = np.flatnonzero(at_vocab >= 0)
    use = use[np.argsort(at_vocab[use])]
    first_of = np.cumsum(segment.counts) - segment.counts
    freq = np.zeros(len(index.vocab), np.int64)
    freq[at_vocab[use]] = segment.counts[use]
    n = segment.counts[use]
    by_term = segment.positions[np.repeat(first_of[use] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    # Documents are moved apart by more than any match is long, so that no match reaches over a border.
    ends = np.cumsum(segment.n_words)
    by_term = by_term + np.searchsorted(ends, by_term, "right") * gap
    total = int(segment.n_words.sum()) + len(ends) * gap + gap
    tokens = np.full(total, -2, np.int32)
    tokens[by_term] = np.repeat(at_vocab[use], n)
    first = np.cumsum(freq) - freq
    composite = np.repeat(at_vocab[use], n).astype(np.int64) * (2 * total) + by_term

    alive = np.flatnonzero(((index.terms < 0) | (freq[index.terms] > 0)).all(axis=1)) if len(use) else np.empty(0, np.int64)
    each = np.where(index.terms[alive] >= 0, index.frequency[index.terms[alive]], np.iinfo(np.int64).max)
    rank = np.argsort(each, axis=1, kind="stable")
    rarest = index.terms[alive, rank[:, 0]] if len(alive) else np.empty(0, np.int64)
    load = np.cumsum(freq[rarest])
    none = np.empty(0, np.int64)
    starts, windows, near_places, near_windows = [none], [none], [none], [none]
    lo = 0
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + CANDIDATES)))
        m = freq[rarest[lo:hi]]
        row = np.repeat(np.arange(lo, hi), m)
        places = by_term[np.repeat(first[rarest[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        start, exact = places - rank[row, 0], row
        keep = start >= 0
        start, exact = start[keep], exact[keep]
        reach = index.length[alive[row]] + slack - 1
        for j in range(1, width):
            offset = rank[exact, j]
            term = index.terms[alive[exact], offset]
            keep = (term < 0) | (tokens[np.minimum(start + offset, total - 1)] == term)
            start, exact = start[keep], exact[keep]
            if slack >= 0 and len(row):
                term = index.terms[alive[row], rank[row, j]].astype(np.int64)
                low = np.searchsorted(composite, term * (2 * total) + np.maximum(places - reach, 0))
                keep = (term < 0) | ((low < len(composite)) & (composite[np.minimum(low, len(composite) - 1)] <= term * (2 * total) + places + reach))
                row, places, reach = row[keep], places[keep], reach[keep]
        starts.append(start)
        windows.append(alive[exact])
        if slack >= 0:
            good = _within(tokens, index, alive[row], places, slack)
            near_places.append(places[good])
            near_windows.append(alive[row[good]])
        lo = hi
    start, window = np.concatenate(starts), np.concatenate(windows)
    place, near_window = np.concatenate(near_places), np.concatenate(near_windows)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + index.length[window], -1)
    change = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    left, right = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    begin = ends - segment.n_words + np.arange(len(ends)) * gap
    document = lambda x: np.searchsorted(begin, x, "right") - 1
    of = document(left)
    pairs = lambda x, w: np.unique(np.stack((document(x), index.item[w]), axis=1), axis=0)
    return Found((of, left - begin[of], right - begin[of]), pairs(start, window), pairs(place, near_window))


def _within(tokens: np.ndarray, index: Windows, window: np.ndarray, places: np.ndarray, slack: int) -> np.ndarray:
    """Which places lie in a stretch of the window's length plus slack words that holds all its terms."""
    out = np.zeros(len(places), bool)
    most = index.terms.shape[1] + slack
    for lo in range(0, len(places), 1 << 14):
        w, p = window[lo : lo + (1 << 14)], places[lo : lo + (1 << 14)]
        size = index.length[w] + slack
        around = p[:, None] + np.arange(1 - most, most)[None, :]
        seen = np.where((around >= 0) & (around < len(tokens)), tokens[np.clip(around, 0, len(tokens) - 1)], -2)
        # Stretch k starts k words before the place.
        k = np.arange(most)[None, :]
        good = np.broadcast_to(k < size[:, None], (len(p), most)).copy()
        from_ = np.broadcast_to(most - 1 - k, (len(p), most))
        to = np.minimum(from_ + size[:, None], 2 * most - 1)
        for j in range(index.terms.shape[1]):
            term = index.terms[w, j]
            sums = np.concatenate((np.zeros((len(p), 1), np.int32), np.cumsum(seen == term[:, None], axis=1, dtype=np.int32)), axis=1)
            good &= (term < 0)[:, None] | (np.take_along_axis(sums, to, 1) > np.take_along_axis(sums, from_, 1))
        out[lo : lo + len(p)] = good.any(axis=1)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for batch, texts in chunks(batches, SEGMENT_BYTES):
        made = Segment.of(texts)
        ids = pa.ListArray.from_arrays([0, len(texts)], batch.column(0))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        terms = pa.ListArray.from_arrays([0, len(made.terms)], made.terms)
        yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), ids, one(made.n_words.tolist(), pa.int64()), terms, one(made.counts.tolist(), pa.int64()), pa.array([made.packed()], pa.binary())], ["segment", "doc_ids", "n_words", "terms", "counts", "positions"])
        k += 1


def index(docs: DataFrame) -> DataFrame:
    """The stored index of the documents (doc_id, text), a row per segment."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    at = stored_path(docs.sparkSession, "postings")
    rows.mapInArrow(_segments, f"segment string, doc_ids array<{kind}>, n_words array<bigint>, terms array<binary>, counts array<bigint>, positions binary").write.options(**STORED_AS).parquet(at)
    return docs.sparkSession.read.parquet(at)


def _count_terms(vocab: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = pa.array(vocab, pa.binary()), np.zeros(len(vocab), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            np.add.at(sums, at[at >= 0], batch.column(1).flatten().to_numpy(zero_copy_only=False)[at >= 0])
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(sums[met], pa.int64())], ["term", "n"])

    return run


def with_frequencies(windows: Windows, stored: DataFrame) -> Windows:
    """The windows with their terms' frequencies in the corpus; the terms are those of one block."""
    if windows.vocab:
        windows.frequency = np.zeros(len(windows.vocab), np.int64)
        for term, n in stored.select("terms", "counts").mapInArrow(_count_terms(windows.vocab), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
            windows.frequency[term] = n
        # What has a term that the corpus has not can neither be found nor be near.
        met = ((windows.terms < 0) | (windows.frequency[windows.terms] > 0)).all(axis=1)
        windows.item, windows.terms, windows.length = windows.item[met], windows.terms[met], windows.length[met]
    return windows


_FOUND = "segment string, place bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, near array<string>"


def _search(windows: Windows, slack: int, every: bool):
    """Segments to rows of their documents: of all of them, or of those with matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda batch, name: batch.column(batch.schema.get_field_index(name))
        vocab = pa.array(windows.vocab, pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                numbers = lambda name: column(batch, name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                n_words = numbers("n_words")
                terms = column(batch, "terms")[i].values
                if pc.any(pc.is_in(terms, value_set=vocab)).as_py():
                    segment = Segment.unpacked(n_words, terms, numbers("counts"), column(batch, "positions")[i].as_py())
                elif every:
                    # Without any term of the block the positions stay packed.
                    segment = Segment(n_words, terms.slice(0, 0), np.empty(0, np.int64), np.empty(0, np.int64))
                else:
                    continue
                found = find(segment, windows, slack)
                spans: list[list[dict]] = [[] for _ in n_words]
                for document, start, end in zip(*(x.tolist() for x in found.stretches), strict=True):
                    spans[document].append({"start": start, "end": end})
                items, near = ([[] for _ in n_words] for _ in range(2))
                for into, pairs in ((items, found.exact), (near, found.near)):
                    for document, item in pairs.tolist():
                        into[document].append(windows.names[item])
                rows = np.arange(len(n_words)) if every else np.flatnonzero([bool(a or b) for a, b in zip(items, near, strict=True)])
                take = lambda values: [values[r] for r in rows]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_ids")[i].values.take(pa.array(rows)), pa.array([column(batch, "segment")[i].as_py()] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(n_words[rows], pa.int64()),
                        pa.array(take(spans), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(take(items), pa.list_(pa.string())), pa.array(take(near), pa.list_(pa.string())),
                    ],
                    ["doc_id", "segment", "place", "n_words", "spans", "items", "near"],
                )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in blocks of about BLOCK_BYTES on the driver, one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1].encode()) for r in rows.toLocalIterator()]


def _covered(spans: Column) -> Column:
    """How many words stretches cover together."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("n"))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("upto"), zero.alias("n")), step, lambda acc: acc["n"])


def search(stored: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, spans (hit words, may overlap), items and near (arrays of item_id) for every indexed document."""
    spark = stored.sparkSession
    schema = f"doc_id {stored.schema['doc_ids'].dataType.elementType.simpleString()}, {_FOUND}"
    at, parts = stored_path(spark, "matches"), []
    for k, block in enumerate(_blocks(benchmark)):
        if parts:
            # One block is held at a time: what the one before has found is stored.
            parts[-1].write.parquet(f"{at}/{k - 1}")
            parts[-1] = spark.read.parquet(f"{at}/{k - 1}")
        parts.append(stored.mapInArrow(_search(with_frequencies(Windows(block, window), stored), slack, k == 0), schema))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        merged = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged("spans"), merged("items"), merged("near"))
        found = found.withColumns({c: F.array_distinct(c) for c in ("items", "near")})
    return found.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", F.array_sort("items").alias("items"), F.array_sort("near").alias("near"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """``search`` in a new index of the documents."""
    return search(index(docs), benchmark, window, slack)


def _without_hits(windows: Windows):
    """A mapInArrow function that keeps the rows of (row, text) in which no window of the block occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, SEGMENT_BYTES):
            found = find(Segment.of(texts), windows, -1)
            keep = np.ones(len(texts), bool)
            keep[found.exact[:, 0]] = False
            yield unpacked(batch, keep)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a window of an item; all columns stay, nothing is shuffled."""
    frame, schema = docs, docs.schema
    for k, block in enumerate(_blocks(benchmark)):
        if k and k % CHAIN == 0:
            frame = cut(frame)
        frame = packed(frame).mapInArrow(_without_hits(Windows(block, window)), schema)
    return frame


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
        F.array_join("near", ",").alias("near_items"),
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns)
), hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY doc_id),
df AS (SELECT word, count(*) AS f FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word),
rare AS (
  SELECT win, n, list_distinct(terms) AS terms, arg_min(word, (f, word)) AS word
  FROM (SELECT win, n, terms, word, f FROM (SELECT win, n, string_split(win, ' ') AS terms, unnest(string_split(win, ' ')) AS word FROM (SELECT DISTINCT win, n FROM bw)) JOIN df USING (word))
  GROUP BY win, n, terms HAVING count(DISTINCT word) = len(list_distinct(terms))
), cand AS (
  SELECT DISTINCT doc_id, win, n, terms, ws[greatest(1, i - n - 4) : i + n + 4] AS part, least(i, n + 5) AS spot
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w) JOIN rare USING (word)
  WHERE list_has_all(ws[greatest(1, i - n - 4) : i + n + 4], terms)
), nr AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS near
  FROM (SELECT doc_id, win, n FROM cand WHERE list_bool_or(list_transform(range(greatest(1, spot - n - 4), spot + 1), lambda s: list_has_all(part[s : s + n + 4], terms)))) JOIN bw USING (win, n)
  GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(len(near), 0) AS BIGINT) AS n_near, coalesce(array_to_string(near, ','), '') AS near_items
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id LEFT JOIN nr ON w.doc_id = nr.doc_id
"""
