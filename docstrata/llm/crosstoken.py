"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

``spill`` encodes every text once with both tokenizers. Where tokens of both end is a
cut; the tokens between two cuts are a group; an A and a B token whose bytes overlap are
linked. The pairs of a chunk of documents, with the documents they are in, are sorted by
B id, A id and document, dealt to radix partitions by a hash of the pair, and each
partition's share is a zstd run, stored in the shared folder.

``count`` merges the runs of a radix partition: Spark's sort hands over the runs by their
first pair, a heap holds the open ones, and pairs below the next run's first are final.
A run has each pair once, with the chunk's count, so a pair that is everywhere is one
entry a chunk. More than FAN runs are merged in levels. Order by B id first yields each
B id's highest count in the partition, and the highest of all partitions is at most one
row for each id of B's vocabulary.

``contributions`` streams each radix partition's counts, then its runs with the
documents, one at a time, in slices of FAN chunks: what a document gets from a run is
summed up and goes back to the document's chunk, where the sums are added up.

Defined cases: texts that are null, empty, or whose joined bytes in A or B differ from
space + text have no tokens: zeros and an empty groups_sha256; special tokens' strings
are plain text; repeated rows and rows without id are answered one by one and all
counted; an empty table gives an empty result; other columns are ignored; a text is
never split, so a chunk is as large as its longest text at least.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.text import chunks
from docstrata.session import stored_path, table

#: Folder of the vocabularies, on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of text of one chunk.
CHUNK_BYTES = 4 << 20
#: Radix partitions: this many at least, and one more for so many bytes of text.
LEAST_RADIX = 64
RADIX_BYTES = 512 << 20
#: Runs that one merge holds open, about, and chunks whose runs one task streams after a partition's counts.
FAN = 2048
#: Pairs that a merge gathers before it sums up those that are final, and pairs of one stored piece of counts.
MERGED = 1 << 20
PIECE = 1 << 16
#: Bits of an A id in a pair.
A_BITS = 20

#: Fixed value: what the byte-level vocabulary's pre-tokenizer takes for one piece.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the ids as text."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
            known = json.load(f)
        special, decode = {t["content"] for t in known["added_tokens"]}, byte_of_char()
        ranks = {bytes(decode[c] for c in token): number for token, number in known["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes: list[bytes] = [b""] * (max(known["model"]["vocab"].values()) + 1)
        for token, number in ranks.items():
            self.a_bytes[number] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        # An id and what follows it in the groups' text: "," inside a side, "|" after A's side, ";" after B's.
        self.shown = [f"{i}{sign}" for sign in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of space + text; None where a side does not give its bytes back."""
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            return None
        whole = b" " + text
        a, b = self.a.encode_ordinary(" " + plain), self.b.encode(plain)
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))


@lru_cache(maxsize=1)
def tokenizers(folder: str) -> Pair:
    """Loaded once in each Python worker."""
    return Pair(folder)


def marked(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places where a token ends, and what ends there: 1 for A, 2 for B, 3 for both, which is a cut."""
    marks = np.zeros(int(a_ends[-1]) + 1, np.uint8)
    marks[a_ends] = 1
    marks[b_ends] += 2
    ends = np.flatnonzero(marks)
    return ends, marks[ends]


def links(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that overlap. All ends together cut the bytes into pieces, and a link is the piece that its tokens share."""
    of_a, of_b = (kinds & 1).astype(np.int64), (kinds >> 1).astype(np.int64)
    return np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b


def groups_text(pair: Pair, a: np.ndarray, b: np.ndarray, kinds: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``."""
    cut = kinds == 3
    before = np.cumsum(cut) - cut
    cut_a, cut_b = cut[(kinds & 1) == 1], cut[kinds > 1]
    # Before a token stand its own side's earlier tokens and the other side's of earlier groups; A's of the same one too for B.
    a_stops, b_stops = np.flatnonzero(cut_a) + 1, np.concatenate(([0], np.flatnonzero(cut_b) + 1))
    a_at = np.arange(len(a)) + b_stops[before[(kinds & 1) == 1]]
    b_at = np.arange(len(b)) + a_stops[before[kinds > 1]]
    step = len(pair.shown) // 3
    codes = np.empty(len(a) + len(b), np.int64)
    codes[a_at] = a + step * cut_a
    codes[b_at] = b + 2 * step * cut_b
    return "".join(map(pair.shown.__getitem__, codes.tolist()))[:-1]


# Runs: numbers as byte planes, which is what compresses well, and differences where they ascend.


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Non-negative integers, up to 2^63."""
    values = np.diff(values, prepend=0) if ascending else values
    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)
    return np.cumsum(values) if ascending else values


def radix_of(pairs: np.ndarray, n: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


_SPILLED = "chunk string, radix int, first bigint, pairs binary, counts binary, places binary, doc_ids array<{0}>, numbers array<bigint>, hashes array<string>"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk(pair: Pair, texts: list[bytes], n_radix: int):
    """Of a chunk's documents: numbers of each, hash of each, and the runs (radix, pairs, counts, places)."""
    numbers, hashes, keys = np.zeros((len(texts), len(_NUMBERS)), np.int64), [""] * len(texts), []
    for d, text in enumerate(texts):
        both = pair.encode(text) if text else None
        if both is None:
            continue
        a, b = both
        _, kinds = marked(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]))
        i, j = links(kinds)
        numbers[d] = len(a), len(b), np.count_nonzero(kinds == 3), len(i)
        hashes[d] = hashlib.sha256(groups_text(pair, a, b, kinds).encode()).hexdigest()
        found, times = np.unique((b[j] << A_BITS) | a[i], return_counts=True)
        keys.append((found, np.full(len(found), d), times))
    runs = []
    if keys:
        pairs, docs, times = (np.concatenate(x) for x in zip(*keys, strict=True))
        # By pair; documents ascend already.
        order = np.argsort(pairs, kind="stable")
        pairs, docs, times = pairs[order], docs[order], times[order]
        start = np.flatnonzero(np.diff(pairs, prepend=-1))
        alone, sums, spread = pairs[start], np.add.reduceat(times, start), np.diff(start, append=len(pairs))
        radix = radix_of(alone, n_radix)
        by = np.argsort(radix, kind="stable")
        edges = np.searchsorted(radix[by], np.arange(n_radix + 1))
        for r, (lo, hi) in enumerate(pairwise(edges.tolist())):
            if hi > lo:
                mine = by[lo:hi]
                size = spread[mine]
                rows = np.repeat(start[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                runs.append((r, alone[mine], sums[mine], (size, docs[rows], times[rows])))
    return numbers, hashes, runs


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _spill(folder: str, n_radix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, k = tokenizers(folder), TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, CHUNK_BYTES):
            numbers, hashes, runs = _chunk(pair, texts, n_radix)
            name, n = f"{part}-{k}", len(runs) + 1
            k += 1
            # The chunk's own row comes first, as radix -1.
            none = [None] * len(runs)
            one = lambda values, kind: pa.array([values, *none], pa.list_(kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n), pa.array([-1, *(r[0] for r in runs)], pa.int32()), pa.array([None, *(int(r[1][0]) for r in runs)], pa.int64()),
                    pa.array([None, *(packed(r[1], True) for r in runs)], pa.binary()), pa.array([None, *(packed(r[2]) for r in runs)], pa.binary()),
                    pa.array([None, *(_joined([packed(x) for x in r[3]]) for r in runs)], pa.binary()),
                    one(batch.column(0).to_pylist(), batch.column(0).type), one(numbers.ravel().tolist(), pa.int64()), one(hashes, pa.string()),
                ],
                ["chunk", "radix", "first", "pairs", "counts", "places", "doc_ids", "numbers", "hashes"],
            )

    return run


def spill(docs: DataFrame, folder: str = TOKENIZERS) -> tuple[DataFrame, int]:
    """The stored runs and chunk rows of the documents (doc_id, text), and the number of radix partitions."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_radix = LEAST_RADIX + size // RADIX_BYTES
    at = stored_path(spark, "alignment")
    rows.mapInArrow(_spill(folder, n_radix), _SPILLED.format(rows.schema["doc_id"].dataType.simpleString())).write.parquet(at)
    return spark.read.parquet(at), n_radix


# Counting


def merged(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs and counts, by their first pair, to ascending pairs with summed counts, some at a time.

    A heap holds the open runs by their next pair; those that begin below the first pair of the run that comes next give what lies below it.
    """
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    held = number = 0

    def below(limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held
        taken, rest = [], []
        while heap and (limit is None or heap[0][0] < limit):
            _, k, pairs, counts = heapq.heappop(heap)
            end = len(pairs) if limit is None else int(np.searchsorted(pairs, limit))
            taken.append((pairs[:end], counts[:end]))
            if end < len(pairs):
                rest.append((int(pairs[end]), k, pairs[end:], counts[end:]))
        for run in rest:
            heapq.heappush(heap, run)
        if taken:
            pairs, counts = (np.concatenate(x) for x in zip(*taken, strict=True))
            held -= len(pairs)
            order = np.argsort(pairs, kind="stable")
            pairs, counts = pairs[order], counts[order]
            start = np.flatnonzero(np.diff(pairs, prepend=-1))
            yield pairs[start], np.add.reduceat(counts, start)

    for pairs, counts in runs:
        if held + len(pairs) > MERGED:
            yield from below(int(pairs[0]))
        heapq.heappush(heap, (int(pairs[0]), number, pairs, counts))
        number += 1
        held += len(pairs)
    yield from below(None)


_COUNTED = "radix int, part int, first bigint, pairs binary, counts binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(radix, part, first, pairs, counts), in this order, to the same with every pair once in a part."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), unpacked(batch.column(3)[i].as_py(), True), unpacked(batch.column(4)[i].as_py())

    for (radix, part), mine in groupby(rows(), key=lambda r: r[:2]):
        for pairs, counts in merged(r[2:] for r in mine):
            for lo in range(0, len(pairs), PIECE):
                p, c = pairs[lo : lo + PIECE], counts[lo : lo + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([part], pa.int32()), pa.array([int(p[0])], pa.int64()), pa.array([packed(p, True)]), pa.array([packed(c)])], ["radix", "part", "first", "pairs", "counts"])


def slices(spilled: DataFrame) -> int:
    """How many parts the chunks are dealt to, about FAN in each."""
    return max(1, -(-spilled.where("radix < 0").count() // FAN))


def count(spilled: DataFrame, n_slices: int) -> DataFrame:
    """radix, first, pairs, counts of the whole corpus, in the shared folder; FAN runs at most, about, are merged at once."""
    spark = spilled.sparkSession
    part = lambda n: F.pmod(F.xxhash64("chunk"), F.lit(n)).cast("int").alias("part")
    runs = spilled.where("radix >= 0").select("radix", part(n_slices), "first", "pairs", "counts")
    while True:
        at = stored_path(spark, "alignment")
        runs.repartition("radix", "part").sortWithinPartitions("radix", "part", "first").mapInArrow(_merge, _COUNTED).write.parquet(at)
        runs = spark.read.parquet(at)
        if n_slices == 1:
            return runs.drop("part")
        n_slices = -(-n_slices // FAN)
        runs = runs.withColumn("part", F.pmod("part", F.lit(n_slices)))


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            b, counts = unpacked(batch.column(0)[i].as_py(), True) >> A_BITS, unpacked(batch.column(1)[i].as_py())
            start = np.flatnonzero(np.diff(b, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(b[start]), pa.array(np.maximum.reduceat(counts, start))], ["b", "best"])


def best(counted: DataFrame) -> np.ndarray:
    """The highest count of each B id, one number for each id of its vocabulary at most."""
    rows = counted.select("pairs", "counts").mapInArrow(_best, "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best")).collect()
    out = np.zeros(max((r["b"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["b"]] = r["best"]
    return out


# Back to the documents

_GIVEN = "chunk string, docs binary, n_best binary, count_sum binary"


def _contribute(highest: np.ndarray):
    """Rows of (radix, slice, counts first, then runs) to what the documents of each run's chunk get from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, pairs, counts = None, [], np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            radix, part, chunk = (batch.column(k).to_pylist() for k in range(3))
            for i in range(batch.num_rows):
                if (radix[i], part[i]) != key:
                    key, pieces = (radix[i], part[i]), []
                met = unpacked(batch.column(4)[i].as_py(), True)
                if chunk[i] is None:
                    pieces.append((met, unpacked(batch.column(5)[i].as_py())))
                    continue
                if pieces:
                    (pairs, counts), pieces = (np.concatenate(x) for x in zip(*pieces, strict=True)), []
                size, docs, times = (unpacked(x) for x in _parted(batch.column(6)[i].as_py()))
                n = counts[np.searchsorted(pairs, met)]
                top = n == highest[met >> A_BITS]
                sums, tops = (np.zeros(int(docs.max()) + 1, np.int64) for _ in range(2))
                np.add.at(sums, docs, np.repeat(n, size) * times)
                np.add.at(tops, docs, np.repeat(top, size) * times)
                got = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([chunk[i]]), pa.array([packed(got, True)]), pa.array([packed(tops[got])]), pa.array([packed(sums[got])])], ["chunk", "docs", "n_best", "count_sum"])

    return run


def contributions(spilled: DataFrame, counted: DataFrame, highest: np.ndarray, n_slices: int) -> DataFrame:
    """chunk, docs, n_best and count_sum of every run."""
    part = F.pmod(F.xxhash64("chunk"), F.lit(n_slices)).cast("int").alias("part")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    runs = spilled.where("radix >= 0").select("radix", part, "chunk", "first", "pairs", none("counts", "binary"), "places")
    # Every slice of a partition's runs gets its counts.
    tables = counted.select("radix", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("part"), none("chunk", "string"), "first", "pairs", "counts", none("places", "binary"))
    # Nulls sort first: counts come before runs.
    return tables.unionByName(runs).repartition("radix", "part").sortWithinPartitions("radix", "part", "chunk", "first").mapInArrow(_contribute(highest), _GIVEN)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, its own row first, then what its documents got) to a row for each document."""
    own = None

    def done() -> Iterator[pa.RecordBatch]:
        if own:
            ids, numbers, hashes, got = own
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(c)) for c in numbers.T), *(pa.array(g) for g in got), hashes], ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(1)[i].as_py() is None:
                yield from done()
                numbers = batch.column(5)[i].values.to_numpy(zero_copy_only=False).reshape(-1, len(_NUMBERS))
                own = batch.column(4)[i].values, numbers, batch.column(6)[i].values, np.zeros((2, len(numbers)), np.int64)
            else:
                docs = unpacked(batch.column(1)[i].as_py(), True)
                for k in range(2):
                    own[3][k][docs] += unpacked(batch.column(2 + k)[i].as_py())
    yield from done()


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    spilled, _ = spill(docs, folder)
    n_slices = slices(spilled)
    counted = count(spilled, n_slices)
    given = contributions(spilled, counted, best(counted), n_slices)
    kind = spilled.schema["doc_ids"].dataType.simpleString()
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    own = spilled.where("radix < 0").select("chunk", none("docs", "binary"), none("n_best", "binary"), none("count_sum", "binary"), "doc_ids", "numbers", "hashes")
    given = given.select("*", none("doc_ids", kind), none("numbers", "array<bigint>"), none("hashes", "array<string>"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{n} bigint' for n in (*_NUMBERS, 'n_best', 'count_sum'))}, groups_sha256 string"
    return own.unionByName(given).repartition("chunk").sortWithinPartitions("chunk", "docs").mapInArrow(_documents, schema)


def pair_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """b, a, n, best: how often tokens of the two ids are linked in all documents, and whether that is b's highest."""
    spilled, _ = spill(docs, folder)
    counted = count(spilled, slices(spilled))
    highest = best(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, n = unpacked(batch.column(0)[i].as_py(), True), unpacked(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> A_BITS), pa.array(pairs & ((1 << A_BITS) - 1)), pa.array(n), pa.array(n == highest[pairs >> A_BITS])], ["b", "a", "n", "best"])

    return counted.select("pairs", "counts").mapInArrow(run, "b bigint, a bigint, n bigint, best boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
