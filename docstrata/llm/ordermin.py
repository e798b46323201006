r"""Document fingerprints by Order MinHash, in SQL expressions.

A text's tokens are pieces of up to TOKEN characters between ASCII white space. Its k-mers are KMER tokens in a
row (fewer at the end of the text), each numbered by how often it has occurred before. The
hashes of the numbered k-mers fall into BINS by their top bits (one permutation
in place of one per bin); in each bin the two smallest are selected, put back
in text order, and their tuple is hashed to 16 bits. A fingerprint has, for each
bin that is not empty, two hex digits for the bin and four for the tuple. The
same k-mers in another order make other tuples, which is what follows edit
distance rather than overlap.

Likeness of two fingerprints: p is the share of bins, of those not empty in
either, whose tuples agree; j = sqrt(p) estimates the share of common k-mers
(a tuple of two agrees where both are common and in order), and 2j / (1 + j) the
common share of two texts of one length, from 0 to 1. Two empty ones: 1.

The next document comes by a sorted window inside slices of the doc_id range;
the first row of each slice goes to the slice above as well, so that no
window spans the table and each text is shuffled once.

Defined cases: a null text is empty, the fingerprint of a text without tokens is
empty; null doc_ids stand below all others; rows with one doc_id are ordered by
text; a doc_id that is no integer is refused with a TypeError before any job;
the only document is its own next; positions above 2**24 tokens are taken
modulo that; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.llm.text import integral
from docstrata.session import table

TOKEN = 8
KMER = 3
BINS = 64
#: Places for the token position below a packed hash.
POSITION = 24
QUANTILES = 128
TOKENS = rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}+"


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """Columns behind a generator, so that later uses do not compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


LOW = (1 << POSITION) - 1


def _packed(h: Column, position: Column) -> Column:
    """A hash without its low bits, and a position in their place."""
    return h.bitwiseAND(F.lit(~LOW)).bitwiseOR(position.cast("bigint").bitwiseAND(F.lit(LOW)))


def _differs(x: Column, other: Column, bits: int) -> Column:
    """Whether x differs from another packed hash (null: there is none) above so many bits."""
    return F.shiftright(x.bitwiseXOR(F.coalesce(other, F.bitwise_not(x))), bits) != 0


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``name``: array<int> of bin * 65536 + tuple hash in order of the bins."""
    shift = 64 - (BINS - 1).bit_length()
    df = _once(df, _t=F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(0)))
    at = lambda a, i: F.get(F.col(a), i)
    kmers = F.transform("_t", lambda t, i: _packed(F.xxhash64(t, *(at("_t", i + k) for k in range(1, KMER))), i))
    df = _once(df, _s=F.sort_array(kmers)).drop("_t")
    # Equal k-mers stand side by side in text order: the first ones keep their hash, the others get one with their number.
    df = _once(df, _f=F.filter("_s", lambda x, i: _differs(x, at("_s", i - 1), POSITION)))
    later = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: ~_differs(at("_s", i), at("_s", i - 1), POSITION))
    some = F.size("_f") < F.size("_s")
    ints = F.expr("cast(array() as array<int>)")
    df = _once(df, _d=F.when(some, later).otherwise(ints))
    df = _once(df, _b=F.when(some, F.filter(F.sequence(F.lit(0), F.size("_d") - 1), lambda j: at("_d", j) != F.coalesce(at("_d", j - 1), F.lit(-2)) + 1)).otherwise(ints))

    def run(start: Column, k: Column) -> Column:
        size = F.coalesce(at("_b", k + 1), F.size("_d")) - start
        return F.transform(F.slice(F.col("_d"), start + 1, size), lambda i, n: _packed(F.xxhash64(F.shiftright(at("_s", i), POSITION), n), at("_s", i)))

    every = F.when(some, F.sort_array(F.concat("_f", F.flatten(F.transform("_b", run))))).otherwise(F.col("_f"))
    df = _once(df, _h=every).drop("_s", "_f", "_d", "_b")
    # Where a bin begins, its smallest hash and the next one, if that is of the bin, are the pick.
    heads = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: _differs(at("_h", i), at("_h", i - 1), shift))
    df = _once(df, _p=F.when(F.size("_h") > 0, heads).otherwise(ints))

    def tuple_of(i: Column) -> Column:
        x, y = at("_h", i), at("_h", i + 1)
        bare = lambda z: F.shiftright(z, POSITION)
        place = lambda z: z.bitwiseAND(F.lit(LOW))
        hashed = F.when(_differs(x, y, shift), F.xxhash64(bare(x))).when(place(x) <= place(y), F.xxhash64(bare(x), bare(y))).otherwise(F.xxhash64(bare(y), bare(x)))
        return ((F.shiftright(x, shift) + BINS // 2) * 65536 + hashed.bitwiseAND(F.lit(65535))).cast("int")

    return _once(df, **{name: F.transform("_p", tuple_of)}).drop("_h", "_p")


def shown(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda f: F.transform(f, lambda x: F.shiftright(x, 16))
    p = F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))
    return F.coalesce(F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * F.sqrt(p) / (1 + F.sqrt(p))), F.lit(0.0))


def _slice(key: Column, bounds: list[float], fine: int) -> Column:
    """Number of the slice of a key: quantile range by a search tree, then ``fine`` even parts of it."""
    edges = sorted({int(b) for b in bounds})
    if len(edges) < 2:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            width = max(1, edges[hi] - edges[lo])
            part = F.floor((key.cast("double") - float(edges[lo])) / (width / fine))
            return F.lit(lo * fine) + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part)).cast("int")
        mid = (lo + hi) // 2
        return F.when(key < edges[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(edges) - 1)


def with_next(rows: DataFrame, carried: list[str], ids: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with ``next_<c>`` of the next row by descending doc_id for each carried column; ids: the doc_id of every row, from where nothing has to be computed."""
    spark = rows.sparkSession
    lowest = -(1 << 63)
    bounds = ids.where("doc_id is not null").approxQuantile("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 1 / (4 * QUANTILES))
    fine = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // QUANTILES))
    sliced = lambda df: df.withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(lowest))).withColumn("_slice", _slice(F.col("_key"), bounds, fine).cast("int"))
    keyed = sliced(rows)
    # The highest key of each slice; one row a slice, at most QUANTILES * fine.
    tops = sliced(ids).groupBy("_slice").agg(F.max("_key").alias("_top"))
    up = Window.partitionBy().orderBy("_slice")
    every = Window.partitionBy()
    to = tops.select("_top", F.coalesce(F.lead("_slice").over(up), F.min("_slice").over(every)).alias("_to"))
    dealt = keyed.join(F.broadcast(to), F.col("_key") == F.col("_top"), "left")
    own = F.struct(F.col("_slice").alias("_part"), F.lit(0).alias("_halo"))
    both = F.when(F.col("_to").isNotNull(), F.array(own, F.struct(F.col("_to").alias("_part"), F.lit(1).alias("_halo")))).otherwise(F.array(own))
    dealt = dealt.select(*rows.columns, "_key", F.inline(both))
    order = Window.partitionBy("_part").orderBy("_halo", F.desc("_key"), "text")
    return dealt.select(*rows.columns, "_halo", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).where("_halo = 0").drop("_halo")


def edited(n: Column) -> Column:
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, and the fingerprints own, other (of edited) and next_own as arrays, for every row of the documents."""
    ids = docs.select(integral(docs, "doc_id").alias("doc_id"))
    texts = docs.select(integral(docs, "doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(texts, "text", "own"), ["text", "own"], ids)
    rows = rows.select("doc_id", "own", "next_own", F.length("text").cast("bigint").alias("n_chars"), edited(F.length("text")).alias("edited"))
    return with_fingerprint(rows, "edited", "other")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
