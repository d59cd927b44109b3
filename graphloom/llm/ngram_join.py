"""Components of the Jaccard join of documents on their word shingles, by a blocked sparse matrix product.

The incidence matrix has a row for each distinct set of shingles and a column for each shingle. Two rows
can only reach the similarity if they meet in a column early in both rows, under one order of all
columns; and where they first meet, what is left of both rows bounds their overlap. So the
product takes the head of each row, leaves out what the sizes and bitmaps of the rows exclude, and counts the
whole overlap for the pairs that are left. Rows of one component are never multiplied with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..staging import Staged, release, stage
from .text import shingles, slices, words

SHINGLE = 5
#: Share of the hash range whose columns are counted and come first in the order, the least count that sets a column
#: back, and how many such columns the tasks know. The order only steers the work: under any order the result is the same.
COUNTED = 0.5
ORDER_SEEN = 4
ORDER_ENTRIES = 1 << 20
#: Bits that tell most of the ids whose texts are not read again.
FILTER_BITS = 1 << 24
#: Rows of a column that one block holds, and products computed at once.
BLOCK = 8192
PRODUCTS = 1 << 20
#: 64-bit words of a row's bitmap, a bit for each value of the top nine bits of a hash. A bit tells an odd count, which says
#: as much of long rows as of short ones, where most classes have an entry.
WORDS = 8
#: Entries of a row before a column's that tell whether two rows have met already.
BEFORE = 8


def need(total):
    """Overlap of two sets of together ``total`` entries from which 100 * overlap >= 80 * union, times nine."""
    return total * 4


def incidence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and rows of the entries of a text column, each once, sorted by row and hash."""
    value, row, _ = shingles(words(pc.ascii_lower(column)), SHINGLE)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


Entries = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def frequent(docs: DataFrame, entries: Entries = incidence) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the counted shingles that several documents have, with the magnitude of their count.

    All documents are counted, so that what a shared passage puts into the heads does not grow with the table.
    """
    top = np.uint64(COUNTED * 2.0**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                value = entries(batch.column(0).slice(lo, hi - lo))[0]
                value, n = np.unique(value[value < top], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["gram", "n"])

    found = (
        docs.select("text")
        .mapInArrow(run, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= ORDER_SEEN)
        .orderBy(F.desc("n"), "gram")
        .limit(ORDER_ENTRIES)
        .toArrow()
    )
    gram = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], np.log2(found["n"].to_numpy()).astype(np.int8)[order]


def bitmaps(value: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    """Of which of 512 classes of hashes each row has an odd number of entries."""
    width = 64 * WORDS
    count = np.bincount(row * width + (value >> np.uint64(55)).astype(np.int64), minlength=rows * width)
    return [line.tobytes() for line in np.packbits((count & 1).astype(bool).reshape(rows, width), axis=1)]


def may_overlap(bits_x: np.ndarray, bits_y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Whether the bitmaps leave enough overlap: in a class odd in one row only, at least one entry is not in both."""
    differ = np.bitwise_count(bits_x ^ bits_y).sum(1, dtype=np.int64)
    return 9 * (n_x + n_y - differ) >= 2 * need(n_x + n_y)


def heads(docs: DataFrame, entries: Entries = incidence) -> DataFrame:
    """(doc_id, n, digest, grams, bits): size, digest and bitmap of the whole set, and the columns in which partners must meet."""
    known, magnitude = frequent(docs, entries)
    top = np.uint64(COUNTED * 2.0**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                value, row = entries(batch.column(1).slice(lo, hi - lo))
                n = np.bincount(row, minlength=hi - lo)
                at = np.concatenate([[0], np.cumsum(n)])
                view = memoryview(value.tobytes())
                digest = [
                    xxhash.xxh3_128_digest(view[8 * a : 8 * b]) if b > a else None
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
                ]
                bits = bitmaps(value, row, hi - lo)
                rank = (value >= top).astype(np.int8)
                if len(known):
                    slot = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    hit = known[slot] == value
                    rank[hit] = magnitude[slot[hit]]
                order = np.lexsort((value, rank, row))
                value = value[order]
                head = n - -(-4 * n // 5) + (n > 0)
                first = np.concatenate([[0], np.cumsum(head)])
                take = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], head)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value[take].view(np.int64))),
                        pa.array(bits, pa.binary()),
                    ],
                    names=["doc_id", "n", "digest", "grams", "bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, grams array<long>, bits binary")


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be among those of ``wanted``, so that few other texts are shuffled.

    The ids are marked in a bitmap of fixed size, at most 2^18 rows of 64 bits, which is what is broadcast.
    """

    def place(col: str):
        return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))

    bit = F.expr("shiftleft(1L, int(_h % 64))")
    marked = wanted.select(place("doc_id").alias("_h")).groupBy(F.floor(F.col("_h") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = docs.withColumn("_h", place("doc_id")).withColumn("_word", F.floor(F.col("_h") / 64))
    met = placed.join(F.broadcast(stage(marked).df), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return met.select(*docs.columns)


def whole_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams) with the whole sets of ``wanted`` (node, doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(2).to_pylist()
            for lo, hi in slices(batch.column(1)):
                value, row = incidence(batch.column(1).slice(lo, hi - lo))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                # rows that share an id may have other texts
                same = [xxhash.xxh3_128_digest(value[at[i] : at[i + 1]].tobytes()) == digests[lo + i] for i in range(hi - lo)]
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], names=["node", "grams"])
                yield out.filter(pa.array(same, pa.bool_()))

    # an id that is null is matched too
    texts = likely(docs, wanted).withColumnRenamed("doc_id", "_id").join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")))
    return texts.select("node", "text", "digest").mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def can_meet(n_a: Column, rest_a: Column, n_b: Column, rest_b: Column) -> Column:
    """Whether two rows that first meet in a column, with so many entries left from it on, can reach the overlap."""
    return F.least(rest_a, rest_b) * 9 >= need(n_a + n_b)


def hopeful(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose heads have enough in common. A common entry outside one head lies in the tail of the
    row whose head ends first, so the heads' overlap and the longer tail bound the whole overlap."""
    head = [reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab"]
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    tail = F.greatest(*(F.col(f"n_{x}") - F.size(f"grams_{x}") for x in "ab"))
    both = pairs.join(head[1], "b").join(head[0], "a")
    return both.where((shared + tail) * 9 >= need(F.col("n_a") + F.col("n_b"))).select("a", "b")


def overlapping(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole overlap reaches the similarity."""
    a = rows.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    b = rows.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    total = F.size("grams_a") + F.size("grams_b")
    return pairs.join(b, "b").join(a, "a").where(overlap * 9 >= need(total)).select("a", "b")


def meeting(postings: DataFrame) -> Staged:
    """The (gram, ...) rows whose column has another row. Only counts are shuffled to tell them."""
    several = stage(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("gram"))
    members = stage(postings.join(several.df, "gram"))
    release(postings.sparkSession, several)
    return members


def met_before(before_x: np.ndarray, before_y: np.ndarray) -> np.ndarray:
    """Whether the entries of each two rows before this column's show that they have met in an earlier column."""
    return (before_x[:, :, None] == before_y[:, None, :]).any((1, 2))


def block_products(
    node: np.ndarray,
    n: np.ndarray,
    rest: np.ndarray,
    label: np.ndarray,
    bits: np.ndarray | None = None,
    before: np.ndarray | None = None,
) -> Iterator[tuple]:
    """Pairs of rows of one column with different labels that the sizes and, where given, the bitmaps leave.

    Given the rows' entries ``before`` this column, a pair that they show to meet in an earlier one is left to that.
    A row without a partner of a fitting size is left out first. The largest label comes last and is never
    multiplied with itself, so a column with one large class costs the class times the other rows.
    """
    top = np.minimum(n * 5 // 4, (9 * rest - 4 * n) // 4)
    sizes = np.sort(n)
    partners = np.searchsorted(sizes, top, "right") - np.searchsorted(sizes, -(-4 * n // 5), "left") - (top >= n)
    some = partners > 0
    if bits is None:
        bits = np.zeros((len(n), WORDS), np.uint64)
    if before is None:
        before = np.zeros((len(n), 0), np.int64)
    node, n, rest, label, bits, before = node[some], n[some], rest[some], label[some], bits[some], before[some]
    if not len(node):
        return
    _, own, count = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((own, count[own]))
    node, n, rest, own, bits, before = node[order], n[order], rest[order], own[order], bits[order], before[order]
    last = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1
    end = np.repeat(last, np.diff(np.concatenate([[0], last])))
    many = len(node) - end
    lo = 0
    while lo < len(node):
        hi = max(int(np.searchsorted(np.cumsum(many[lo:]), PRODUCTS, "right")) + lo, lo + 1)
        size = many[lo:hi]
        x = np.repeat(np.arange(lo, hi), size)
        y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + end[x]
        keep = 9 * np.minimum(rest[x], rest[y]) >= need(n[x] + n[y])
        x, y = x[keep], y[keep]
        for at in range(0, len(x), PRODUCTS // 8):
            i, j = x[at : at + PRODUCTS // 8], y[at : at + PRODUCTS // 8]
            near = may_overlap(bits[i], bits[j], n[i], n[j])
            i, j = i[near], j[near]
            new = ~met_before(before[i], before[j])
            i, j = node[i[new]], node[j[new]]
            yield np.minimum(i, j), np.maximum(i, j)
        lo = hi


def products(members: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of the rows (gram, node, n, rest, label) that meet in a column and have different labels, and
    whose bitmaps, of ``reps`` (node, grams, bits), allow a link: near copies just short of one are told apart before they
    make rows, and a pair makes one where it first meets, not in every column it has in common that follows closely.

    A column of more than ``block`` rows is cut into blocks, and every two blocks are multiplied in a task of their own.
    """
    spark = members.sparkSession
    labels = (F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
    open_ = stage(members.groupBy("gram").agg(*labels).where("lo < hi")).df
    small = members.join(open_.where(F.col("size") <= block).select("gram"), "gram", "left_semi")
    large = stage(members.join(open_.where(F.col("size") > block).select("gram"), "gram", "left_semi")).df
    # in large columns only rows that have a fitting size of another label go on
    sizes = stage(large.groupBy("gram", "n").agg(*labels[:2])).df.withColumnsRenamed({"gram": "_gram", "n": "_n"})
    fitting = (
        (F.col("gram") == F.col("_gram"))
        & (F.col("_n") * 5 >= F.col("n") * 4)
        & can_meet(F.col("n"), F.col("rest"), F.col("_n"), F.col("_n"))
        & (F.col("_n") * 4 <= F.col("n") * 5)
        & ((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label")))
    )
    large = stage(large.join(sizes, fitting, "left_semi")).df
    still = stage(large.groupBy("gram").agg(*labels).where("lo < hi").select("gram", F.ceil(F.col("size") / block).alias("blocks"))).df
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cells = F.transform(other, lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    dealt = large.join(still, "gram").select("*", F.explode(cells).alias("_cell")).select("gram", "_cell.x", "_cell.y", "node", "n", "rest", "label")
    none = F.lit(0).cast("long")
    rows = small.select("gram", none.alias("x"), none.alias("y"), "node", "n", "rest", "label").unionAll(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((whole[1:, :3] != whole[:-1, :3]).any(1)) + 1
            found = []
            for cell in np.split(whole, new):
                bits = np.ascontiguousarray(cell[:, 7 : 7 + WORDS]).view(np.uint64)
                for pair in block_products(*cell[:, 3:7].T, bits, cell[:, 7 + WORDS :]):
                    if len(pair[0]) >= PRODUCTS // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(p) for p in pair], names=["a", "b"])
                    elif len(pair[0]):
                        found.append(np.stack(pair, 1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.int64).reshape(-1, WORDS)
            start, grams = batch.column(8).offsets.to_numpy(), batch.column(8).values.to_numpy()
            # what a shorter list lacks is like no entry of another row
            before = np.repeat(~batch.column(3).to_numpy()[:, None], BEFORE, 1)
            before[np.arange(BEFORE) < np.diff(start)[:, None]] = grams[start[0] : start[-1]]
            held.append(np.column_stack([*(c.to_numpy() for c in batch.columns[:7]), bits, before]))
            cut = np.flatnonzero((held[-1][:, :3] != held[-1][-1, :3]).any(1))
            # the last cell may go on in the next batch
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at or (len(held) > 1 and (held[-2][-1, :3] != held[-1][0, :3]).any()):
                tail = held[-1][at:]
                held[-1] = held[-1][:at]
                yield from flush(np.concatenate(held))
                held = [tail]
        if held:
            yield from flush(np.concatenate(held))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["gram", "x", "y"]
    pos = (F.col("n") - F.col("rest")).cast("int")
    before = F.slice("grams", F.greatest(pos - BEFORE, F.lit(0)) + 1, F.least(pos, F.lit(BEFORE))).alias("before")
    heads = reps.select("node", "grams", "bits").join(members.select("node").distinct(), "node", "left_semi")
    rows = rows.join(heads, "node").select(*rows.columns, "bits", before)
    return rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(edges, key=None).select("node", F.col("component").alias("label"))


def ngram_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Two documents link if their sets of five-word shingles (A-Z lower-cased; a shorter text is one shingle) have a
    Jaccard similarity of 0.8 or more; all links count, none is sampled. First all rows of a column are
    multiplied with one of them, the one that has most of its row left, then all pairs of different components.
    Equal sets are one row of the matrix. A set is known by the 64-bit hashes of its shingles.

    Null texts and texts without words have no shingles and a component of their own. Rows that share an id count each by
    its own text. A row without id links like others; its component has a null id if no row in it has one.
    An empty table gives no rows; other columns are not carried.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    headed = stage(heads(docs))
    of_doc = stage(headed.df.select("doc_id", "n", "digest"))
    reps = headed.df.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("bits").alias("bits"))
    reps = stage(reps.withColumn("node", F.monotonically_increasing_id()))
    release(spark, headed)
    exploded = reps.df.select("node", "n", F.posexplode("grams").alias("pos", "gram"))
    postings = exploded.select("gram", "node", "n", (F.col("n") - F.col("pos")).alias("rest"))
    members = meeting(postings)
    centre = F.min_by(F.struct("node", "n", "rest"), F.struct(-F.col("rest") / F.col("n"), F.col("node"))).alias("centre")
    centres = stage(members.df.groupBy("gram").agg(centre))
    stars = (
        members.df.join(centres.df, "gram")
        .where((F.col("node") != F.col("centre.node")) & can_meet(F.col("n"), F.col("rest"), F.col("centre.n"), F.col("centre.rest")))
        .select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
        .distinct()
    )
    stars = stage(stars)
    nodes = reps.df.select("node", "doc_id", "digest")

    def linked(pairs: DataFrame):
        pairs = stage(hopeful(pairs, reps.df)).df
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        rows = stage(whole_rows(docs, stage(nodes.join(ends, "node")).df))
        found = stage(overlapping(pairs, rows.df))
        release(spark, rows)
        return found

    first = linked(stars.df)
    merged = stage(components(first.df))
    labelled = members.df.join(merged.df, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled.select("gram", "node", "n", "rest", "label"))
    across = stage(products(labelled.df, reps.df, block).join(stars.df, ["a", "b"], "left_anti"))
    release(spark, centres, members, labelled, merged)
    second = linked(across.df)
    final = stage(components(first.df.unionAll(second.df)))
    labelled = reps.df.select("digest", "node", "doc_id").join(final.df, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = stage(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))).df
    of_set = stage(labelled.select("digest", "label").join(smallest, "label").select("digest", "component_id"))
    found = of_doc.df.where("n > 0").join(of_set.df, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = of_doc.df.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    release(spark, stars, first, across, second, reps)
    return found.unionAll(alone)
