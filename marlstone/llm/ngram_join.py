"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into k equal ranges, so that a document's set falls into k
fragments. If two sets differ in at most D n-grams, at least k - D of their fragments are equal; k exceeds D, so every linked pair
meets in a bucket of documents that have one fragment in common. Each document leaves out its h = k - D - 1 most frequent fragments
(a prefix filter over fragments, in the global order of their counts), which keeps shared passages and boilerplate from making candidates.

Sets that are equal are one vertex. Within a bucket, all members are first paired with the pivot, the member with the most company, which
links most groups of near copies at a row a member. What is left are links between members of a bucket that are in different components.
For these, the n-grams of such members alone are ordered from the rarest on: the sets of a linked pair have an n-gram in common among
the first of each (a prefix filter with positions). N-grams that copies share with their whole group come last and so make no pairs, and n-grams
whose documents are in one component make none either. So groups of near copies cost no row for each pair, and components are exact.

Pairs are candidates only. Sizes and parity bitmaps (each n-gram flips one bit, so two bitmaps differ at most in as many bits as the
sets in n-grams) decide on most of them before any set is moved. For those that pass, partial overlaps are counted for each of FRAGMENTS
ranges of the order, separately, and summed per pair, which is exact. (Hashes of 64 bits stand for n-grams.)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop, in_batches, mix64, small, utf8_view, written
from .components import connected_components
from .shingles import shingle_sets

SEEDS = 4
FRAGMENTS = 16


def size_classes(most: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, k, h) of classes of sizes up to `most`; k is 0 where only equal sets can link."""
    out, at = [], 1
    while at <= most:
        to = max(at + 1, -(-at * 3 // 2))
        d = (to - 1) * (den - num) // num
        h = max(1, (d + 1) // 8)
        out.append((at, to - 1, d + 1 + h if d else 0, h))
        at = to
    return out


def _homes(n: int, classes, num: int, den: int):
    """The classes whose fragments a set of n n-grams needs: its own, and smaller ones with sets that it could link to."""
    for c, (lo, hi, k, h) in enumerate(classes):
        if lo > n:
            return
        if k and n <= hi * den // num:
            yield c, k, h


def signatures(x: np.ndarray, classes, num: int, den: int):
    """Yields (code, spare, fragment signatures) for each class and hash order that the set x takes part in; see the module."""
    for c, k, h in _homes(len(x), classes, num, den):
        for seed in range(SEEDS):
            v = x if not seed else np.sort(mix64(x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            part = ((v >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mix64(v), first)
            salt = np.uint64((c * SEEDS + seed + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
            sig = mix64(sums ^ mix64(part[first] + salt))
            empty = k - len(first)
            last = seed == SEEDS - 1
            if last and empty > h:  # not reached in practice, but it makes the join exact for any hashes
                gone = np.setdiff1d(np.arange(k, dtype=np.uint64), part[first])
                sig = np.concatenate((sig, mix64(gone + salt)))
            yield c * SEEDS + seed, h - empty, sig
            if empty <= h:
                break


def bitmap(x: np.ndarray) -> np.ndarray:
    """Parities of the n-grams at each bit, as words: a power of two of them, 4 at least, with a bit or more for each n-gram of the set."""
    words = 4
    while 64 * words < len(x):
        words *= 2
    odd = np.bincount((x & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def flipped(a: Column, b: Column) -> Column:
    """In how many bits two bitmaps differ, the longer one folded to the length of the other."""
    fold = lambda x, y: F.transform(y, lambda w, i: F.bit_count(F.aggregate(F.sequence(i, F.size(x) - 1, F.size(y)), w, lambda s, j: s.bitwiseXOR(F.get(x, j)))))
    return F.aggregate(F.when(F.size(a) >= F.size(b), fold(a, b)).otherwise(fold(b, a)), F.lit(0), lambda s, c: s + c)


_LONGS = T.ArrayType(T.LongType(), False)
_PREP = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
    + [T.StructField("code", T.IntegerType()), T.StructField("spare", T.IntegerType()), T.StructField("sigs", _LONGS), T.StructField("bits", _LONGS)]
)
_SEGMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f", T.IntegerType()), T.StructField("part", _LONGS)]
)


def _digest(x: np.ndarray) -> int:
    return int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _prepare(n: int, num: int, den: int):
    def run(batches):
        import pyarrow as pa

        classes = size_classes(1024, num, den)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = part.column(0).to_pylist()
                rows: list[list] = [[], [], [], [], [], []]
                sigs, bits = [], []
                for doc, x in zip(ids, shingle_sets(*utf8_view(part.column(1)), n)):
                    while len(x) > classes[-1][1]:
                        classes = size_classes(2 * len(x), num, den)
                    d1, d2 = _digest(x), _digest(mix64(x))
                    found = list(signatures(x, classes, num, den)) or [(None, None, x[:0])]
                    for i, (code, spare, sig) in enumerate(found):
                        for col, value in zip(rows, (doc, len(x) if not i else None, d1, d2, code, spare)):
                            col.append(value)
                        sigs.append(sig)
                        bits.append(x[:0].view(np.int64) if i or code is None else bitmap(x))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds)), _lists(sigs), _lists(bits)], names=_PREP.names)

    return run


def _segments(n: int):
    """A row for each fragment of a set that holds something."""

    def run(batches):
        import pyarrow as pa

        cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)).astype(np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows, parts = [], []
                for doc, x in zip(part.column(0).to_pylist(), shingle_sets(*utf8_view(part.column(1)), n)):
                    d1 = _digest(x)
                    for f, piece in enumerate(np.split(x, np.searchsorted(x, cuts))):
                        if len(piece):
                            rows.append((doc, d1, len(x), f))
                            parts.append(piece)
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, _lists(parts)], names=_SEGMENTS.names)

    return run


def _promising(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (u, v), those whose sizes and bitmaps allow a link, with d1_u, d1_v, n_u and n_v. A document may have several sets."""
    side = lambda x: marks.select(F.col("doc_id").alias(x), F.col("d1").alias(f"d1_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    fits = f"n_u * {num} <= n_v * {den} and n_v * {num} <= n_u * {den}"
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(fits)
    most = F.floor((F.col("n_u") + F.col("n_v")) * (den - num) / (den + num))
    return both.where(flipped(F.col("bits_u"), F.col("bits_v")) <= most).drop("bits_u", "bits_v")


def _linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (u, v, d1_u, d1_v, n_u, n_v), those that link: overlaps are counted by fragment and summed per pair."""
    side = lambda x: segments.select(F.col("doc_id").alias(x), F.col("d1").alias(f"d1_{x}"), "f", F.col("part").alias(f"part_{x}"))
    met = pairs.join(side("u"), ["u", "d1_u"]).join(side("v"), ["v", "d1_v", "f"])
    partial = met.select("u", "v", "d1_u", "d1_v", "n_u", "n_v", F.size(F.array_intersect("part_u", "part_v")).alias("overlap"))
    whole = partial.groupBy("u", "v", "d1_u", "d1_v", "n_u", "n_v").agg(F.sum("overlap").alias("overlap"))
    return whole.where(f"{den + num} * overlap >= {num} * (n_u + n_v)").select("u", "v").distinct()


def _between_components(segments: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of members (doc_id, component) in different components that may link: a prefix filter with positions, rarest n-grams first."""
    grams = segments.join(members, "doc_id").select("doc_id", "d1", "n", "component", F.explode("part").alias("gram"))
    shared = grams.withColumn("often", F.count("*").over(Window.partitionBy("gram"))).where("often > 1")
    # n-grams that no other member has come first; the list holds the others of one set
    order = shared.groupBy("doc_id", "d1", "n", "component").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("rest")).withColumn("alone", F.col("n") - F.size("rest"))
    reach = F.greatest(F.floor(F.col("n") * (den - num) / den) + 1 - F.col("alone"), F.lit(0)).cast("int")
    entry = order.select("doc_id", "n", "component", "alone", F.posexplode(F.slice("rest", 1, reach)).alias("i", "x"))
    entry = written(entry.select("doc_id", "n", "component", (F.col("alone") + F.col("i")).alias("at"), F.col("x.gram").alias("gram")), "entries")
    # an n-gram's largest component isn't paired with itself, so of each pair one side at least is outside it
    groups = entry.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("groups"))
    mixed = entry.join(groups.where("groups > 1").select("gram", F.col("top.component").alias("main")), "gram")
    side = lambda i: mixed.select("gram", "main", *(F.col(c).alias(f"{c}_{i}") for c in ("doc_id", "n", "component", "at")))
    other = "component_1 <> component_2 and (component_2 = main or doc_id_1 < doc_id_2)"
    sizes = f"n_1 * {num} <= n_2 * {den} and n_2 * {num} <= n_1 * {den}"
    room = f"{den + num} * least(n_1 - at_1, n_2 - at_2) >= {num} * (n_1 + n_2)"
    found = side(1).where("component_1 <> main").join(side(2).drop("main"), "gram").where(f"{other} and {sizes} and {room}")
    return found.select(F.least("doc_id_1", "doc_id_2").alias("u"), F.greatest("doc_id_1", "doc_id_2").alias("v")).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_copies, is_kept.

    Two documents link when den * intersection >= num * union of their sets of n-word shingles (words: `[^\\x20\\x09-\\x0D]+`, A-Z
    lower-cased; with fewer words the whole sequence is the one shingle). component_id is the smallest doc_id that links reach.
    is_kept marks the document whose id is the component's. n_copies counts the documents with an equal set, itself included.

    Null or empty texts and texts without words have n_shingles 0 and are their own component. A null doc_id takes no part: its
    component_id is null. Rows that share a doc_id count as one document. Extra columns, and those with clashing names, are ignored.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prep = written(in_batches(texts, _prepare(n, num, den), _PREP), "prep")
    each = prep.where("n is not null").select("doc_id", "n", "d1", "d2")
    classes = written(each.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    member = each.join(classes, ["n", "d1", "d2"], "left")
    copies = written(member.where("rep <> doc_id").select("doc_id", "d1", "d2").distinct(), "copies")

    alone = prep.where("code is not null and doc_id is not null").join(small(copies), ["doc_id", "d1", "d2"], "left_anti")
    rows = alone.select("doc_id", "code", "spare", F.explode("sigs").alias("sig"))
    # one shuffle of the signatures: few occur twice, and a signature's rows are at most one for each document, of all that it has
    shared = rows.withColumn("often", F.count("*").over(Window.partitionBy("sig"))).where("often > 1")
    by = Window.partitionBy("doc_id", "code")
    shared = shared.withColumn("m", F.count("*").over(by)).withColumn("weight", F.sum("often").over(by))
    shared = shared.withColumn("r", F.row_number().over(by.orderBy("often", "sig"))).where("r <= m - spare")
    buckets = written(shared.select("sig", "doc_id", "weight"), "buckets")
    drop(copies)

    star = buckets.groupBy("sig").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("less"))).alias("top"), F.count("*").alias("m")).where("m > 1").select("sig", (-F.col("top.less")).alias("pivot"))
    pairs = written(buckets.join(star, "sig").where("doc_id <> pivot").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct(), "pairs")
    ids = small(written(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "ids"))
    # a repeated doc_id may stand for several sets; links of any of them count
    marks = written(prep.where("size(bits) > 0").join(ids, "doc_id", "left_semi").select("doc_id", "d1", "n", "bits").dropDuplicates(["doc_id", "d1", "n"]), "marks")
    segments = in_batches(texts.join(ids, "doc_id", "left_semi"), _segments(n), _SEGMENTS)
    if not each.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        segments = segments.dropDuplicates(["doc_id", "d1", "f"])  # rows that repeat an id and a text
    segments = written(segments, "segments")
    near = written(_promising(pairs, marks, num, den), "promising")
    found = connected_components(_linked(near, segments, num, den))
    drop(pairs, near)

    of = buckets.join(found, buckets.doc_id == found.node, "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    torn = of.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("sig")
    members = written(of.join(torn, "sig").select("doc_id", "component").distinct(), "members")
    cross = written(_between_components(segments, small(members), num, den), "cross")
    near = written(_promising(cross, marks, num, den), "promising")
    more = written(_linked(near, segments, num, den), "links")
    if not more.isEmpty():
        # stars keep what is already known; only the new links are added to them
        found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    drop(buckets, members, marks, segments, cross, near, more)

    out = member.join(found, member.rep == found.node, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")).withColumn("is_kept", F.col("doc_id") == F.col("component_id"))
