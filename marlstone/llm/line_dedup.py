"""Line dedup: a suffix array over sequences of line ids, built by distributed prefix doubling, shows repeated runs of lines.

Lines without words stay where they are and take no part. A line that occurs once can't be in a repeated run, so the sequences are the
contiguous stretches of lines that occur twice or more. Rank 0 of a position is the rank of its line; rank j + 1 is the rank of the pair
(rank j here, rank j 2^j lines on): the order of suffixes by their first 2^(j+1) lines. Ranks are dense and global, made by sorting the
distinct pairs over all partitions.

Positions whose suffixes share their first n lines form a longest-common-prefix interval; two overlapping blocks of 2^j lines name it:
(n, rank j at the start, rank j at the end). A repeated run of at least min_words words is the union of its shortest stretches of that many
words, forwards from each of its lines and backwards from each: so the intervals of these stretches show all maximal repeated runs.
The first copy (in the order of documents) of each stretch stays; later ones are deleted. The first occurrence of every line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, small, written

MIN_WORDS = 50
#: A stretch with more copies than this is common: the first copies of such stretches are few (at most one in HOT rows) and looked up apart.
HOT = 128
#: Deleted lines are broadcast if they are at most so many integers, ids included (8 MB); else documents are shuffled to them.
MOST_REMOVED = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _plain(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def dense_ranks(keys: DataFrame, out: str) -> DataFrame:
    """keys (distinct rows) as a written table with their ranks from 0, in the order of all columns. Only a count for each partition is gathered."""
    cols = keys.columns
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the place in the partition is in the low 33 bits
    marked = written(keys.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_id", 33)
    counts = {r.p: r.n for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not before:
        return marked.select(*cols, F.col("_id").alias(out))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), part)
    ranked = marked.select(*cols, (offset + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long").alias(out))
    ranked._marlstone_path = marked._marlstone_path
    return ranked


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), pos (place among its lines with words), place (among all its lines), words, r0 (rank of the line): of
    lines that occur twice or more."""
    placed = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("place"), x.alias("line"))), lambda x: _plain(x["line"]) != "")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(placed).alias("pos", "at"))
    rows = rows.select("doc_id", "h", "pos", "at.place", "at.line")
    rows = rows.select("doc_id", "h", "pos", "place", F.size(F.split(_plain(F.col("line")), " +")).alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"))
    often = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    ranks = dense_ranks(often, "r0")
    return rows.join(ranks, ["a", "b"]).select("doc_id", "h", "pos", "place", "words", "r0").dropDuplicates(["doc_id", "h", "pos"])


def doubled(positions: DataFrame, j: int) -> DataFrame:
    """positions with rank r<j+1>, from r<j> here and 2^j lines on in the same stretch."""
    by = Window.partitionBy("doc_id", "h").orderBy("pos")
    step = 1 << j
    there = F.when(F.lead("pos", step).over(by) == F.col("pos") + step, F.lead(f"r{j}", step).over(by))
    paired = written(positions.withColumn("x", F.col(f"r{j}")).withColumn("y", F.coalesce(there, F.lit(-1))), "pairs")
    ranks = dense_ranks(paired.select("x", "y").distinct(), f"r{j + 1}")
    out = written(paired.join(ranks, ["x", "y"]).drop("x", "y"), "positions")
    drop(paired, ranks)
    return out


def _stretches(a: Column, i: Column, n: Column, min_words: int) -> Column:
    """The shortest stretches of min_words words from line i on forwards and backwards, as (s, e) places in the array a."""
    at = lambda k: F.get(a, k)
    reach = lambda lo, hi: (at(hi)["sum"] - at(lo)["sum"] + at(lo)["words"] >= min_words) & (at(hi)["pos"] - at(lo)["pos"] == hi - lo)
    e = F.array_min(F.filter(F.sequence(i, F.least(n - 1, i + min_words - 1)), lambda k: reach(i, k)))
    b = F.array_max(F.filter(F.sequence(F.greatest(F.lit(0), i - min_words + 1), i), lambda k: reach(k, i)))
    return F.array(F.struct(i.alias("s"), e.alias("e")), F.struct(b.alias("s"), i.alias("e")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, removed (sorted places of deleted lines). docs: doc_id, text."""
    positions = written(repeated_lines(docs), "positions")
    most = max(1, min_words)
    levels = 0
    longest = positions.groupBy("doc_id", "h").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while 2 << levels <= min(most, longest):
        nxt = doubled(positions, levels)
        drop(positions)
        positions, levels = nxt, levels + 1
    by = Window.partitionBy("doc_id", "h").orderBy("pos")
    ranks = [f"r{j}" for j in range(levels + 1)]
    summed = positions.withColumn("sum", F.sum("words").over(by))
    whole = summed.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "place", "words", "sum", F.array(*ranks).alias("r")))).alias("a"))
    whole = whole.withColumn("n", F.size("a"))
    runs = whole.select("doc_id", "h", "a", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _stretches(F.col("a"), i, F.col("n"), min_words))))).alias("run"))
    runs = runs.where("run.s is not null and run.e is not null").withColumn("n", F.col("run.e") - F.col("run.s") + 1)
    j = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    rank = lambda place, level: F.get(F.get("a", place)["r"], level)
    places = F.transform(F.slice("a", F.col("run.s") + 1, F.col("n")), lambda x: x["place"])
    runs = runs.select("doc_id", "h", "n", places.alias("places"), F.get("a", F.col("run.s"))["pos"].alias("pos"), rank(F.col("run.s"), j).alias("x"), rank(F.col("run.e") - F.pow(F.lit(2.0), j).cast("int") + 1, j).alias("y"))
    runs = written(runs, "runs")
    where = F.struct("doc_id", "h", "pos")
    name = ["n", "x", "y"]
    first = written(runs.groupBy(*name).agg(F.min(where).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "first")
    # the rows of a common stretch would all meet in one task: they are held against a broadcast table where they are
    common = small(first.where(F.col("copies") > HOT).drop("copies"))
    rest = runs.join(common.select(*name), name, "left_anti").join(first.where(F.col("copies") <= HOT).drop("copies"), name)
    later = runs.join(common, name).unionByName(rest).where(where != F.col("first"))
    gone = later.select("doc_id", "h", F.explode("places").alias("line")).distinct()
    out = written(gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line")).alias("removed")), "removed")
    drop(positions, runs, first)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text cleaned, and with n_lines, removed_lines (array of the places of deleted lines, from 0) and removed_chars.

    A line is deleted if it is in a run of whole lines with at least min_words words in all that also stands earlier: in a document of a
    smaller id, or further up in the same one. Its line break goes with it. Nothing else changes; a document of which nothing is left
    has an empty text. Lines are compared exactly; words are parted by blanks.

    A null text stays null; rows with a null id stay as they are and count for nothing. Rows that repeat an id and a text are one document.
    Columns of docs that have the names of the added ones are replaced. An empty table gives an empty result.
    """
    added = ("n_lines", "removed_lines", "removed_chars")
    keep = [c for c in docs.columns if c not in added]
    gone = repeated_runs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), min_words)
    gone = small(gone, MOST_REMOVED, 4 + F.size("removed"))
    # in one column, the names of docs can't clash with those made here
    rows = docs.select(F.struct(*keep).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(gone, ["doc_id", "h"], "left")
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains("removed", i)), "\n")
    out = joined.withColumn("new", F.when(F.col("removed").isNotNull(), kept).otherwise(F.col("text")))
    cols = [(F.col("new") if c == text_col else F.col("row").getField(c)).alias(c) for c in keep]
    return out.select(
        *cols, F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce(F.char_length("text") - F.char_length("new"), F.lit(0)).alias("removed_chars"),
    )
