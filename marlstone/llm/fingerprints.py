"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text of any length and script is a sequence of characters. A run of K characters is chosen if the least hash of the runs of S characters
inside it stands at one of its two ends (a closed syncmer). That depends on the K characters alone, so equal passages give equal anchors
wherever they stand; a text of 2 K - S - 1 characters or more has at least one. The fingerprint is all anchors in the order of their
positions; none is left out. A text of two parts has the anchors of its parts and those across the seam, so an edited text's are put
together from what is known of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 12
S = 4
_NONE = "array<struct<at:int,anchor:bigint>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _syncmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: the position and hash of each closed syncmer of column text (not null), in the order of positions."""
    df = df.withColumn("_c", F.split(text, ""))
    inner = lambda i: F.xxhash64(*(F.get("_c", i + j) for j in range(S)))
    df = df.withColumn("_h", F.when(F.size("_c") >= K, F.transform(F.sequence(F.lit(0), F.size("_c") - S), inner)).otherwise(F.array().cast("array<bigint>"))).drop("_c")
    at = lambda i, j: F.get("_h", i + j)
    last = K - S
    chosen = F.filter(F.sequence(F.lit(0), F.size("_h") - 1 - last), lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*(at(i, j) for j in range(1, last))))
    anchors = F.transform(chosen, lambda i: F.struct(i.alias("at"), F.xxhash64(*(at(i, j) for j in (*range(0, last, S), last))).alias("anchor")))
    return df.withColumn(out, F.when(F.size("_h") > 0, anchors.cast(_NONE)).otherwise(_none())).drop("_h")


def _or_whole(syncmers: str, text: str) -> Column:
    """The syncmers; of a text too short to have one, a single anchor of the whole text; none if it is blank."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(text).alias("anchor"))).cast(_NONE)
    return F.when(F.size(syncmers) > 0, F.col(syncmers)).when(F.trim(text) != "", whole).otherwise(_none())


def digest(fingerprint: Column) -> Column:
    """A fingerprint as a short string: 32 hexadecimal digits of all anchors with their positions, and their number."""
    half = lambda k: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), fingerprint))), 16, "0")
    return F.concat(half(1), half(2), F.lit("-"), F.size(fingerprint).cast("string"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: the fingerprint of column text, an array of (at, anchor). A null or blank text has an empty one."""
    df = _syncmers(df.withColumn("_t", F.coalesce(text, F.lit(""))), "_t", "_s")
    return df.withColumn(out, _or_whole("_s", "_t")).drop("_s", "_t")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with column out: of the distinct anchors in fingerprints a and b, the share that both have and that follows the same shared anchor
    (or none) in both, by first positions; 1 if both are empty. Copies give 1; a passage that has moved loses only its seams."""
    df = df.withColumn("_a", F.array_distinct(f"{a}.anchor")).withColumn("_b", F.array_distinct(f"{b}.anchor"))
    df = df.withColumn("_ab", F.array_intersect("_a", "_b")).withColumn("_ba", F.array_intersect("_b", "_a"))
    links = lambda c: F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i - 1)))
    union = F.size("_a") + F.size("_b") - F.size("_ab")
    found = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(links("_ab"), links("_ba"))) / union)
    return df.withColumn(out, found).drop("_a", "_b", "_ab", "_ba")


def with_next(df: DataFrame, id_col: str, fields: list[str], made=None) -> DataFrame:
    """df with next_<field> of the row that follows in descending id_col (ties: descending first field; nulls last); after the last, the first.

    made(df) adds columns, which may be among the fields, where rows have been dealt: they are made once for a row and its predecessor, and
    not shuffled. Rows are dealt to ranges of the id, each ordered by itself; the first row of each range is also put behind the range before it. Only
    the ranges' bounds pass through the driver. An empty table stays empty.
    """
    spark = df.sparkSession
    n = min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = df.select(F.col(id_col).alias("i"))
    found = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 10 * n)).first()[0]
    bounds = sorted(set(found or []))
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]

    def bucket(c: Column) -> Column:
        """How many bounds are at most c, by binary search."""
        all_ = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
        step = lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(all_, at + s) <= c), at + s).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)

    tops = {r.b: r.i for r in ids.groupBy(bucket(F.col("i")).alias("b")).agg(F.max("i").alias("i")).collect()}
    order = sorted(tops, reverse=True)
    before = {tops[b]: order[k - 1] for k, b in enumerate(order)}  # the first range comes behind the last
    marked = df.withColumn("_b", bucket(F.col(id_col))).withColumn("_guest", F.lit(False))
    if not before:
        guests = marked.limit(0)
    elif None in before:  # a range of nothing but null ids
        guests = marked.where(F.col(id_col).isNull() | F.col(id_col).isin([i for i in before if i is not None]))
    else:
        guests = marked.where(F.col(id_col).isin(list(before)))
    to = F.create_map(*(F.lit(x) for pair in before.items() if pair[0] is not None for x in pair)) if any(i is not None for i in before) else None
    goes = F.lit(before.get(None, 0)) if to is None else F.coalesce(F.try_element_at(to, F.col(id_col)), F.lit(before.get(None, 0)))
    both = marked.unionByName(guests.withColumn("_b", goes.cast("int")).withColumn("_guest", F.lit(True)))
    w = Window.partitionBy("_b").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.col(fields[0]).desc_nulls_last())
    dealt = both.repartition("_b")
    dealt = dealt if made is None else made(dealt)
    out = dealt.withColumn("_next", F.lead(F.struct(*fields)).over(w)).where(~F.col("_guest")).drop("_b", "_guest")
    return out.select(*(c for c in out.columns if c != "_next"), *(F.col(f"_next.{f}").alias(f"next_{f}") for f in fields))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, in
    descending doc_id (after the last: the first; rows that share an id: descending text). A null text is empty; a null doc_id comes
    last. Fingerprints are arrays of (at, anchor) with positions from 0; empty and blank texts have an empty one. Extra columns are
    ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text", "text_s"], lambda dealt: _syncmers(dealt, "text", "text_s"))
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(n / 2).cast("int")).withColumn("head", n - F.floor(n / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("head")), F.substring("next_text", F.lit(1), F.col("half"))))
    rows = rows.withColumn("from", F.greatest(F.col("head") - (K - 1), F.lit(0)))
    rows = rows.withColumn("seam", F.substring("edited", F.col("from") + 1, F.col("head") - F.col("from") + F.least(F.col("half"), F.lit(K - 1))))
    rows = _syncmers(rows, "seam", "seam_s")
    moved = lambda c, by: F.transform(c, lambda x: F.struct((x["at"] + by).alias("at"), x["anchor"].alias("anchor")))
    parts = F.concat(
        F.filter("text_s", lambda x: x["at"] + K <= F.col("head")),
        moved("seam_s", F.col("from")),
        moved(F.filter("next_text_s", lambda x: x["at"] + K <= F.col("half")), F.col("head")),
    )
    rows = rows.withColumn("edited_s", parts)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _or_whole("text_s", "text").alias("fingerprint"), _or_whole("edited_s", "edited").alias("edited_fingerprint"),
        _or_whole("next_text_s", "next_text").alias("next_fingerprint"),
    )
    rows = with_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    return with_likeness(rows, "fingerprint", "next_fingerprint", "near_next").drop("next_fingerprint")
