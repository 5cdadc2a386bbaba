"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document is copied n times, where n inverts a Poisson distribution with its source's mean repetition rate at a uniform number that
is hashed from seed and document. Documents decide alone, so a hot source needs no gathering; counts are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

SEED = 17
#: Poisson numbers with larger means are sums of ones with at most this mean.
LARGEST_MEAN = 256.0


def uniform(*parts: Column) -> Column:
    """In (0, 1), hashed from the parts: the first 13 hexadecimal digits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", size: Column | None = None, total: float | None = None) -> DataFrame:
    """(source, rate): the mean number of copies at which each source gets its share of the mix.

    A source's share is its weight over the sum of the weights of the sources that are there; without weights, all shares are equal.
    Sources that the weights don't name get none. total is the size of the mix (default: that of docs). size defaults to the text's
    number of characters plus one. Documents without a source form a source of their own, named ''.
    """
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1 if size is None else size
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sizes = docs.select(source.alias("source"), size.cast("double").alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    weight = F.lit(1.0)
    if weights is not None:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(F.broadcast(table), "source", "left")  # a parameter, not data
        weight = F.coalesce("weight", F.lit(0.0))
    sizes = sizes.withColumn("w", weight)
    # two sums over the sources
    whole = sizes.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_size"))
    goal = F.col("all_size") if total is None else F.lit(float(total))
    return sizes.crossJoin(F.broadcast(whole)).select("source", F.coalesce(F.try_divide(F.col("w") * goal, F.col("all_w") * F.col("size")), F.lit(0.0)).alias("rate"))


def with_steps(rates_: DataFrame) -> DataFrame:
    """rates with parts (how many Poisson numbers make one) and steps: the distribution function of one, until it is 1 to 15 digits."""
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("sum"), F.array(F.exp(-F.col("mean"))).alias("steps"))

    def add(acc, k):
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["steps"], F.array(acc["sum"] + p)).alias("steps"))

    return rates_.withColumn("parts", parts).withColumn("mean", mean).withColumn("steps", F.aggregate(F.sequence(F.lit(1), most), start, add, lambda acc: acc["steps"])).select("source", "rate", "parts", "steps")


def replicate(docs: DataFrame, rates_: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with n_copies, copy (from 1) and shuffle_key, a row for each copy, in no particular order. See mix."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # in one column, the names of docs can't clash with those made here
    rows = docs.select(F.struct(*docs.columns).alias("row"), text(id_col).alias("who"), text(source_col).alias("source"))
    joined = rows.join(small(written(with_steps(rates_), "rates")), "source").withColumn("u", uniform(F.lit(str(seed)), F.col("who"), F.lit("1")))
    one = lambda c: F.size(F.filter("steps", lambda s: s <= uniform(F.lit(str(seed)), F.col("who"), c.cast("string"))))
    first = F.size(F.filter("steps", lambda s: s <= F.col("u")))
    more = F.aggregate(F.sequence(F.lit(2), F.col("parts")), F.lit(0), lambda n, c: n + one(c))
    counted = joined.select("row", "who", (first + F.when(F.col("parts") > 1, more).otherwise(0)).cast("long").alias("n_copies"))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    shuffle = uniform(F.lit(f"{seed}s"), F.col("who"), F.col("copy").cast("string"))
    return copies.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "n_copies", "copy", shuffle.alias("shuffle_key"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, total: float | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of docs with n_copies, copy and shuffle_key: documents copied to the target weights and shuffled globally.

    shuffle_key is uniform, so equal ranges of it make even partitions without sampling; rows are dealt to them and ordered by the key within
    (ties by id and copy). A null or empty text has
    size 1; a null source is the source ''; a null id counts as ''. Rows that share an id get the same number of copies. Columns of docs
    with the names of the added ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    out = replicate(docs, rates(docs, weights, source_col, total=total), seed, id_col, source_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key", id_col, "copy")
