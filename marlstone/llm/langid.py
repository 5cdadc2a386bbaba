"""Language identification by Bayesian evidence fusion.

Evidence of a document: its whole text, by hashed byte 3-grams under a multinomial model of each language; the language that its markup or
metadata declares; and a prior of its host. Priors are counts of the languages that texts speak for, by grouped aggregation over all
rows, smoothed hierarchically: host towards registered domain, that towards the address suffix, that towards the whole corpus.
One more language, 'und', spreads evenly over all 3-grams: text that no language explains better than chance belongs to it and is rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, small, utf8_view, written

BUCKETS = 1 << 16
#: The model is fitted to at most about so many distinct texts of each label, picked by hash; texts are scored by BLOCK languages at a time.
SAMPLE, BLOCK = 400, 32
ALPHA = 0.5
#: The 3-grams of a text overlap: each byte is in three, so n of them count as n / 3 independent ones. A declaration is right so often; weight
#: of a prior's parent; prior of 'und'.
GRAM_WEIGHT, DECLARED, KAPPA, UNKNOWN = 1 / 3, 0.9, 20.0, 1e-3
UND = "und"


def _lower() -> np.ndarray:
    code = np.arange(256, dtype=np.uint32)
    code[ord("A") : ord("Z") + 1] += 32
    code[[9, 10, 11, 12, 13]] = 32
    return code


_CODE = _lower()


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte 3-grams of one or more texts, one for each byte but the last two."""
    c = _CODE[data]
    x = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _texts(column):
    """(bytes, offsets) in runs of rows of about 256 KB."""
    data, offsets = utf8_view(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 18), side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _count(batches):
    import pyarrow as pa

    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(1).to_pylist()
        at = 0
        for data, offsets in _texts(batch.column(0)):
            for k in range(len(offsets) - 1):
                part = data[offsets[k] : offsets[k + 1]]
                table = tables.setdefault(labels[at], np.zeros(BUCKETS, np.int64))
                at += 1
                if len(part) > 2:
                    table += np.bincount(grams(part), minlength=BUCKETS)
    for label, table in tables.items():
        i = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(i), pa.string()), pa.array(i), pa.array(table[i])], names=["label", "i", "n"])


class Model:
    """Log probabilities of buckets: languages x BUCKETS, of which only those apart from a language's floor are held."""

    def __init__(self, floors: np.ndarray, at: list[np.ndarray], values: list[np.ndarray]):
        self.floors, self.at, self.values = floors, at, values

    def __len__(self) -> int:
        return len(self.floors)

    def blocks(self):
        """Dense tables, a row a bucket, of at most BLOCK languages each."""
        for lo in range(0, len(self), BLOCK):
            table = np.tile(self.floors[lo : lo + BLOCK], (BUCKETS, 1))
            for k in range(table.shape[1]):
                table[self.at[lo + k], k] = self.values[lo + k]
            yield table


def fit(rows: DataFrame) -> tuple[list[str], Model]:
    """From rows (text, label): all labels that occur, with UND as the last, and their model. Sampled rows are bounded: see SAMPLE."""
    rows = rows.where(F.col("label").isNotNull() & (F.col("label") != UND) & F.col("text").isNotNull())
    rows = rows.select("text", "label", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("texts")).collect()
    languages = sorted(r["label"] for r in sizes)
    flat = np.float32(-np.log(BUCKETS))
    if not languages:
        return [UND], Model(np.array([flat]), [np.zeros(0, np.int32)], [np.zeros(0, np.float32)])
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["label"], min(1.0, SAMPLE / max(1, r["texts"])))))
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, F.col("label")) * float(1 << 30)).dropDuplicates(["label", "h"])
    counts = in_batches(picked.select("text", "label"), _count, "label string, i long, n long").groupBy("label", "i").agg(F.sum("n").alias("n"))
    found = counts.select(F.array_position(F.array(*map(F.lit, languages)), F.col("label")).cast("int").alias("l"), F.col("i").cast("int").alias("i"), F.col("n").cast("int").alias("n")).toArrow()
    which, i, n = (found.column(k).to_numpy().astype(np.int32) for k in range(3))
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(len(languages) + 1), side="right")
    floors, at, values = [], [], []
    for lo, hi in zip(ends, ends[1:]):
        own = n[order[lo:hi]].astype(np.float64)
        total = own.sum() + ALPHA * BUCKETS
        floors.append(np.log(ALPHA / total))
        at.append(i[order[lo:hi]])
        values.append(np.log((own + ALPHA) / total).astype(np.float32))
    return [*languages, UND], Model(np.array([*floors, flat], np.float32), [*at, np.zeros(0, np.int32)], [*values, np.zeros(0, np.float32)])


def _score(model: Model, text_at: int):
    def run(batches):
        import pyarrow as pa

        dense = list(model.blocks()) if len(model) <= BLOCK else None  # else made again for each batch, one at a time
        for batch in batches:
            blocks, counts = [], [np.zeros(0, np.int64)]
            for by_gram in dense or model.blocks():
                sums, counts = [], [np.zeros(0, np.int64)]
                for data, offsets in _texts(batch.column(text_at)):
                    n = np.maximum(np.diff(offsets) - 2, 0)
                    out = np.zeros((len(n), by_gram.shape[1]))
                    full = np.flatnonzero(n)
                    if len(full):
                        each = by_gram[grams(data)].astype(np.float64)
                        total = np.add.reduceat(each, offsets[full], axis=0)
                        # a text's last two positions reach into the next text: take them off
                        for back in (1, 2):
                            at = offsets[full + 1] - back
                            inside = at < len(each)
                            total[inside] -= each[at[inside]]
                        # what lies between the ends of two texts that have 3-grams, in texts that have none
                        gap = np.append(offsets[full[1:]], len(data)) - offsets[full + 1]
                        for k in np.flatnonzero(gap > 0):
                            total[k] -= each[offsets[full[k] + 1] : offsets[full[k] + 1] + gap[k]].sum(0)
                        out[full] = total
                    sums.append(out)
                    counts.append(n)
                blocks.append(np.concatenate([np.zeros((0, by_gram.shape[1])), *sums]))
            flat = np.concatenate(blocks, axis=1).reshape(-1)
            n = np.concatenate(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(model), pa.int32()), pa.array(flat))
            keep = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            names = [batch.schema.names[i] for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n.astype(np.int64)), lists], names=[*names, "n_grams", "loglik"])

    return run


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host with dots; '' without."""
    return F.when(F.locate(".", host) > 0, F.substring_index(host, ".", -1)).otherwise("")


def host_priors(votes: DataFrame, n: int) -> DataFrame:
    """From rows (host, vote: the place of a language, or null): (host, prior: an array of n log probabilities), smoothed level by level."""
    cast = written(votes.groupBy("host", "vote").agg(F.count("*").cast("double").alias("c")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "votes")

    def tally(by):
        """Counts of all n languages by `by`; columns don't grow with n."""
        sums = cast.groupBy(*by, "vote").agg(F.sum("c").alias("c"))
        some = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("vote", "c")))).alias("m"))
        return some.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).drop("m")

    hosts = tally(["host", "domain", "suffix"])
    whole = tally([])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    top = whole.select(F.transform("c", lambda x: (x + 1.0) / (total(F.col("c")) + float(n))).alias("up"))
    smooth = lambda df, out: df.withColumn("_out", F.zip_with("c", "up", lambda x, u: (x + KAPPA * u) / (total(F.col("c")) + KAPPA))).drop("c", "up").withColumnRenamed("_out", out)
    suffixes = smooth(tally(["suffix"]).crossJoin(F.broadcast(top)), "up")  # top is one row
    domains = smooth(tally(["domain", "suffix"]).join(suffixes, "suffix"), "up").drop("suffix")
    return smooth(hosts.drop("suffix").join(domains, "domain"), "prior").select("host", F.transform("prior", lambda p: F.log(p)).alias("prior"))


def identify(rows: DataFrame, training: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """From rows (key columns..., text, declared, host): the keys with n_grams, declared, host, language, probability, is_kept.

    training (text, label) defaults to the rows' own texts and declared languages; only a bounded sample of it is used. language is the
    most probable one (ties: the first by name). is_kept is false for 'und', for languages below probability `least`, and for texts
    without a 3-gram: their evidence is not of a language.

    A null text is empty; a null or unknown declaration is no evidence; a null host is the host ''. Repeated rows are judged alike, null
    keys are passed on, an empty table gives an empty result. Key columns may have any names; those with the names of the added columns are
    replaced.
    """
    keys = [c for c in rows.columns if c not in ("text", "declared", "host", "n_grams", "language", "probability", "is_kept")]
    whose = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))  # in one column, their names can't clash with those made here
    clean = rows.select(whose.alias("whose"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lower("declared").alias("declared"), F.coalesce(F.lower("host"), F.lit("")).alias("host"))
    training = clean.select("text", F.col("declared").alias("label")) if training is None else training
    languages, model = fit(training)
    n = len(languages)
    schema = T.StructType([f for f in clean.schema.fields if f.name != "text"] + [T.StructField("n_grams", T.LongType()), T.StructField("loglik", T.ArrayType(T.DoubleType()))])
    scored = written(in_batches(clean, _score(model, clean.columns.index("text")), schema), "scores")
    scored = scored.withColumn("text_ll", F.transform("loglik", lambda x: x * GRAM_WEIGHT))
    known = F.array(*(F.lit(x) for x in languages[:-1])) if n > 1 else F.array().cast("array<string>")
    best = F.array_position(F.col("text_ll"), F.array_max("text_ll")).cast("int") - 1
    votes = scored.select("host", F.when((F.col("n_grams") > 0) & (best < n - 1), best).alias("vote"))
    priors = host_priors(votes, max(1, n - 1)) if n > 1 else None
    joined = scored.join(small(written(priors, "priors"), 100_000), "host") if priors is not None else scored.withColumn("prior", F.array().cast("array<double>"))
    says = F.transform(known, lambda x: F.when(F.array_contains(known, F.col("declared")), F.when(x == F.col("declared"), float(np.log(DECLARED))).otherwise(float(np.log((1 - DECLARED) / max(1, n - 2))))).otherwise(0.0))
    neutral = F.when(F.array_contains(known, F.col("declared")), float(np.log(1 / max(1, n - 1)))).otherwise(0.0)
    prior = F.concat(F.transform("prior", lambda p: p + float(np.log(1 - UNKNOWN))), F.array(F.lit(float(np.log(UNKNOWN)))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = joined.withColumn("post", add(add(F.col("text_ll"), prior), F.concat(says, F.array(neutral)))).withColumn("top", F.array_max("post"))
    probability = 1.0 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    at = F.array_position(F.col("post"), F.col("top")).cast("int") - 1
    fused = fused.withColumn("language", F.get(F.array(*(F.lit(x) for x in languages)), at)).withColumn("probability", probability)
    kept = (F.col("n_grams") > 0) & (F.col("language") != UND) & (F.col("probability") >= least)
    return fused.select(*(F.col("whose")[c].alias(c) for c in keys), "n_grams", "declared", "host", "language", "probability", kept.alias("is_kept"))


def html_language(html: Column) -> Column:
    """The primary language that the html element declares; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def html_text(html: Column) -> Column:
    """The text of html without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
