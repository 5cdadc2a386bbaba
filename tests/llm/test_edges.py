"""Clashing columns, odd rows and stages of the pipeline, each against a plainer version of itself."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import chat, fingerprints, langid, line_dedup, mixing, ngram_join, packing, queries, topk, url_filter, warc
from marlstone.llm.common import shared_dir

from .test_llm import DOCS, EDGES, brute_components, brute_lines, docs

#: Names that operators make or use inside.
CLASH = (
    "row", "h", "new", "who", "u", "v", "n", "n_u", "d1", "sig", "bits", "often", "component", "component_id", "node", "n_grams", "loglik", "language", "prior", "post", "top", "whose", "rate", "steps", "parts",
    "n_copies", "copy", "shuffle_key", "removed", "removed_lines", "n_lines", "_id", "_h", "_to", "_seen", "_b", "_guest", "_next", "next_text", "half", "edited", "fingerprint", "digest", "response_id", "host", "path", "rule", "action",
    "rank", "score", "query_id", "example", "t", "loss_start", "start", "length", "ids",
)


def clashing(df, keep=()):
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns and c not in keep})


def same(a, b, cols=None):
    cols = cols or [c for c in a.columns if c in b.columns]
    rows = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert rows(a) == rows(b)


TEXTS = [*EDGES, *("word%d " % i * 30 + "tail\nline of its own" for i in range(6))]


@pytest.mark.parametrize("run", [ngram_join.jaccard_components, packing.pack, fingerprints.fingerprints, lambda df: line_dedup.dedup_lines(df, 5), mixing.mix], ids=["ngram_join", "packing", "fingerprints", "line_dedup", "mixing"])
def test_columns_of_documents_may_clash(spark, run):
    df = docs(spark, TEXTS).coalesce(1)
    plain = run(df)
    same(plain, run(clashing(df)), plain.columns)


def test_columns_of_the_other_tables_may_clash(spark):
    rows = docs(spark, TEXTS).select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    plain = langid.identify(rows)
    same(plain, langid.identify(clashing(rows, ("text", "declared", "host"))), plain.columns)
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>a"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    same(url_filter.judge_urls(pages), url_filter.judge_urls(clashing(pages)))
    got = []
    for i, df in enumerate((pages, clashing(pages))):
        warc.write_archives(df, f"{shared_dir(spark)}/clash-{i}")
        got.append(warc.assemble(warc.read_records(spark, f"{shared_dir(spark)}/clash-{i}")).drop("request", "metadata"))
    same(*got)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    same(topk.search(vectors, vectors), topk.search(clashing(vectors), clashing(vectors)))
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    same(chat.read_back(chat.examples(turns)), chat.read_back(chat.examples(clashing(turns))))


def test_packing_prefers_ends(spark):
    rnd = random.Random(3)
    texts = [" ".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(rnd.randint(6, 24))).capitalize() + "." for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    pieces = packing.pack(docs(spark, texts).coalesce(1), 1024).collect()
    last = {}
    for r in pieces:
        if r.sequence_id not in last or r.offset > last[r.sequence_id].offset:
            last[r.sequence_id] = r
    import public_tokenizers

    _, sentence = packing.gpt2_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ends = [r.start + r.length == r.doc_tokens or bool(sentence[r.ids[-1]]) for r in last.values()]
    tokens = [i for r in pieces for i in r.ids]
    chance = np.mean([bool(sentence[i]) for i in tokens])
    assert np.mean(ends) > 0.8 and chance < 0.15
    padding = sum(0 if r.sequence_tokens & (r.sequence_tokens - 1) == 0 else 1024 - r.sequence_tokens for r in last.values())
    assert padding < 0.01 * len(tokens)


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "x. y")], "doc_id long, text string")
    rows = packing.pack(df, 1024).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == {None: 1, 1: 2, 2: 1}
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id == 1)


def test_short_windows_of_best_cuts_are_optimal():
    rnd = random.Random(4)
    for _ in range(30):
        p = np.cumsum([0] + [rnd.randint(1, 40) for _ in range(40)])
        pen = [rnd.randint(0, 6) for _ in p]
        short = packing.short_windows(p, 128)
        _, total = packing.best_cuts(p.tolist(), pen, 128, short)
        best = [0] + [math.inf] * 40
        for j in range(1, 41):
            for i in range(j):
                n = int(p[j] - p[i])
                if n <= 128:
                    free = n & (n - 1) == 0 and n >= packing.LEAST_SHORT
                    best[j] = min(best[j], best[i] + (0 if free else 128 - n) + pen[j])
        assert [t - x for t, x in zip(total, p.tolist())] == best


def test_archives_of_nothing_and_of_long_pages(spark):
    pages = spark.createDataFrame([(1, "http://a", "é" * 3_000_000), (2, "http://b", "")], "page_id long, url string, html string")
    for name, df in (("none", pages.limit(0)), ("long", pages)):
        warc.write_archives(df, f"{shared_dir(spark)}/warc-{name}")
    read = lambda name: warc.assemble(warc.read_records(spark, f"{shared_dir(spark)}/warc-{name}", with_payload=False))
    assert read("none").count() == 0
    assert {r.page_id: r.payload_bytes for r in read("long").collect()} == {1: 6_000_000, 2: 0}


def test_fingerprints_with_ties(spark):
    df = spark.createDataFrame([(1, "a" * 40), (1, "b" * 40), (0, "c" * 40), (0, None)], "doc_id long, text string")
    rows = fingerprints.fingerprints(df).collect()
    assert len(rows) == 4 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    digests = [r.x for r in fingerprints.fingerprints(df).select(fingerprints.digest(F.col("fingerprint")).alias("x")).collect()]
    assert len(set(digests)) == 4 and all(len(x) > 33 for x in digests)


def test_likeness_is_that_of_shared_anchors(spark):
    """Against a brute-force version over the anchors themselves."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    text = lambda: [rnd.choice(words) for _ in range(80)]
    rows = []
    for i in range(12):
        a, b = text(), text()
        rows.append((i, " ".join(a), " ".join(a[: 10 * (i % 6)] + b)))
    df = fingerprints.with_anchors(fingerprints.with_anchors(spark.createDataFrame(rows, "i long, a string, b string"), "a", "x"), "b", "y")
    for r in fingerprints.with_likeness(df, "x", "y", "v").collect():
        x, y = (list(dict.fromkeys(p.anchor for p in side)) for side in (r.x, r.y))
        pairs = [{(s[k], s[k - 1] if k else None) for k in range(len(s))} for s in ([a for a in x if a in set(y)], [a for a in y if a in set(x)])]
        assert r.v == pytest.approx(len(pairs[0] & pairs[1]) / len(set(x) | set(y)))


def test_url_weights_are_those_of_gradient_descent(spark):
    rows = [(u, 1) for u in url_filter.BLOCKED] + [(u, 0) for u in url_filter.ORDINARY]
    weights = url_filter.train(url_filter.labelled_urls(spark))
    u = F.col("url")
    cells = spark.createDataFrame(rows, "url string, y int").select("y", url_filter.features(url_filter.host_of(u), url_filter.path_of(u)).alias("x")).collect()
    x = np.zeros((len(cells), url_filter.DIMENSIONS + 1))
    x[:, 0] = 1
    for k, r in enumerate(cells):
        x[k, [i + 1 for i in r.x]] = 1
    y, w = np.array([r.y for r in cells]), np.zeros(url_filter.DIMENSIONS + 1)
    for _ in range(url_filter.ROUNDS):
        e = 1 / (1 + np.exp(-x @ w)) - y
        w = w * (1 - url_filter.DECAY) - url_filter.RATE / len(y) * (x.T @ e)
    assert np.abs(w - weights).max() < 1e-9 and ((x @ w > 0) == (y == 1)).all()
    pages = spark.createDataFrame([(0, "http://casino-bonus.example/slots/free"), (1, "http://city-museum.example/en/history")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages).orderBy("page_id").collect()] == ["block", "allow"]


def test_line_dedup_of_odd_rows(spark):
    run = "one two three\nfour five six"
    df = spark.createDataFrame([(1, run), (1, run), (2, run), (None, run), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(df, 5).where("text is not null").collect())
    assert got == [(-1, run), (1, run), (1, run), (2, ""), (4, "")]


def test_line_dedup_of_a_common_run(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 5)
    rnd = random.Random(9)
    run = "a common line of words\nand another one of them"
    texts = [f"own {rnd.random()}\n{run}\nlast {rnd.random()}" for _ in range(20)] + ["x y z\nu v w\nr s t"] * 2
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs(spark, texts), 8).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 8)


def brute_languages(rows, least=0.5):
    """Language, probability and decision of (text, declared, host) rows that train their own model."""
    languages = sorted({d for _, d, _ in rows if d})
    tables = {k: np.zeros(langid.BUCKETS) for k in languages}
    for t, d in sorted({(t, d) for t, d, _ in rows if d and t is not None}):
        if len(t.encode()) > 2:
            tables[d] += np.bincount(langid.grams(np.frombuffer(t.encode(), np.uint8)), minlength=langid.BUCKETS)
    logs = np.array([np.log((tables[k] + langid.ALPHA) / (tables[k].sum() + langid.ALPHA * langid.BUCKETS)) for k in languages] + [np.full(langid.BUCKETS, -math.log(langid.BUCKETS))]).astype(np.float32)
    n, lls = [], []
    for t, _, _ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        g = langid.grams(raw) if len(raw) > 2 else np.zeros(0, int)
        n.append(len(g))
        lls.append(logs[:, g].astype(float).sum(1) * langid.GRAM_WEIGHT)
    votes = [(h or "", int(np.argmax(ll))) for (_, _, h), ll, k in zip(rows, lls, n) if k and np.argmax(ll) < len(languages)]
    hosts = {h or "" for _, _, h in rows}
    count = lambda keep: np.bincount([v for h, v in votes if keep(h)], minlength=len(languages)).astype(float)
    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1] if "." in h else ""
    smooth = lambda c, up: (c + langid.KAPPA * up) / (c.sum() + langid.KAPPA)
    whole = count(lambda h: True)
    top = (whole + 1) / (whole.sum() + len(languages))
    out = []
    for (t, d, h), ll, k in zip(rows, lls, n):
        h = h or ""
        prior = smooth(count(lambda x: x == h), smooth(count(lambda x: domain(x) == domain(h)), smooth(count(lambda x: suffix(x) == suffix(h)), top)))
        post = ll + np.log(np.append(prior * (1 - langid.UNKNOWN), langid.UNKNOWN))
        if d in languages:
            says = [math.log(langid.DECLARED) if x == d else math.log((1 - langid.DECLARED) / max(1, len(languages) - 1)) for x in languages]
            post = post + np.append(says, -math.log(len(languages)))
        best = int(np.argmax(post))
        p = 1 / np.exp(post - post[best]).sum()
        out.append(((languages + ["und"])[best], p, k > 0 and best < len(languages) and p >= least))
    assert hosts
    return out


def test_language_posteriors_are_those_of_brute_force(spark):
    rnd = random.Random(12)
    words = {"de": "der die und nicht mit auch werden", "en": "the of and that with from this", "fr": "le la les une est dans pour"}
    rows = []
    for i in range(60):
        k = sorted(words)[i % 3]
        rows.append((" ".join(rnd.choice(words[k].split()) for _ in range(rnd.choice([1, 2, 6, 30]))), rnd.choice([k, k, None, "en"]), rnd.choice([f"a.{k}.org", f"{k}.net", "plain", None])))
    rows += [("", "de", "x"), (None, None, None), ("~^~^" * 10, None, "plain"), ("ab", "fr", "plain")] + rows[:3]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, (language, p, kept) in enumerate(brute_languages(rows)):
        assert got[i].language == language and got[i].probability == pytest.approx(p, abs=1e-4) and got[i].is_kept == kept


def test_pages_language(spark, tmp_path):
    words = {"en": "the of and that with from this have which", "de": "der die und nicht mit auch werden schön"}
    rnd = random.Random(13)
    body = lambda k: " ".join(rnd.choice(words[k].split()) for _ in range(40))
    rows = [(i, f"http://h{i}.{k}/x", f"<html lang='{k}'><script>var die = 1</script><p>{body(k)}</p></html>") for i, k in enumerate(["en", "de"] * 15)]
    rows += [(100, "http://q.de/", f"<html><p>{body('de')}"), (101, None, None), (102, "http://q.de/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.pages_language_id(spark, f"file://{tmp_path}").collect()}
    assert all(got[i].language == ["en", "de"][i % 2] and got[i].is_kept and got[i].declared == ["en", "de"][i % 2] for i in range(30))
    assert got[100].language == "de" and got[100].declared is None and not got[101].is_kept and not got[102].is_kept


def poisson(doc, rate):
    import hashlib

    u = (int(hashlib.md5(f"{mixing.SEED}|{doc}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_pipeline_against_plain_versions(spark, tmp_path):
    rnd = random.Random(14)
    words = "the of and that with from this have which time people way day man thing woman life child world school state family student group country problem hand part place case".split()
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    boiler = line(30) + "\n" + line(30)
    texts = [line(rnd.choice([20, 60, 150])) + "\n" + line(20) for _ in range(30)]
    texts += [t.replace("time", "hour", 1) for t in texts[:6]] + texts[6:9] + [f"{line(40)}\n{boiler}\n{line(10)}" for _ in range(5)] + ["~^|" * 60, "", None, "   "]
    rows = [(i, t, rnd.choice(["en", "en", None]), "big" if i % 3 else "small", len(t or "")) for i, t in enumerate(texts)] + [(None, line(50), "en", None, 0)]
    spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", _seen int").write.parquet(f"file://{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs_ = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    take = lambda df: sorted([(-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect()])

    kept = stage["language_id"](spark, docs_, "").cache()
    judged = brute_languages([(t, d, s) for _, t, d, s, _ in rows])
    assert kept.columns == corpus_pipeline.COLUMNS
    assert take(kept) == sorted((-1 if i is None else i, t) for (i, t, *_), (_, _, ok) in zip(rows, judged) if ok)

    lines = stage["line_dedup"](spark, kept, "").cache()
    before = [x for x in take(kept) if x[0] >= 0]
    gone = brute_lines([t for _, t in before], 50)
    want = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g)) for (i, t), g in zip(before, gone)]
    assert sum(map(len, gone)) >= 8
    assert take(lines) == [x for x in take(kept) if x[0] < 0] + [(i, t) for (i, t), g in zip(want, gone) if not g or t.split()]

    unique = stage["ngram_jaccard_join"](spark, lines, "").cache()
    before = [x for x in take(lines) if x[0] >= 0]
    comps = brute_components([t for _, t in before], 5, 80, 100)[1]
    assert len(set(comps)) < len(before)
    assert take(unique) == [x for x in take(lines) if x[0] < 0] + [before[k] for k in sorted(set(comps))]

    mixed = stage["mixing"](spark, unique, "").cache()
    found = unique.collect()
    size = Counter()
    for r in found:
        size[r.source or ""] += len(r.text) + 1
    rate = {s: sum(size.values()) / len(size) / n for s, n in size.items()}
    want = Counter({r.doc_id: poisson("" if r.doc_id is None else r.doc_id, rate[r.source or ""]) for r in found})
    assert Counter(r.doc_id for r in mixed.collect()) == +want

    pieces = stage["packing"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == +want
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)

    whole = corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "start", "length", "ids_crc32", "doc_tokens").where("start = 0").collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in whole) == Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "the same words here " * 20, "en", "s", 5), (3, "the same words here " * 20, "en", "s", 5), (4, "x" * 200_000, "en", "s", 5)]
    df = clashing(spark.createDataFrame(rows, DOCS), corpus_pipeline.COLUMNS)
    out = stage(spark, df, "")
    assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    out.collect()
    assert stage(spark, df.limit(0), "").count() == 0
