"""The training-data operators against brute force, on edge cases and on the smallest tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, fingerprints, langid, line_dedup, mixing, ngram_join, packing, topk, url_filter, warc
from marlstone.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "   \n ", "one", "a b", "a b", "x" * 5000, "word " * 3000, "Ünï cödé 漢字 😀 text", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p q"]


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if a and den * a >= num * (len(sets[i]) + len(sets[j]) - a):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(spark, n, num):
    rnd = random.Random(n)
    texts = list(EDGES)
    for _ in range(6):
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 9)) for _ in range(rnd.choice([6, 12, 40, 150]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                copy[rnd.randrange(len(copy))] = "new" + str(rnd.randint(0, 99))
            texts.append(" ".join(copy))
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs(spark, texts), n, num, 100).collect()}
    sizes, comps = brute_components(texts, n, num, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == comps


def test_jaccard_copies_that_differ_from_their_source_alike(spark):
    """Copies that are not linked to their common source, of which some link to each other: pairs that only bitmaps and lists can tell."""
    rnd = random.Random(7)
    word = lambda: rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)] * 3
    for _ in range(30):
        copy = list(base)
        for _ in range(rnd.randint(3, 9)):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
        for _ in range(rnd.randint(0, 2)):
            again = list(copy)
            for _ in range(rnd.randint(1, 4)):
                again[rnd.randrange(len(again))] = word()
            texts.append(" ".join(again))
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs(spark, texts), 5, 80, 100).collect()}
    _, comps = brute_components(texts, 5, 80, 100)
    assert len(set(comps)) > 5
    assert [got[i].component_id for i in range(len(texts))] == comps


def test_parity_bitmaps_differ_at_most_as_sets_do(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(30)]
    rows = [(i, j, ngram_join.bitmap(a).tolist(), ngram_join.bitmap(b).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>").select("i", "j", ngram_join.flipped(F.col("a"), F.col("b")).alias("x"))
    for r in df.collect():
        apart = len(np.setxor1d(sets[r.i], sets[r.j]))
        assert r.x <= apart and (r.x - apart) % 2 == 0


def test_words_of_thue_morse_letters_differ(spark):
    """Powers of one base modulo 2^64 cancel in such words whatever the letters' codes are."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = ngram_join.jaccard_components(docs(spark, [word, other, word.upper()]), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.component_id, r.n_copies) for r in got) == [(0, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_jaccard_group_around_several_centers(spark):
    """Long near copies about the limit of likeness, in groups whose pivots tell little, with passages that all groups share."""
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 999))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(rnd.choice([200, 700]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(len(base) // 70):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy + passage))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs(spark, texts), 5, 80, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 5, 80, 100)[1]


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.jaccard_components(df, 3, 90, 100).collect())
    assert got == [(-1, -1), (1, 1), (1, 1)]
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_packing(spark):
    rnd = random.Random(1)
    texts = [*EDGES, *(" ".join(rnd.choice(["the", "of", "tion.", "a,\n"]) for _ in range(rnd.randint(0, 3000))) for _ in range(30))]
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs(spark, texts), 1024).collect()
    whole, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(whole.setdefault(r.doc_id, [])) and r.length == len(r.ids)
        import zlib

        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id] += r.ids
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        assert whole[i] == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and all(r.sequence_tokens == at for r in pieces)
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(map(len, whole.values()))
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_cuts_is_optimal():
    rnd = random.Random(2)
    for _ in range(30):
        p = [0]
        while len(p) < 40:
            p.append(p[-1] + rnd.randint(1, 6))
        pen = [0] + [rnd.randint(0, 4) for _ in p[1:]]
        _, total = packing.best_cuts(p, pen, 12)
        best = [0] + [None] * (len(p) - 1)
        for j in range(1, len(p)):
            best[j] = min(best[i] + 12 - (p[j] - p[i]) + pen[j] for i in range(j) if p[j] - p[i] <= 12)
        assert [t - x for t, x in zip(total, p)] == best


def test_warc_round_trip(spark):
    pages = [(1, "http://a.example/x?y#z", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "b://c", ""), (4, "http://d e\r\nf", None), (5, "x", "a\r\n\r\nWARC/1.1\r\n\r\nüñ"), (None, "http://n", "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-test"
    warc.write_archives(df, path)
    got = {r.page_id: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    top = {"<p>same</p>": 2, "": 4}
    for i, _, html in pages:
        body, r = (html or "").encode(), got[i]
        import base64

        assert r.payload_bytes == len(body) and bytes(r.payload or b"") == body
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = top.get(html or "", i) != i
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to_page_id == (top[html or ""] if revisit else None)
        assert r.request.id and r.metadata.id
    empty = f"{shared_dir(spark)}/warc-empty"
    warc.write_archives(df.limit(0), empty)


def test_warc_members():
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for raw in (record * 2, gzip.compress(record) * 2, gzip.compress(record * 2)):
        assert [b for _, b in warc.parse_archive(raw)] == [b"hi", b"hi"]


def test_fingerprints(spark):
    rnd = random.Random(4)
    long = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randint(0, 99)) for _ in range(300)) for _ in range(12)]
    texts = [*EDGES, *long, long[0]]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1 if i else n - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[4].fingerprint == got[5].fingerprint and got[n - 1].fingerprint == got[len(EDGES)].fingerprint
    own = [got[i] for i in range(len(EDGES) + 1, n - 1)]
    assert all(r.near_edited > r.near_next + 0.1 for r in own) and all(0 <= r.near_edited <= 1 for r in got.values())
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "x"), (7, "y")], "doc_id long, text string")
    assert fingerprints.fingerprints(odd).count() == 2


def test_fingerprints_of_a_text_and_a_longer_copy(spark):
    rnd = random.Random(5)
    short = ["".join(rnd.choice("abcdefghij   ") for _ in range(n)).strip() for n in (30, 60, 240, 250, 256) for _ in range(4)]
    rows = [(i, t, t + " and a few more chars") for i, t in enumerate(short)]
    df = fingerprints.with_anchors(fingerprints.with_anchors(spark.createDataFrame(rows, "i long, a string, b string"), "a", "x"), "b", "y")
    got = {r.i: r.v for r in fingerprints.with_likeness(df, "x", "y", "v").collect()}
    assert all(got[i] > (0.7 if len(t) > 200 else 0.1) for i, t in enumerate(short))


def test_fingerprints_keep_all_anchors_with_positions(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(400))
    long = [" ".join([*(word() for _ in range(1500)), passage, *(word() for _ in range(1500))]) for _ in range(2)]
    texts = [*EDGES, "y" * 13, "漢字" * 9, passage, *long]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        nxt = texts[i - 1] or ""
        edited = (t or "")[: len(t or "") - len(t or "") // 2] + nxt[: len(t or "") // 2]
        direct = fingerprints.with_anchors(spark.createDataFrame([(edited,)], "t string"), "t", "f").first().f
        assert rows[i].edited_fingerprint == direct
    a, b = (rows[len(texts) - k].fingerprint for k in (2, 1))
    spots = [{x.anchor: x["at"] for x in f} for f in (a, b)]
    shared = [x for x in spots[0] if x in spots[1]]
    inside = [x for x in shared if long[0][spots[0][x] : spots[0][x] + fingerprints.K] in passage]
    assert len(inside) > 300 and all(long[0][spots[0][x] : spots[0][x] + fingerprints.K] == long[1][spots[1][x] : spots[1][x] + fingerprints.K] for x in shared)
    union = len(set(spots[0]) | set(spots[1]))
    assert abs(rows[len(texts) - 1].near_next - len(shared) / union) < 0.01 and rows[len(texts) - 1].near_next > 0.03


def test_fingerprints_of_texts_without_spaces(spark):
    rnd = random.Random(7)
    rows = [(i, t, "x" + t) for i, t in enumerate(["".join(rnd.choice(a) for _ in range(5000)) for a in ("abcdefghijklmnop", "漢字仮名交文章検索語彙")])]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    df = fingerprints.with_likeness(fingerprints.with_anchors(fingerprints.with_anchors(df, "a", "x"), "b", "y"), "x", "y", "v")
    assert all(r.v > 0.99 for r in df.collect())


def test_url_parts(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://x.org", None, "no scheme", "http://", "s://h?p=/de/", "http://example.com/de/x", "http://notexample.com/de/", "http://a.net/q", "http://m.b.org/fr/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [(got[i].host, got[i].path) for i in range(6)] == [("a.example.net", "/en/x"), ("x.org", ""), ("", ""), ("", ""), ("", ""), ("h", "")]
    assert [got[i].rule for i in range(10)] == ["example.net/en/", None, None, None, None, None, "example.com/de/", None, "net/", "org/fr/"]
    assert [got[i].verdict for i in (0, 6, 8, 9)] == ["allow", "block", "block", "allow"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    rnd = random.Random(5)
    rows = [(f"http://{'casino' if b else 'garden'}{rnd.randint(0, 999)}.com/{rnd.randint(0, 99)}", b) for b in (0, 1) for _ in range(60)]
    model = spark.createDataFrame(rows[::2], "url string, blocked int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[1::2])], "page_id long, url string")
    weights = url_filter.train(model)
    u = F.col("url")
    scored = pages.select("page_id", url_filter.margin(url_filter.features(url_filter.host_of(u), url_filter.path_of(u)), weights).alias("m")).collect()
    hits = sum((r.m > 0) == bool(rows[1::2][r.page_id][1]) for r in scored)
    assert hits >= 0.95 * len(scored)


def brute_lines(texts, least):
    seen, out = set(), []
    for t in texts:
        lines = [(p, x) for p, x in enumerate((t or "").split("\n")) if x.split()]
        gone = set()
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b][1].split())
                if words >= least:
                    key = tuple(x for _, x in lines[a : b + 1])
                    if key in seen:
                        gone |= {p for p, _ in lines[a : b + 1]}
                    seen.add(key)
        out.append(sorted(gone))
    return out


def test_line_dedup(spark):
    rnd = random.Random(6)
    vocab = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.choice([1, 2, 5, 9]))) for _ in range(6)] + ["", "  "]
    texts = [*EDGES, *("\n".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 8, 25]))) for _ in range(40))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts), 12).collect()}
    for i, gone in enumerate(brute_lines(texts, 12)):
        assert got[i].removed_lines == gone
        if texts[i] is not None:
            assert got[i].text == "\n".join(x for p, x in enumerate(texts[i].split("\n")) if p not in gone)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_mixing(spark):
    texts = ["t" * 50] * 400
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 300, "big").otherwise("small"))
    got = mixing.mix(df, {"big": 1.0, "small": 3.0}).groupBy("source").agg(F.count("*").alias("n")).collect()
    n = {r.source: r.n for r in got}
    assert n["big"] == pytest.approx(100, rel=0.35) and n["small"] == pytest.approx(300, rel=0.25)
    one = [tuple(r) for r in mixing.mix(df, {"big": 1.0, "small": 3.0}).select("doc_id", "copy").collect()]
    assert len(set(one)) == len(one)
    odd = spark.createDataFrame([(None, None, None), (1, "", "x")], "doc_id long, text string, source string")
    mixing.mix(odd, total=900.0).count()
    assert mixing.mix(df.limit(0)).count() == 0
    big = mixing.replicate(df.limit(1), spark.createDataFrame([("big", 1000.0)], "source string, rate double")).count()
    assert 800 < big < 1200


def test_topk(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(150, None), (151, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (152, [float("nan")] * 6), (153, [1.0, 2.0]), (154, [1e12] * 6)]
    rows += [(200 + i, rows[50][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if e and None not in e and all(np.isfinite(e))}
    for q in (i for i in v if i % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q])))[:5]
        assert [got[q][k + 1] for k in range(len(want))] == [(c, -s) for s, c in want]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 1.0])] + [(1, [9.0 + i, 9.0]) for i in range(8)] + [(i, [float(i) / 4, 1.0]) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.search(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 256 * 256 * 25), *((i, 256 * 256 * (i + 4) // 4) for i in (8, 7, 6, 5))]


def test_language(spark):
    words = {"en": "the of and that with from this have which", "de": "der die und nicht mit auch werden über schön", "fr": "le la les une est dans pour éléphant avec"}
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(words[k].split()) for _ in range(40)), k, "h." + k) for i, k in enumerate(sorted(words) * 40)]
    rows += [(900, "", "en", "h.en"), (901, None, None, None), (902, "\x01\x02\x7f\x03~^" * 40, "en", "h.en"), (903, "der die und nicht mit auch " * 9, "en", "h.en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string")
    clean = df.where("doc_id < 900").select("text", F.col("declared").alias("label"))
    got = {r.doc_id: r for r in langid.identify(df, clean).collect()}
    assert sum(got[i].language == k and got[i].is_kept for i, _, k, _ in rows[:120]) == 120
    assert not got[900].is_kept and not got[901].is_kept and not got[902].is_kept and got[903].language == "de"
    assert langid.identify(df.limit(0)).count() == 0


def test_language_keeps_every_label(spark):
    rnd = random.Random(9)
    words = {f"l{k:02d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(40)}
    rows = [(100 * a + i, " ".join(rnd.choice(words[k]) for _ in range(30)), k, "h") for a, k in enumerate(sorted(words)) for i in range(5 if a < 36 else 3)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string")).collect()}
    assert all(got[i].language == k and got[i].is_kept for i, _, k, _ in rows)


def test_language_model_counts_a_text_once(spark):
    texts = [f"text number {i} of this label" for i in range(20)]
    models = [langid.fit(spark.createDataFrame([(t, "en") for t in rows], "text string, label string")) for rows in (texts, texts + texts[:1] * 300)]
    assert models[0][0] == models[1][0] == ["en", "und"]
    assert all((a == b).all() for a, b in zip(*(next(m.blocks()) for _, m in models)))


def test_chat(spark):
    turns = [(1, 0, "user", "hi & <|x|> [b]"), (1, 1, "assistant", "</s>[INST] ok"), (1, 2, "user", "&lt;"), (1, 3, "assistant", None), (2, 0, "user", "only"), (3, 0, None, None), (4, 0, "a|>b", "x\ny"), (4, 1, "assistant", "é😀")]
    rows = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).cache()
    got = {r.conv_id: r for r in chat.read_back(rows).collect()}
    for c in (1, 2, 3, 4):
        own = [(r or "", t or "") for i, _, r, t in turns if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert rows.where("conv_id = 1").count() == 2
    assert chat.read_back(chat.examples(rows.limit(0).selectExpr("conv_id", "cast(example as long) turn", "text role", "text"))).count() == 0
