"""Operators on Spark against brute force and SQL, and their defined results for odd input."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, decontaminate, fmindex, language, lines, lm, quality, queries, simhash, suffixarray, urls

from .. import oracle
from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def word_maker(seed):
    rng = random.Random(seed)
    return lambda n: [rng.choice("aeiou") + "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Exact and near copies, shared passages, repeated lines, odd texts, a repeated row, a null id."""
    make = word_maker(11)
    passage, near = " ".join(make(60)), make(120)
    rows = [(i, " ".join(make(20 + 7 * i)), "en", "s0", 1) for i in range(12)]
    rows += [(20 + i, " ".join(make(15)) + "\n" + passage + "\t" + " ".join(make(9)), "en", "s1", 1) for i in range(5)]
    rows += [(30 + i, " ".join(near[:60] + make(i) + near[60:]), "fr", "s1", 1) for i in range(3)]
    block = "\n".join(" ".join(make(4)) for _ in range(5))
    rows += [(40 + i, f"{' '.join(make(6))}\n\n{block}\n{' '.join(make(5))}", "en", "s2", 1) for i in range(3)]
    rows += [(50, None, "en", None, None), (51, "", None, "s0", 0), (52, " \n\t ", "en", "s0", 4), (53, "é" * 250 + " " + "é" * 250, "fr", "s0", 501), (54, "ha " * 400, "en", "s0", 1200), (55, "One", "en", "s0", 3)]
    rows += [(None, "null id here with some words in it", "en", "s0", 1), rows[3], rows[20]]
    return rows, spark.createDataFrame(rows, DOC).repartition(3)


def test_bpe(corpus):
    import base64

    import public_tokenizers
    import tiktoken

    rows, docs = corpus
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = e.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(r[1] or "")))
    got = [tuple(r) for r in bpe.digests(docs, queries.VOCABULARY).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    lists = {r.doc_id: r.ids for r in bpe.encode(docs, queries.VOCABULARY).collect()}
    assert lists[55] == e.encode_ordinary("One") and lists[50] == []


def test_simhash(corpus):
    rows, docs = corpus
    rows = [r for r in rows if r[0] is not None]
    prints = [brute.fingerprint(r[1]) for r in rows]
    want = sorted((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute.components([r[0] for r in rows], prints)))
    got = simhash.near_duplicates(docs.filter("doc_id is not null")).select("doc_id", simhash.hexed(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicates(docs).count() == len(rows) + 1


def test_simhash_chains_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 3)
    rng = random.Random(12)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:
        g = f
        for _ in range(6):
            g ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(g)
    low = rng.getrandbits(32) << 32
    fps |= {low | rng.getrandbits(6) for _ in range(20)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    from strandlake.operators.graph import component_roots

    found = component_roots(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    want = brute.components(fps, [f & (1 << 64) - 1 for f in fps])
    assert [root.get(f, f) for f in fps] == want


def test_word_windows(corpus):
    rows, docs = corpus
    w = [brute.words(r[1]) for r in rows]
    want = [(r[0], len(x), sum(m), brute.sha(" ".join(a for a, b in zip(x, m) if not b))) for r, x, m in zip(rows, w, brute.repeated(w, 35))]
    got = fmindex.dedup_substrings(docs).select("doc_id", "size", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_byte_windows(corpus):
    rows, docs = corpus
    b = [(r[1] or "").encode() for r in rows]
    want = [(r[0], len(x), sum(m), brute.runs(m), brute.sha(bytes(a for a, y in zip(x, m) if not y))) for r, x, m in zip(rows, b, brute.repeated(b, 200))]
    got = suffixarray.dedup_bytes(docs).select("doc_id", "size", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_are_cut_up(corpus, monkeypatch, hot):
    from strandlake.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    test_word_windows(corpus)
    test_byte_windows(corpus)


def test_line_dedup(corpus):
    rows, docs = corpus
    rows = sorted((r for r in rows[:-2] if r[0] is not None), key=lambda r: r[0])
    want = dict(zip((r[0] for r in rows), brute.dedup_lines([r[:2] for r in rows])))
    got = {r.doc_id: r for r in lines.dedup_lines(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert got[41].n_removed >= 5 and got[40].n_removed == 0 and got[50].n_lines == 0 and got[51].n_lines == 1


def test_quality_counts_and_fences(spark, corpus):
    rows, docs = corpus
    got = {(r.doc_id): r for r in quality.judge(docs).collect()}
    for r in rows:
        w, g = brute.words(r[1]), got[r[0]]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        marks = {j for i, x in enumerate(grams) if grams.count(x) > 1 for j in range(i, i + 5)}
        full = [x for x in (r[1] or "").split("\n") if brute.words(x)]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(w), sum(map(len, w)), len(marks), len(full) - len(set(full)))
        assert g.base_failed == (len(w) < 10 or 100 * len(marks) > 20 * len(w)) and not (g.base_failed and g.kept)
    make = word_maker(13)
    more = [(i, " ".join(make(50)), "en", "s0", 1) for i in range(60)] + [(99, " ".join(x + "#%" for x in make(50)), "en", "s0", 1)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(more, DOC)).collect()}
    assert not kept.pop(99) and all(kept.values())


def edited(rng, make, words, n, evenly=False):
    """words after n edits of one word each."""
    words = list(words)
    places = [k * len(words) // n for k in range(n)][::-1] if evenly else sorted(rng.sample(range(len(words)), n), reverse=True)
    for k in places:
        what = rng.randrange(3)
        words[k : k + (what != 0)] = make(1) if what < 2 else []
    return words


def test_leaks(spark):
    make = word_maker(14)
    rng = random.Random(15)
    items = [(i, " ".join(make(rng.randint(14, 60)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "Alpha"), (93, "beta, gamma delta"), (94, "e f g h")]
    docs = []
    for i in range(120):
        body = make(rng.randint(30, 200))
        if i % 2:
            words = items[rng.randrange(25)][1].split()
            words = edited(rng, make, words, rng.randint(0, int(0.2 * len(words))))
            at = rng.randrange(len(body))
            body[at:at] = [words[0].upper() + ",", *words[1:]]
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "  "), (503, items[0][1]), (503, items[0][1]), (504, "so alpha"), (505, "beta gamma\nDELTA! beta gamma delta alpha"), (506, "alpha"), (507, "beta gamma"), (508, "e f g"), (509, "h e f g h"), (None, "alpha")]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, short = {}, {}
    for d, text in docs:
        w = brute.plain_words(text)
        for i, item in items:
            x = brute.plain_words(item)
            if x and w and (len(x) < 5 or set(zip(x, x[1:])) & set(zip(w, w[1:]))) and (e := brute.edit_in(x, w)) <= decontaminate.edits(len(x)):
                (short if len(x) < 5 else want)[d, i] = e
    assert {k: v for k, v in got.items() if k[1] >= 90} == short and len(short) == 6
    got = {k: v for k, v in got.items() if k[1] < 90}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) > 50  # the target recall is 0.99
    assert all(got[k] == want[k] for k in got)
    none = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


def test_leaks_of_long_items_at_the_radius(spark):
    make, rng = word_maker(21), random.Random(22)
    items = [(m * 100 + i, make(m)) for m in (10, 50, 100, 200, 400) for i in range(20)]
    docs = [(i, " ".join(make(40) + edited(rng, make, words, len(words) // 5, i % 2 == 1) + make(40))) for i, words in items]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    found = {r.doc_id for r in got.collect() if r.doc_id == r.item_id}
    assert len(found) >= 0.97 * len(items)


def test_url_rules_and_mined_ones(spark):
    rows = [(1, "http://Shop.Example.com/en/x?q=1"), (2, "https://www.example.com/en/"), (3, "http://a.net/es/b"), (4, "http://net/fr/"), (5, "http://example.com/de/"), (6, None), (7, "no scheme"), (8, "http://example.org#f"), (9, "http://badexample.com/en/"), (10, "http://x.com")]
    rows += [(100 + i, f"http://h{i % 7}.good.org/{i}/page") for i in range(60)] + [(200 + i, f"http://w{i}.spam.org/{i}?buy=now") for i in range(40)]
    labels = [(100 + i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(30)] + [(None, 0, 1)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[1] == ("shop.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == ("net/fr/", "block") and got[5][2:] == ("com/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("example.org", "", None, "allow")
    assert got[9] == ("badexample.com", "/en/", "com/", "allow") and got[10][2:] == (None, "allow")
    assert all(got[200 + i][3] == "block" for i in range(40)) and all(got[100 + i][3] == "allow" for i in range(60))
    none = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.filter("verdict = 'block'").count() == 3


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(16)
    base = [sorted({rng.choice("abcdef") for _ in range(4)}) for _ in range(200)]
    base = [([*t, "z"] if "a" in t else t, ("a" in t and "b" in t and rng.random() < 0.9) or rng.random() < 0.1) for t in base]
    rows = [(i, t, bad) for i, (t, bad) in enumerate(base)] + [(900, ["a", "b"], None)]
    got = {tuple(r.antecedent): (r.n_bad, r.n, r.confidence) for r in urls.mine(spark.createDataFrame(rows, "id long, tokens array<string>, bad boolean"), 4, 0.6).collect()}
    want = brute.url_rules(base, 4, 0.6)
    assert ("a", "b") in got and got.keys() == want.keys() and all(got[c][:2] == want[c] for c in got)


@pytest.mark.parametrize("data", [oracle.DATA, "/root/testdata/sf0.01"])
def test_urls_equal_brute_force(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = sorted(map(tuple, queries.op2_url_filters(spark, data).collect()))
    want, mined = brute.filter_urls(pages, labels, urls.LISTED)
    assert got == sorted(want)
    unlisted = [x for x in got if x[3] is None]
    if data.endswith("0.01"):
        assert mined and any(x[4] == "block" for x in unlisted) and any(x[4] == "allow" for x in unlisted)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    hidden = docs.withColumn("shown", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    got = language.identify(hidden, declared_col="shown").filter("shown is null and n_chars > 40").select("lang", "language", "kept").collect()
    assert sum(r.lang == r.language and r.kept for r in got) / len(got) > 0.97


def test_language_evidence(spark):
    make = word_maker(17)
    en = [(i, " ".join(make(30)), "en", "h1", "com") for i in range(50)]
    xx = [(100 + i, " ".join("zyx" + w for w in make(30)), "xx", "h2", "net") for i in range(50)]
    odd = [(200, None, "en", "h1", "com"), (201, "", None, None, None), (202, "12 34 !!", "en", "h1", "com"), (203, " ".join(make(30)), None, None, None), (204, " ".join("zyx" + w for w in make(40)), "en", "h1", "com")]
    d = spark.createDataFrame(en + xx + odd, "doc_id long, text string, lang string, source string, tld string").withColumn("kept", F.lit("mine"))
    got = {r.doc_id: r for r in language.identify(d, suffix_col="tld").collect()}
    assert all(got[i].language == "en" and got[i].kept for i in range(50)) and all(got[100 + i].language == "xx" for i in range(50))
    assert not got[200].kept and not got[201].kept and not got[202].kept
    assert got[203].language == "en" and got[204].language == "xx"
    nothing = language.identify(d.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.filter("kept").count() == 0


@pytest.mark.parametrize("at_once", [1, 2, 3, 200])
def test_language_equals_brute_force(spark, at_once):
    rng, make = random.Random(19), word_maker(19)
    style = {"en": "", "xx": "zyx", "yy": "qu", "zz": "jö", None: ""}
    rows = []
    for i in range(150):
        true = rng.choice(["en"] * 6 + ["xx"] * 3 + ["yy", "zz", None])
        text = " ".join(style[true] + w for w in make(rng.randint(1, 12)))
        rows.append((i, text, true if rng.random() < 0.9 else "en", rng.choice(["h1", "h2", None]), rng.choice(["com", "net", None])))
    rows += [(200, None, "en", "h1", "com"), (201, "", None, None, None), (202, "12 !", "xx", "h9", "org"), (203, "é", "qq", None, "net"), (204, "Éa" * 50_000, "yy", "h1", "com"), rows[3], rows[3], (None, "null id", "en", "h1", "com")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tld string").repartition(3)
    got = sorted(((r.doc_id, r.language, r.kept, r.confidence) for r in language.identify(d, suffix_col="tld", at_once=at_once).collect()), key=repr)
    want = sorted(((r[0], a, k, c) for r, (a, c, k) in zip(rows, brute.languages([r[1:] for r in rows]))), key=repr)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want))


def test_rare_languages_stay(spark):
    make = word_maker(20)
    rows = [(i, " ".join(make(40)), "en", "s") for i in range(995)] + [(2000 + i, " ".join("zyx" + w for w in make(40)), "xx", "s") for i in range(4)] + [(3000, " ".join("jöw" + w for w in make(40)), "yy", "s")]
    got = {r.doc_id: (r.language, r.kept) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[2000 + i] == ("xx", True) for i in range(4)) and got[3000][1]  # one row alone teaches no model


def test_each_of_many_languages_is_found_undeclared(spark):
    rng, signs = random.Random(23), [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouyäöüé"]
    words = {f"l{k:03}": ["".join(rng.sample(signs, 3)) for _ in range(12)] for k in range(250)}
    make = lambda l: " ".join(rng.choice(words[l]) for _ in range(60))
    rows = [(k, make(l), l, None) for k, l in enumerate(sorted(words) * 3)] + [(10_000 + k, make(l), None, None) for k, l in enumerate(sorted(words))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for at_once in (language.AT_ONCE, 70):
        got = {r.doc_id: (r.language, r.kept) for r in language.identify(d, at_once=at_once).filter("doc_id >= 10000").collect()}
        assert got == {10_000 + k: (l, True) for k, l in enumerate(sorted(words))}


def test_equal_languages_go_by_name(spark):
    rows = [(i, "same words here", "ab"[i % 2] * 2, "h") for i in range(8)] + [(9, "same words here", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {language.identify(d, at_once=n).filter("doc_id = 9").first().language for n in (1, 2)} == {"aa"}


def test_language_of_pages(spark):
    pages = language.of_pages(spark.createDataFrame([(1, "http://A.b.Org/x", "<!DOCTYPE html><HTML class='k' lang='de-AT'><script>var <b></script><p>Wort</p>"), (2, None, None), (3, "x", "<p>no tag")], "page_id long, url string, html string"))
    got = [(r.page_id, r.text.split(), r.lang, r.host, r.suffix) for r in pages.orderBy("page_id").collect()]
    assert got == [(1, ["Wort"], "de", "a.b.org", "org"), (2, [], None, None, None), (3, ["no", "tag"], None, None, None)]
    data = oracle.DATA
    truth = spark.read.parquet(f"{data}/pages.parquet").select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("l"))
    found = queries.language_of_pages(spark, data).join(truth, "page_id")
    assert found.filter("language = l and kept").count() >= 0.98 * truth.count()


@pytest.fixture(scope="module")
def scored(spark):
    make = word_maker(18)
    sentence = make(12)
    rows = [(i, " ".join(sentence * 20)) for i in range(20)] + [(50 + i, " ".join(make(60 + i))) for i in range(30)] + [(90, None), (91, ""), (92, "one"), (93, "é" * 3000)]
    twice = " ".join(make(70))
    rows += [(200, twice), (201, twice)] + [(300, "same row"), (300, "same row"), (None, "no id here")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("leaf", [4, 0.002, 0.00001])
def test_scores_equal_brute_force(scored, monkeypatch, leaf):
    import math
    from collections import Counter

    import numpy as np

    monkeypatch.setattr(lm, "BLOCK", 700)
    monkeypatch.setattr(lm, "HELD", 400)
    monkeypatch.setattr(lm, "LEAF", leaf)  # fewer words of a leaf need more digits, as a larger vocabulary does
    rows, docs = scored
    counts = lm.word_counts(docs.repartition(3))
    m, leaves = lm.fit(docs.repartition(3), "doc_id", "text", counts)
    of = lambda w: lm.parsed(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
    corpus = Counter(w for _, t in rows for w in brute.words(t))
    assert len(corpus) > 1000 and m.depth == {4: 1, 0.002: 4, 0.00001: 6}[leaf]
    hashed = {w: (int(of(w)[0].view(np.int64)[0]), int(of(w)[1][0])) for w in corpus}
    assert {(r.word, r.ending): r.n for r in counts.collect()} == {hashed[w]: n for w, n in corpus.items()}
    top = sorted(corpus, key=lambda w: (-corpus[w], hashed[w][0]))[:lm.FREQUENT]
    assert m.frequent == [hashed[w][0] for w in top]
    place = {w: k for k, w in enumerate(sorted(top, key=lambda w: hashed[w][0] % (1 << 64)))}
    digits = {w: [hashed[w][0] >> 4 * k & 15 for k in range(m.depth)] for w in corpus}
    path = {w: (hashed[w][1], *digits[w]) for w in corpus if w not in place}
    tokens, types = Counter(), Counter()
    for w, way in path.items():
        for k in range(len(way) + 1):
            tokens[way[:k]] += corpus[w]
        types[way] += 1
    assert {r.word: r.whole for r in leaves.collect()} == {hashed[w][0]: tokens[way] + types[way] for w, way in path.items()}
    tables, b1, wg, bg, w2, b2, weights, bias = lm.Net(m.weights, m.depth, m.priors).parts
    share = lambda logits, k: logits[k] - np.log(np.exp(logits).sum())
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in lm.score(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        w, total = brute.words(t), 0.0
        own = Counter(w)
        classes = [place.get(x, lm.FREQUENT + hashed[x][1]) for x in w]
        for k, x in enumerate(w):
            around = [classes[k + o] if 0 <= k + o < len(w) else lm.CLASSES for o in (-2, -1, 1, 2)]
            hidden = np.tanh(sum(tables[a][c] for a, c in enumerate(around)) + b1)
            g = classes[k] // 16
            total += share(hidden @ wg + bg, g) + share((hidden @ w2 + b2)[16 * g : 16 * g + 16], classes[k] % 16)
            if x not in place:
                for d, digit in enumerate(digits[x]):
                    prior = [math.log(tokens[path[x][: d + 1] + (y,)] + 1) if d < 3 else 0.0 for y in range(16)]
                    total += share(hidden @ weights[d] + bias[d] + prior, digit)
                rest = tokens[path[x]] - sum(n for y, n in own.items() if y not in place and path[y] == path[x])
                seen = corpus[x] - own[x]
                total += (math.log(seen) if seen else -len(x.encode()) * math.log(32)) - math.log(rest + types[path[x]])
        want.append((i, len(w), total))
    want.sort(key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-3 * max(1, abs(b[2])) for a, b in zip(got, want))


def test_the_tree_grows_and_shares_add_up():
    import numpy as np

    assert [lm.depth_for(n) for n in (0, 100, 2000, 40_000, 450_000, 10**9)] == [1, 1, 1, 3, 3, 6]
    rng = np.random.default_rng(1)
    for depth in (1, 3, 4):
        cells = rng.integers(0, 5, lm.ENDINGS << (4 * min(depth, 3))).astype(float)
        net = lm.Net(lm.Net.fresh(depth) + rng.normal(0, 0.3, lm.Net.size(depth)), depth, lm.priors_of(cells, depth))
        around = np.repeat(rng.integers(0, lm.CLASSES, (1, 4)), lm.FREQUENT + lm.ENDINGS * 16, 0)
        target = np.concatenate([np.arange(lm.FREQUENT), lm.FREQUENT + np.repeat(np.arange(lm.ENDINGS), 16)])
        one = np.concatenate([np.zeros(lm.FREQUENT, int), np.tile(np.arange(16), lm.ENDINGS)])
        short = lm.Net(net.flat(), depth, net.priors)
        short.depth = 1  # class and first digit
        assert np.exp(short.log_probs(around, target, one)).sum() == pytest.approx(1, abs=1e-4)


def test_a_shuffled_document_scores_lower(spark):
    rng = random.Random(24)
    make = word_maker(24)
    # every noun has verbs and objects of its own, which are rare words below the same few endings
    nouns = [(n, make(3), make(3)) for n in make(60)]
    sentence = lambda: (lambda n: f"the {n[0]} will {rng.choice(n[1])} a {rng.choice(n[2])} .")(rng.choice(nouns))
    texts = [" ".join(sentence() for _ in range(12)) for _ in range(600)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:60]]
    d = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(shuffled)], "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in lm.score(d).collect()}
    assert sum(got[i] > got[1000 + i] for i in range(60)) >= 58


def test_scores_follow_the_corpus(scored):
    rows, docs = scored
    one, two = ({(r.doc_id, r.n_tokens, r.log_prob, r.mean_log_prob) for r in lm.score(docs.repartition(n)).collect()} for n in (2, 16))
    assert one == two  # the same for any partitioning
    mean = {r[0]: r[3] for r in one}
    assert len(mean) == 58 and mean[0] > max(mean[50 + i] for i in range(30)) and mean[90] is None and mean[91] is None
    assert min(mean[i] for i in (200, 201)) > max(mean[50 + i] for i in range(30))  # occurs twice


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    oracle.same(spark, queries.queries()[name], queries.oracle_sql()[name], oracle.database())


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{oracle.DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for q in queries.queries().values():
        assert q(spark, str(tmp_path)).count() == 0


def test_odd_columns_do_not_clash(spark, corpus):
    _, docs = corpus
    names = ["ids", "fp", "kept", "language", "n_lines", "n_removed", "_key", "_lines", "_words", "n_words", "anchor", "key", "lo", "size", "_text", "confidence", "_host", "word", "item", "words"]
    wide = docs.withColumns({c: F.lit("x") for c in names})
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    made = [bpe.digests(wide, queries.VOCABULARY), simhash.near_duplicates(wide), fmindex.dedup_substrings(wide), suffixarray.dedup_bytes(wide), lines.dedup_lines(wide), quality.judge(wide), language.identify(wide), lm.score(wide)]
    n = docs.count()
    assert [d.count() for d in made] == [n] * len(made)
    assert decontaminate.decontaminate(wide, items).count() == n
