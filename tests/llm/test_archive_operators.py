"""WARC bundles, the divergence audit and the Merkle manifest against brute force, and their results for odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandlake.llm import divergence, merkle, queries, warc

PAGE = "page_id long, url string, html string"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# op11


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    long = ["é" + "".join(rng.choice("abcdef <>\r\n") for _ in range(1200)) for _ in range(4)]
    rows = [(i, f"http://h.example/{i}", rng.choice(long)) for i in range(60)]
    rows += [(100 + i, "http://h/s", "short body") for i in range(5)] + [(200, None, None), (201, "", ""), (202, "http://h/\r\nX: y z", "é" * 3_000_000)]
    rows += [(None, "n", long[0]), (None, "n", "y" * 1500), (None, "m", "y" * 1500), rows[3], rows[3], (300, "u", "z" * 1000), (301, "u", "z" * 1000), (302, "u", "z" * 999), (303, "u", "z" * 999), (304, "u", "w" * 1000), (304, "u", "w" * 1000)]
    return rows, spark.createDataFrame(rows, PAGE).repartition(4)


def archived(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            first[html] = max(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        body, top = (html or "").encode(), first.get(html) if html else None
        other = top if top is not None and top != i else None
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [warc.SMALL, 0])
def test_archives_round_trip(spark, pages, monkeypatch, tmp_path, small):
    monkeypatch.setattr(warc, "SMALL", small)
    rows, df = pages
    got = warc.round_trip(df, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == archived(rows)


def test_bundles_are_seekable(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 3000)
    monkeypatch.setattr(warc, "BUNDLE", 2000)
    rows, df = pages
    index = warc.write_bundles(df, f"file:{tmp_path}/new")
    places = index.collect()
    assert len(places) == len(rows) and len({p.bundle for p in places}) > 4 and len({(p.bundle, p.frame) for p in places}) > 12
    for p in places[:20]:
        raw = open(p.bundle.removeprefix("file:"), "rb").read()
        # a plain reader passes over the seek table
        assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")
        reader = warc.Reader(p.bundle)
        fields, payload, n = warc.parsed(reader.frame(p.frame)[p.at : p.at + p.size])
        assert fields["WARC-Record-ID"] == p.record and (fields["WARC-Type"] == "revisit" or len(payload) == n)
    wanted = index.filter(F.col("record").isin("<urn:x-record:202>", "<urn:x-record:100>"))
    got = {r.id: r for r in warc.read_records(wanted).collect()}
    assert got.keys() == {"100", "202"} and got["202"].payload.decode() == "é" * 3_000_000 and got["202"].target == "http://h/%0D%0AX:%20y%20z"
    assert got["100"].payload == b"short body" and got["100"].record_type == "response"


def test_damage_is_found(spark, tmp_path):
    index = warc.write_bundles(spark.createDataFrame([(1, "u", "body")], PAGE), str(tmp_path))
    with pytest.raises(Exception, match="not"):
        warc.read_records(index.withColumn("at", F.col("at") + 1)).collect()


# op12


def audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = term.findall((text or "").translate(lower))
        found[lang or ""].update(set(w))
        groups[lang or "", source or ""].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in found[lang].items() if n >= least]
        of = {g[1]: c for g, c in groups.items() if g[0] == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        for s in of:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in of if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if of[s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"SHARD": 3, "ROUND_BYTES": 200, "SLICE": 50, "HELD_TERMS": 5, "HELD_SLOTS": 8, "SOURCES": 2, "SLOTS": 4}, {"LEVELS": 1}, {"LEVELS": 0}])
def test_divergence_equals_brute_force(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(divergence, k, v)
    rng = random.Random(3)
    words = ["the", "The", "çe", "Éa", "e1f", "x_y", "o'n", "日本", "a b"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr"]), f"s{min(rng.randint(0, 5), rng.randint(0, 5))}") for _ in range(150)]
    rows += [("only here", "de", "x"), ("", "en", "empty"), (None, "en", None), (None, None, None), ("the " * 20_000, None, "long"), ("\x00the\x1fthe\x7f", "en", "s1"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumns({c: F.lit("x") for c in ("term", "slot", "n", "item")})
    got = divergence.divergence(docs, least_docs=5, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit(rows, 5, 7)


def test_perfect_hash():
    keys = [f"k{i}é".encode() for i in range(5000)]
    made = divergence.PerfectHash.build(keys[::-1], divergence.LEVELS)
    made = divergence.PerfectHash.unpacked(**made.packed())
    at = made.slots(keys, divergence.hashed(keys))
    assert sorted(at.tolist()) == list(range(5000)) and [made.keys[i].as_py() for i in at.tolist()] == keys
    others = [f"o{i}".encode() for i in range(5000)]
    assert (made.slots(others, divergence.hashed(others)) == -1).all()
    same = np.zeros(5000, np.uint64)  # hashes of keys that collide are told apart by the stored keys
    assert set(made.slots(others, same).tolist()) == {-1}


def test_shares_are_exact(spark):
    cases = [(5, 5), (5, 7), (10**13, 3 * 10**13 + 1), (8 * 10**15, 9 * 10**15), (1, 10**15)]
    got = spark.createDataFrame(cases, "n long, d long").select("n", "d", divergence.share(F.col("n"), F.col("d")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.n // r.d for r in got)


# op13


def proofs(rows):
    """By rows (doc_id, text, lang, source, n_chars): the contract, one node at a time."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: sha(part(r[0]) + part(r[3]) + part(r[2]) + part(r[4]) + part(text))
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(lower) if hit(r) and r[1] is not None else r[1]), r[0]))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))

    def grown(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def walk(tree, i, h):
        proof = ""
        for level in tree[:-1]:
            lo = i // 8 * 8
            run = level[lo : lo + 8]
            proof += "".join(x for k, x in enumerate(run) if lo + k != i)
            h = sha("".join(h if lo + k == i else x for k, x in enumerate(run)))
            i //= 8
        return proof, h

    trees = {g: grown([x[2] for x in sorted(leaves[g])]) for g in langs}
    top, out = grown([trees[g][-1][0] for g in langs]), []
    for k, g in enumerate(langs):
        for i, x in enumerate(sorted(leaves[g])):
            inner, h = walk(trees[g], i, x[3])
            outer, h = walk(top, k, h)
            out.append((x[4], x[2], trees[g][-1][0], top[-1][0], sha(inner + outer), h, h == top[-1][0]))
    return sorted(out, key=repr)


def merkle_rows(n_langs=11):
    rng = random.Random(4)
    rows = [(i * 7 % 1303, rng.choice(["Mixed Case", "lower", "É", ""]) + str(i % 5), "en", "s", i) for i in range(1303)]
    rows += [(5000 + i, "T", f"l{i}", None, None) for i in range(n_langs)] + [(6000 + i, "Ab", "de", "s", 2) for i in range(9)] + [(7000 + i, "Ab", "fr", "s", 2) for i in range(8)]
    return rows + [(None, "Null Id", "en", "s", 1), (None, "Other", "en", "s", 1), (8000, None, None, None, None), (8001, "", "", "", 0), (8002, "Z" * 1_000_000, "es", "s", 3), rows[5], rows[5]]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_brute_force(spark, monkeypatch, tmp_path, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows = merkle_rows()
    docs = spark.createDataFrame(rows, DOC).repartition(5).withColumns({c: F.lit("x") for c in ("g", "i", "n", "h", "b", "leaf", "claimed", "id", "_group", "_part")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == proofs(rows)


@pytest.mark.parametrize("rows", [[(1, "One", "en", "s", 3)], [(3, "One", "en", "s", 3), (4, "Two", "fr", "s", 3)], [(i, "Aa", "en", "s", 2) for i in range(513)]])
def test_small_manifests(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == proofs(rows)
