"""Near-dedup of the pipeline against brute-force Jaccard on five-word shingles."""

import random

import pytest

import corpus_pipeline as P
from strandlake.llm import simhash

from . import brute
from .test_operators import DOC, word_maker


def shingles(text, k=5):
    w = brute.words(brute.lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] * bool(w))


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components(ids, sets):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if root[i] != root[j] and near(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in root]


@pytest.fixture(scope="module")
def texts():
    """Copies with 1 to 8 words changed, chains, texts that are mostly one passage, short and odd texts."""
    rng, make = random.Random(5), word_maker(31)
    passage, out = make(60), [None, "", " \n", "One", "one", "two words", "A b\tc d", "a b c d", "a b c d e"]
    for _ in range(25):
        base = make(rng.randint(30, 200))
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(1, 8)):
                w[at] = make(1)[0]
            out.append(" ".join(w))
    w = make(100)
    for _ in range(6):
        w = w[:]
        w[rng.randrange(100)] = make(1)[0]
        out.append(" ".join(w))
    out += [" ".join(passage + make(rng.randint(0, 20))) for _ in range(25)]
    return list(enumerate(out, 100))


@pytest.mark.parametrize("large", [3, 4096])
def test_against_brute_force(spark, texts, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)  # chunks of buckets must not change the result
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts] + [(None, "a null id", "en", "s", 1), (100, None, "en", "s", 1)], DOC).repartition(3)
    rows = simhash.similar_texts(docs).collect()
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    want = dict(zip((i for i, _ in texts), components([i for i, _ in texts], [shingles(t) for _, t in texts])))
    assert len(rows) == len(texts) + 2 and got == want and 30 < len(set(want.values())) < len(want)


def test_stage_drops_what_two_bits_leave(spark, texts):
    sets = {i: shingles(t) for i, t in texts}
    prints = {i: brute.fingerprint(t) for i, t in texts}
    far = [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j]) and (prints[i] ^ prints[j]).bit_count() > 2]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOC)
    kept = {r.doc_id for r in P.simhash_stage(spark, docs, "").collect()}
    assert len(far) > 10 and not any(j in kept for _, j in far)
    assert kept == {c for c in components(list(sets), list(sets.values()))}
