"""The numpy parts, without Spark, against brute force on random input."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import decontaminate, fmindex, lm, simhash, suffixarray
from strandlake.llm import textkernel as tk
from strandlake.llm.bpe import Codec

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_tokens_equal_the_library(text):
    c, e = test_tokens_equal_the_library.pair
    ids = encoded(c, [text])[0]
    assert ids == e.encode_ordinary(text)
    assert c.decode(np.array(ids, np.int32))[0].tobytes() == text.encode()


def encoded(codec, texts):
    out = []
    for i, j, ids, bounds in codec.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


@pytest.fixture(autouse=True)
def _pair(codec, reference):
    test_tokens_equal_the_library.pair = (codec, reference)


def test_tokens_of_long_runs(codec, reference):
    for text in ("a" * 5000, "ab" * 3000, "the" * 2000, "é" * 500, " " * 3000, "<|endoftext|>", "ababaabab" * 200):
        assert encoded(codec, [text]) == [reference.encode_ordinary(text)]


def test_tokens_of_many_texts(codec, reference):
    rng = random.Random(20)
    parts = ["'s", "'re", "'r", "''ll", " 'd", "'", "it's", "It'S", " ", "  ", "\n", "\t ", "\u00a0", "12", "\u00b2", "\u0660", "a", "Zz", "ñandú", "\u0301", "中文", "\U0001f600", "_", "!?", "\u2028", "the", "tion", "ablewh"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    assert encoded(codec, texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_memo_generations(codec, reference, monkeypatch):
    from strandlake.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "SLICE", 60)
    monkeypatch.setattr(bpe, "FEW", 0)
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choice("abehinorst") for _ in range(rng.randint(1, 14))) for _ in range(8)) for _ in range(200)]
    assert encoded(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", "a", "  a b ", "A b\nc", "x", "y  ", "  z", " ", "a b c d", "é ü\t\tß\x0b\x0cq ", "\n\n", "A a a a a"]
    texts += ["".join(rng.choice("aB \n\té") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = simhash.text_fingerprints(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [brute.fingerprint(t) for t in texts]


def test_majority_of_many():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 254, 255, 256, 0, 511, 2000])
    h = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    got, at = simhash.majority(h, counts), 0
    for k, n in enumerate(counts):
        part = [int(x) for x in h[at : at + n]]
        at += n
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n)


def test_bit_planes_count_right():
    rng = np.random.default_rng(3)
    for radius in (0, 1, 2, 3, 5):
        diff = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in range(300)], np.uint64)
        got = simhash.within_planes(simhash.planes_of(diff), radius)
        bits = np.unpackbits(got.view(np.uint8), bitorder="little")[:300].astype(bool)
        assert (bits == (np.bitwise_count(diff) <= radius)).all()


def test_forest_spans_all_links():
    rng = np.random.default_rng(4)
    f = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f[:200] ^ np.uint64(5), f[:100] ^ np.uint64(1 << 40), f[:50] ^ np.uint64(7)]))
    a, b = simhash.forest(np.zeros(len(f), np.int64), f)
    place = {int(x): i for i, x in enumerate(f)}
    label = list(range(len(f)))
    for x, y in sorted(zip(a, b), key=lambda e: place[int(e[0])]):
        label[place[int(x)]] = label[place[int(y)]]
    assert label == brute.components(list(range(len(f))), [int(x) for x in f])


def test_fm_index_flags():
    rng = random.Random(5)
    for _ in range(200):
        length = rng.randint(2, 6)
        segs = [[rng.choice("a b c d e".split()) for _ in range(length + rng.randint(0, 8))] for _ in range(rng.randint(1, 12))]
        n = np.array([len(s) - length + 1 for s in segs])
        codes = {w: i + 1 for i, w in enumerate("abcde")}
        symbols = np.array([c for s in segs for c in [*(codes[w] for w in s), 0]])
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in segs])[:-1]])
        got = fmindex.repeated_windows(fmindex.FMIndex(symbols, 6, 64), symbols, starts, n, length)
        seen = [tuple(s[i : i + length]) for s in segs for i in range(len(s) - length + 1)]
        assert list(got) == [seen.count(x) > 1 for x in seen]


def test_prefix_free_parse_orders_windows(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        length = rng.randint(12, 40)
        monkeypatch.setattr(suffixarray, "WINDOW_BYTES", length)
        base = bytes(rng.choice(b"ab") for _ in range(60))
        segs = []
        for _ in range(rng.randint(1, 10)):
            s = bytes(rng.choice(b"abc") for _ in range(length + rng.randint(0, 30)))
            if rng.random() < 0.6:
                i = rng.randint(0, 20)
                s = s[: rng.randint(0, 10)] + base[i : i + rng.randint(length, 45)] + s[: rng.randint(0, 9)]
            segs += [s] if len(s) >= length else []
        if segs:
            seen = [s[i : i + length] for s in segs for i in range(len(s) - length + 1)]
            got = suffixarray.search(pa.array(segs, pa.binary()), np.array([len(s) - length + 1 for s in segs]), np.ones(len(segs), int))
            assert list(got) == [seen.count(x) > 1 for x in seen]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(7)
    core = rng.integers(1, 1 << 60, 80, dtype=np.uint64)
    for pre, post in ((0, 0), (5, 9), (33, 2)):
        doc = np.concatenate([rng.integers(1, 1 << 60, pre, dtype=np.uint64), core, rng.integers(1, 1 << 60, post, dtype=np.uint64)])
        found = tk.anchored(doc, np.array([0, len(doc)]), 35, 8)
        assert found["n"].sum() == len(doc) - 34
        one = {int(lo) + i - pre: int(a) for lo, n, a in zip(found["lo"], found["n"], found["anchor"]) for i in range(n)}
        inner = {k: v for k, v in one.items() if 0 <= k <= 80 - 35}
        if pre == 0 and post == 0:
            want = inner
        assert inner == want


def test_periodic_text_has_consistent_anchors():
    found = tk.anchored(np.full(500, 7, np.uint64), np.array([0, 500]), 35, 8)
    assert found["n"].sum() == 466 and len(set(found["anchor"].tolist())) == 1


def test_edit_distance_in_text():
    rng = random.Random(8)
    for _ in range(1500):
        item = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
        assert decontaminate.within(item, text, len(item))[0] == brute.edit_in(item, text)


def net_case(seed, n, depth=2):
    rng = np.random.default_rng(seed)
    classes = np.tile(rng.integers(0, lm.CLASSES, n), 40 if n == 40 else 1).astype(np.int32)
    low = np.tile(rng.integers(0, 1 << 4 * depth, n), 40 if n == 40 else 1)
    priors = lm.priors_of(rng.integers(0, 6, lm.ENDINGS << 4 * depth).astype(float), depth)
    return classes, low, priors, lm.Net.fresh(depth) + rng.normal(0, 0.05, lm.Net.size(depth))


def test_network_learns_its_gradient(monkeypatch):
    """Loss falls, and the analytic step agrees with finite differences for weights of every kind."""
    classes, low, priors, flat = net_case(9, 40)
    around = lm.contexts(classes, np.array([0, len(classes)]))
    net = lm.Net(flat, 2, priors)
    before = net.log_probs(around, classes, low).mean()
    squares = [np.full_like(p, 1e-4) for p in net.parts]
    for _ in range(40):
        net.train(around, classes, low, squares)
    assert net.log_probs(around, classes, low).mean() > before + 1
    monkeypatch.setattr(lm, "BATCH", len(classes))
    probe = lm.Net(flat, 2, priors)
    zero, start = [np.zeros_like(p) for p in probe.parts], 0
    probe.train(around, classes, low, zero)
    for part in zero:
        at, eps = int(part.argmax()), 1e-2
        loss = lambda d, i=start + at: -lm.Net(flat + d * (np.arange(len(flat)) == i), 2, priors).log_probs(around, classes, low).mean()
        slope = (loss(eps) - loss(-eps)) / (2 * eps)
        assert part.ravel()[at] > 0 and abs(np.sqrt(part.ravel()[at]) - abs(slope)) < 2e-3 * max(1, abs(slope))
        start += part.size


@pytest.mark.parametrize("safe", [True, False])
def test_training_equals_plain_loops(monkeypatch, safe):
    """One Adagrad step a batch, gradients added up word by word."""
    monkeypatch.setattr(lm.Net, "bounded", lambda self: safe)
    classes, low, priors, flat = net_case(10, 50)
    around = lm.contexts(classes, np.array([0, 30, 50]))
    net, plain = lm.Net(flat, 2, priors), [p.astype(float) for p in lm.Net(flat, 2, priors).parts]
    squares, sums = [np.full_like(p, 1e-4) for p in net.parts], [np.full_like(p, 1e-4) for p in plain]

    def off(logits, chosen):
        x = np.exp(logits) / np.exp(logits).sum()
        x[chosen] -= 1
        return x / 50

    for _ in range(3):
        net.train(around, classes, low, squares)
        grads = [np.zeros_like(p) for p in plain]
        for c, t, word in zip(around, classes, low):
            hidden = np.tanh(sum(plain[0][k][x] for k, x in enumerate(c)) + plain[1])
            g, part = t // 16, slice(t // 16 * 16, t // 16 * 16 + 16)
            x = off(hidden @ plain[2] + plain[3], g)
            back = plain[2] @ x
            grads[2] += np.outer(hidden, x)
            grads[3] += x
            x = off(hidden @ plain[4][:, part] + plain[5][part], t % 16)
            back += plain[4][:, part] @ x
            grads[4][:, part] += np.outer(hidden, x)
            grads[5][part] += x
            for k in range(2 if t >= lm.FREQUENT else 0):
                prior = priors[k][((t - lm.FREQUENT) << 4 * k) + (word & (1 << 4 * k) - 1)]
                x = off(hidden @ plain[6][k] + plain[7][k] + prior, word >> 4 * k & 15)
                back += plain[6][k] @ x
                grads[6][k] += np.outer(hidden, x)
                grads[7][k] += x
            back *= 1 - hidden**2
            grads[1] += back
            for k, x in enumerate(c):
                grads[0][k][x] += back
        for p, g, s in zip(plain, grads, sums):
            s += g * g
            p -= lm.RATE * g / (np.sqrt(s) + 1e-6)
    assert all(np.allclose(a, b, atol=2e-3) for a, b in zip(net.parts, plain))


def test_contexts_stop_at_documents():
    got = lm.contexts(np.array([1, 2, 3, 4, 5], np.int32), np.array([0, 3, 3, 5]))
    x = lm.CLASSES
    assert got.tolist() == [[x, x, 2, 3], [x, 1, 3, x], [1, 2, x, x], [x, x, 5, x], [x, 4, x, x]]
