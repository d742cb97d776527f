"""Brute-force versions of the operators, in plain Python."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(SPACE, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fingerprint(text, k=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def repeated(sequences, length):
    """Marks of symbols in windows that start twice or more."""
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        mark = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                mark[i : i + length] = [True] * length
        out.append(mark)
    return out


def runs(mark):
    return sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def edit_in(item, text):
    """Least edit distance of item to any stretch of text."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        cur = [i + 1]
        for j, b in enumerate(text):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def dedup_lines(docs, run=3, long=60):
    """docs: (id, text) in order of id. Texts without later copies of runs of lines and of long lines."""
    norm = lambda s: re.sub("[\x09-\x0d]", " ", s).strip(" ")
    seen, out = set(), []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        full = [(i, norm(s)) for i, s in enumerate(lines) if norm(s)]
        gone = set()
        for k in range(len(full) - run + 1):
            body = tuple(s for _, s in full[k : k + run])
            if body in seen:
                gone |= {i for i, _ in full[k : k + run]}
            seen.add(body)
        for i, s in full:
            if len(s) >= long:
                gone |= {i} if s in seen else set()
                seen.add(s)
        out.append("\n".join(s for i, s in enumerate(lines) if i not in gone) if gone else text)
    return out


def languages(rows, least=0.5):
    """rows: (text, declared, host, suffix). (language, confidence, kept) of each, counted row by row."""
    from collections import defaultdict
    from math import exp, log

    def grams(text):
        b = [c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
        b = [48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 else 32 for c in b]
        codes = [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2) if b[i + 1] >= 97]
        return Counter((c * 2654435761 & 0xFFFFFFFF) >> 17 for c in codes)

    said = Counter(d for _, d, _, _ in rows if d is not None)
    names = sorted(said)
    of = lambda d: None if d is None else names.index(d)
    text, hosts, suffixes, corpus = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
    for t, d, h, s in rows:
        if d is not None:
            text[of(d)].update(grams(t))
            hosts[h or "", s or ""][of(d)] += 1
            suffixes[s or ""][of(d)] += 1
            corpus[of(d)] += 1
    p = [(corpus[k] + 1) / (sum(corpus.values()) + len(names)) for k in range(len(names))]
    out = []
    for t, d, h, s in rows:
        g, own, score = grams(t), of(d), []
        for k in range(len(names)):
            me = own == k
            prior = p[k]
            for counts in (suffixes[s or ""], hosts[h or "", s or ""]):
                prior = (counts[k] - me + 20 * prior) / (sum(counts.values()) - (own is not None) + 20)
            fits = 1 if own is None else 0.9 / p[k] if me else 0.1 / (1 - p[k])
            whole = sum(text[k].values()) - me * sum(g.values())
            like = sum(n * log((text[k][c] - me * n + 0.5) / (whole + 0.5 * 32768)) for c, n in g.items())
            score.append(log(prior * 0.99 * fits) + 0.3 * like)
        score.append(log(0.01) - 0.3 * sum(g.values()) * log(32768))
        best = max(range(len(score)), key=lambda k: (score[k], -k))
        sure = 1 / sum(exp(x - score[best]) for x in score)
        name = None if best == len(names) or not g else names[best]
        out.append((name, sure, name is not None and sure >= least))
    return out


def url_rules(baskets, min_bad, min_confidence):
    """baskets: (tokens, bad). {rule: (bad pages, pages)}, by trying all sets of tokens."""
    from itertools import combinations

    where = {}
    for k, (tokens, _) in enumerate(baskets):
        for t in set(tokens):
            where.setdefault(t, set()).add(k)
    least = {}
    for t in sorted(where):
        least.setdefault(frozenset(where[t]), t)
    own = set(least.values())
    base = sum(bad for _, bad in baskets) / max(1, len(baskets))
    pages, bads = Counter(), Counter()
    for tokens, bad in baskets:
        t = sorted(set(tokens) & own)
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                pages[c] += 1
                bads[c] += bad
    sure = {}
    for c, n in pages.items():
        p, z = bads[c] / n, 1.645
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if bads[c] >= min_bad and p >= min_confidence and low > base:
            sure[c] = p
    kept = [c for c in sure if not any(sure.get(x, -1) >= sure[c] for k in range(1, len(c)) for x in combinations(c, k))]
    return {c: (bads[c], pages[c]) for c in kept}


def url_tokens(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    labels = host.split(".")
    q = re.search(r"\?([^#]*)", url)
    out = {"h:" + x for x in labels} | {"d:" + ".".join(labels[-2:])} | {"p:" + x for x in re.sub("[0-9]+", "0", path).split("/")}
    out |= {"q:" + re.sub("[0-9]+", "0", re.sub("(?s)=.*", "", x)) for x in (q[1] if q else "").split("&")} | ({"f:#"} if "#" in url else set())
    return host, path, {t for t in out if len(t) > 2}


def filter_urls(pages, labels, listed, min_bad=5, min_confidence=0.5):
    """((page_id, host, path, rule, verdict) of each page, the mined rules)."""
    tokens = {i: url_tokens(u) if u is not None else ("", "", None) for i, u in pages}
    baskets = [(tokens[i][2], q == 0 or t == 1) for i, q, t in labels if i in tokens and tokens[i][2] is not None]
    mined = url_rules(baskets, min_bad, min_confidence)
    out = []
    for i, _ in pages:
        host, path, t = tokens[i]
        fit = [(len(h + p), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, None))
        out.append((i, host, path, rule, verdict or ("block" if t and any(set(c) <= t for c in mined) else "allow")))
    return out, mined
