"""Language identification by Bayesian evidence fusion (operator 10).

Evidence for each row: its text (naive Bayes over hashed byte trigrams, one model a
language), the declared (markup) language, and a prior of its host, which is smoothed
towards that of its address suffix, and that towards the corpus's. Models and priors come
from grouped counts over all rows, with the declared language as a noisy label; a row's
own counts are taken out of the models and priors that judge it. The log evidence is
added up; a class `und` with even trigrams stands for text in no known language.

Every declared language has a model of its own. Models go to all tasks so many at once;
with more languages the rows pass by several times, and what each pass found is put
together, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut, stored
from . import textkernel as tk

#: Trigram buckets; a model has so many numbers a language.
BUCKETS = 1 << 15
#: Models that go to all tasks at once, 256 KiB of counts each; languages whose counts a task holds.
AT_ONCE, HELD = 256, 128
#: Overlapping trigrams aren't independent: their log-likelihood counts so much.
TEXT_WEIGHT = 0.3
#: Chance that a declared language is right, and the pseudo-counts of the hierarchy's levels.
DECLARED_RIGHT, LEVEL_WEIGHT = 0.9, 20.0
#: Prior chance of no known language.
UNKNOWN = 0.01
#: Count added to each bucket.
ADDED = 0.5


def _letters() -> np.ndarray:
    """Bytes folded: A-Z to a-z, white space to a space, digits to 0, other ASCII signs to a space."""
    fold = tk.LOWER.copy()
    for b in range(128):
        c = chr(int(fold[b]))
        fold[b] = ord("0") if c.isdigit() else fold[b] if c.isalpha() else 32
    return fold


FOLD = _letters()


def _trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram with a letter or high byte in its middle, its row)."""
    n = len(buf)
    if n < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = FOLD[buf].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = (row[:-2] == row[2:]) & (b[1:-1] >= 97)
    code = code[good]
    return (code * np.uint32(2654435761)) >> np.uint32(17), row[:-2][good]


def languages(docs: DataFrame, declared_col: str) -> DataFrame:
    """_language, k (places in order of name, from 0), n (rows that declare it) of every declared language."""
    n = stored(docs.filter(F.col(declared_col).isNotNull()).groupBy(F.col(declared_col).cast("string").alias("_language")).agg(F.count("*").alias("n")))
    w = Window.orderBy("_language")  # a row a language
    return stored(n.select("_language", (F.row_number().over(w) - 1).alias("k"), "n"))


def text_counts(docs: DataFrame, text_col: str, declared_col: str) -> DataFrame:
    """_language, bucket, n: trigram counts of all rows that declare a language."""
    schema = pa.schema([("_language", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], schema=schema)
            held.clear()

        for batch in batches:
            said = batch.column(0).to_pylist()
            buf, offsets = tk.flat(batch.column(1))
            for i, j in tk.slices(offsets):
                code, row = _trigrams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place: dict[str, int] = {}
                of = np.array([-1 if x is None else place.setdefault(x, len(place)) for x in said[i:j]], np.int64)[row]
                pair, n = np.unique(of[of >= 0] * BUCKETS + code[of >= 0], return_counts=True)
                names = list(place)
                for k in np.unique(pair // BUCKETS).tolist():
                    lo, hi = np.searchsorted(pair, [k * BUCKETS, (k + 1) * BUCKETS])
                    if names[k] not in held:
                        if len(held) >= HELD:
                            yield from flush()
                        held[names[k]] = np.zeros(BUCKETS, np.int64)
                    held[names[k]][pair[lo:hi] - k * BUCKETS] += n[lo:hi]
        yield from flush()

    rows = docs.filter(F.col(declared_col).isNotNull()).select(F.col(declared_col).cast("string"), text_col)
    return rows.mapInArrow(count, "_language string, bucket int, n long").groupBy("_language", "bucket").agg(F.sum("n").alias("n"))


def text_evidence(column: pa.Array, own: np.ndarray, sums: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of trigrams, log-likelihood under each model and under even trigrams) of each row.

    sums: counts by bucket and model; model: log_model() of them. own: the model that counts
    the row, or -1; the row is taken out of that one.
    """
    buf, offsets = tk.flat(column)
    n, width = len(offsets) - 1, sums.shape[1]
    whole = sums.sum(axis=0)
    out, size = np.zeros((n, width + 1)), np.zeros(n, np.int64)
    for i, j in tk.slices(offsets):
        code, row = _trigrams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(code):
            continue
        pair, times = np.unique(row * BUCKETS + code, return_counts=True)
        row, code = pair // BUCKETS, pair % BUCKETS
        have, first = np.unique(row, return_index=True)
        total = np.add.reduceat(times, first)
        out[i + have, :width] = np.add.reduceat(model[code] * times[:, None], first, axis=0)
        out[i + have, width] = -total * np.log(BUCKETS)
        size[i + have] = total
        k = own[i + row]
        mine = k >= 0
        if mine.any():
            left = whole[k] - size[i + row]
            value = np.where(mine, times * np.log((np.where(mine, sums[code, k] - times, 0) + ADDED) / (np.where(mine, left, 0) + ADDED * BUCKETS)), 0.0)
            value = np.add.reduceat(value, first)
            k = own[i + have]
            at = np.flatnonzero(k >= 0)
            out[i + have[at], k[at]] = value[at]
    return size, out


def log_model(sums: np.ndarray) -> np.ndarray:
    return np.log((sums + ADDED) / (sums.sum(axis=0) + ADDED * BUCKETS))


def log_scores(text: np.ndarray, own: np.ndarray, declares: np.ndarray, host: tuple[np.ndarray, np.ndarray], suffix: tuple[np.ndarray, np.ndarray], share: np.ndarray, single: bool) -> np.ndarray:
    """Log of prior times evidence of some languages, a row each; constants that all have are left out.

    text: log-likelihoods of these languages; own: the declared one's place among them or
    -1; declares: whether the row declares any; host, suffix: rows that declare each, and
    that declare any, with the row itself; share: each one's of all rows. single: there is no other language.
    """
    n, width = text.shape
    mine = np.zeros((n, width))
    at = np.flatnonzero(own >= 0)
    mine[at, own[at]] = 1
    prior = share
    for counts, total in (suffix, host):
        prior = (counts - mine + LEVEL_WEIGHT * prior) / (total - declares + LEVEL_WEIGHT)[:, None]
    # a declared language against what any row would declare
    other = np.ones(width) if single else (1 - DECLARED_RIGHT) / (1 - share)
    said = np.where(declares[:, None], np.where(mine > 0, DECLARED_RIGHT / share, other), 1.0)
    return np.log(prior * (1 - UNKNOWN) * said) + TEXT_WEIGHT * text


def _dense(column: pa.Array, lo: int, width: int) -> np.ndarray:
    """Counts of languages lo to lo + width from a column of maps; a null map has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out, offsets = np.zeros((len(column), width)), np.asarray(column.offsets)
    part = slice(offsets[0], offsets[-1])
    row, k, n = np.repeat(np.arange(len(column)), np.diff(offsets)), column.keys.to_numpy()[part] - lo, column.items.to_numpy()[part]
    here = (k >= 0) & (k < width)
    out[row[here], k[here]] = n[here]
    return out


def declared_counts(docs: DataFrame, names: DataFrame, host_col: str, suffix_col: str | None, declared_col: str) -> tuple[DataFrame, DataFrame]:
    """(_host, _suffix, _of_host, _at_host) and (_suffix, _of_suffix, _at_suffix): maps of language to the number of rows that declare it, and of those that declare any."""
    rows = docs.filter(F.col(declared_col).isNotNull()).select(_part(host_col).alias("_host"), _part(suffix_col).alias("_suffix"), F.col(declared_col).cast("string").alias("_language"))
    by = rows.groupBy("_host", "_suffix", "_language").agg(F.count("*").alias("m"))
    by = cut(by.join(broadcast_if_small(names), "_language").select("_host", "_suffix", F.col("k").cast("int").alias("k"), "m"))
    as_map = lambda name: (F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias(f"_of_{name}"), F.sum("m").alias(f"_at_{name}"))  # noqa: E731  an entry a language
    return by.groupBy("_host", "_suffix").agg(*as_map("host")), by.groupBy("_suffix", "k").agg(F.sum("m").alias("m")).groupBy("_suffix").agg(*as_map("suffix"))


def _part(column: str | None):
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def identify(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", suffix_col: str | None = None, least: float = 0.5, at_once: int = AT_ONCE) -> DataFrame:
    """docs with language, confidence, n_trigrams and kept.

    language: the class of the highest posterior (of equal ones the first by name, `und`
    last), null where `und` wins or nothing is known. kept: a known language with a posterior
    of at least `least`, from a text with a letter. Every declared language has a model and
    can be found in any row, however rare it is. A null or empty text has no text evidence
    and is not kept. A null declared language, host or suffix adds no evidence of its own
    (hosts and suffixes that are null share one group). Rows count as often as they occur,
    and each is judged without its own counts. With no declared language at all nothing is
    kept. at_once: models that go to all tasks together; it changes no result. Columns of
    the names made here are replaced, others stay.
    """
    made = ("_host", "_suffix", "_of_host", "_of_suffix", "_at_host", "_at_suffix", "_best", "_score", "_mass", "_n", "_found")
    docs = docs.drop("language", "confidence", "n_trigrams", "kept", *made)
    names = languages(docs, declared_col)
    count, total = names.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return docs.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "n_trigrams": F.lit(0).cast("long"), "kept": F.lit(False)})
    of = text_counts(docs, text_col, declared_col).groupBy("_language").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("times"))  # BUCKETS at most
    models = stored(names.join(of, "_language", "left"))
    hosts, suffixes = declared_counts(docs, names, host_col, suffix_col, declared_col)
    said = F.col(declared_col).cast("string")
    d = docs.withColumns({"_host": _part(host_col), "_suffix": _part(suffix_col)})
    d = d.join(broadcast_if_small(cut(hosts)), ["_host", "_suffix"], "left").join(broadcast_if_small(cut(suffixes)), "_suffix", "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_at_host", "_at_suffix")})
    for lo in range(0, count, at_once):
        judged = _judge(models.filter((F.col("k") >= lo) & (F.col("k") < lo + at_once)), lo, count, total)
        d = d.withColumn("_found", judged(F.col(text_col), said, F.col("_of_host"), F.col("_of_suffix"), F.col("_at_host"), F.col("_at_suffix")))
        new, mass = F.col("_found.score"), F.col("_found.mass")
        if lo:  # the classes before come first among equals
            top = F.greatest("_score", new)
            mass = F.col("_mass") * F.exp(F.col("_score") - top) + mass * F.exp(new - top)
            d = d.withColumns({"_best": F.when(new > F.col("_score"), F.col("_found.best")).otherwise(F.col("_best")), "_mass": mass, "_score": top})
        else:
            d = d.withColumns({"_best": F.col("_found.best"), "_mass": mass, "_score": new, "_n": F.col("_found.n")})
        if lo + at_once < count:
            d = stored(d.drop("_found"))
    # `und`, with even trigrams: of equal ones last
    und = F.lit(float(np.log(UNKNOWN))) - F.col("_n") * float(TEXT_WEIGHT * np.log(BUCKETS))
    top = F.greatest("_score", und)
    sure = F.round(1 / (F.col("_mass") * F.exp(F.col("_score") - top) + F.exp(und - top)), 6)
    language = F.when((F.col("_n") > 0) & (F.col("_score") >= und), F.col("_best"))
    return d.select(*docs.columns, language.alias("language"), sure.alias("confidence"), F.col("_n").alias("n_trigrams"), (language.isNotNull() & (sure >= least)).alias("kept"))


def _judge(models: DataFrame, lo: int, count: int, total: int):
    """Judges rows by these models (from place lo on): best of them, its log score, the mass of all of them relative to it, n."""
    rows = models.orderBy("k").collect()  # AT_ONCE at most
    names, width = [r["_language"] for r in rows], len(rows)
    place = {x: k for k, x in enumerate(names)}
    sums = np.zeros((BUCKETS, width))
    for k, r in enumerate(rows):
        sums[r["bucket"] or [], k] = r["times"] or []
    shared = models.sparkSession.sparkContext.broadcast((sums, np.array([r["n"] + 1 for r in rows]) / (total + count)))
    logs: list[np.ndarray] = []  # once a task

    @F.arrow_udf("best string, score double, mass double, n long")
    def judged(texts: pa.Array, declared: pa.Array, of_host: pa.Array, of_suffix: pa.Array, at_host: pa.Array, at_suffix: pa.Array) -> pa.Array:
        sums, share = shared.value
        if not logs:
            logs.append(log_model(sums))
        said = declared.to_pylist()
        own, declares = np.array([place.get(x, -1) for x in said], np.int64), np.array([x is not None for x in said], bool)
        n, text = text_evidence(texts, own, sums, logs[0])
        host, suffix = ((_dense(c, lo, width), t.to_numpy(zero_copy_only=False).astype(float)) for c, t in ((of_host, at_host), (of_suffix, at_suffix)))
        score = log_scores(text[:, :width], own, declares, host, suffix, share, count == 1)
        best = score.argmax(axis=1)
        top = score[np.arange(len(best)), best]
        return pa.StructArray.from_arrays([pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(top), pa.array(np.exp(score - top[:, None]).sum(axis=1)), pa.array(n)], ["best", "score", "mass", "n"])

    return judged


def of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, text, lang, host, suffix of web pages: what identify() reads.

    text is the markup without scripts, styles, comments and tags; lang the primary subtag
    of <html lang>, lower-cased; host that of the url, suffix its last label. What is absent
    is null (text: empty).
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    lang = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    empty = lambda c: F.when(c != "", c)
    return pages.select(id_col, text.alias("text"), empty(lang).alias("lang"), empty(host).alias("host"), empty(F.regexp_extract(host, r"([^.]*)$", 1)).alias("suffix"))
