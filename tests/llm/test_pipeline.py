"""The pipeline against brute force, stage by stage, each on its own input."""

import corpus_pipeline as P
from strandlake.llm import decontaminate

from .. import oracle
from . import brute
from .test_similar_texts import components, shingles


def test_stages(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    items = [(r.item_id, brute.plain_words(r.text)) for r in spark.read.parquet(f"{oracle.DATA}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        rows = sorted(map(tuple, docs.collect()))
        out = stage(spark, docs, oracle.DATA)
        got = sorted(map(tuple, out.collect()))
        assert out.columns == P.COLUMNS
        if name.startswith("language"):
            found = brute.languages([(r[1], r[2], r[3], None) for r in rows])
            assert got == [r for r, (_, _, kept) in zip(rows, found) if kept] and len(got) >= 0.99 * len(rows)
        elif name.startswith("line"):
            texts = brute.dedup_lines([(r[0], r[1]) for r in rows])
            assert got == [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts)]
        elif name.startswith("SimHash"):
            sets = [shingles(r[1]) for r in rows]
            assert got == [r for r, c in zip(rows, components([r[0] for r in rows], sets)) if r[0] == c]
        else:
            leaking = set()
            for r in rows:
                w = brute.plain_words(r[1])
                pairs = set(zip(w, w[1:]))
                for _, item in items:
                    d = decontaminate.edits(len(item))
                    if len(pairs & set(zip(item, item[1:]))) >= (len(set(zip(item, item[1:]))) - 2 * d) / 2 and brute.edit_in(item, w) <= d:
                        leaking.add(r[0])
            assert got == [r for r in rows if r[0] not in leaking] and leaking
        docs = spark.createDataFrame(got, docs.schema)
    final = P.STAGES[-1][1](spark, docs, oracle.DATA)
    assert sorted((r.doc_id, r.decoded_sha256) for r in final.collect()) == sorted((r.doc_id, brute.sha(r.text)) for r in docs.collect())
    assert [n for n, _ in P.STAGES][-1].startswith("byte-level")
