"""The pipeline's rows against plain versions of its stages, and its stages on odd rows."""

import re

import corpus_pipeline
from oddities import TEXTS, documents, nothing
from test_filters import plain_counts, plain_pii
from test_near_duplicates import plain_survivors
from test_tokens import check_packing

from tablewright.llm import pii, quality
from tablewright.llm.queries import op6_pii, op8_quality
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


def test_stages():
    assert NAMES == ["quality_rules", "simhash_near_dedup", "pii", "packing"]


def masked(text, spans):
    parts, done = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, stop)
    return "".join(parts) + text[done:]


def test_run_against_plain_stages(spark):
    verdicts = {r["doc_id"]: r["kept"] for r in op8_quality(spark, FOLDER).collect()}
    texts = sorted(tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect())
    assert all(verdicts[i] is False for i, t in texts if plain_counts(t)[5])
    good = [(i, t) for i, t in texts if verdicts[i]]
    survivors = plain_survivors(good)
    single = [(i, t) for i, t in good if i in survivors]
    assert 0 < len(single) < len(good) < len(texts)
    # the bootstrap adds nothing here, so plain patterns and lone card numbers are all there is to mask
    clean = []
    for i, t in single:
        spans = plain_pii(t)
        for m in re.finditer(r"\b[0-9]{13,19}\b", t):
            if any(p == ("card", 0, len(m[0])) for p in plain_pii(m[0])) and not any(a < m.end() and m.start() < b for _, a, b in spans):
                spans.append(("card", *m.span()))
        clean.append((i, masked(t, spans)))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert check_packing(rows, clean, 1024) < 0.03


def test_each_stage_takes_odd_rows(spark):
    for docs in (documents(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, FOLDER)
            assert found.columns == docs.columns, name
        assert stage(spark, docs, FOLDER).count() <= len(TEXTS)
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()
    kept = quality.drop_rejected(documents(spark))
    assert {r["doc_id"] for r in kept.collect()} <= {i for i, t in TEXTS if t and not plain_counts(t)[5]}
    assert pii.masked(kept).count() == kept.count()
    assert op6_pii(spark, FOLDER).count() == table(spark, FOLDER, "documents").count()
