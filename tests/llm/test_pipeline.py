"""Each stage on awkward rows, and the whole against a plain retelling."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pantryline.llm import bpe, langid, toxicity
from pantryline.llm.queries import learnable
from test_texts import SF, plain_components, plain_items


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, edge_docs, no_docs, name, stage):
    out = stage(spark, edge_docs, SF)
    if name != "bpe":
        assert out.columns == edge_docs.columns
    assert 0 < out.count() <= edge_docs.count()
    assert stage(spark, no_docs, SF).count() == 0


def test_whole_pipeline(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(learnable(rows, 4, 2))
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    known = langid.identify([t for _, t in docs], model)
    docs = [d for d, (lang, score) in zip(docs, known, strict=True) if lang != "und" and score >= 0.3]

    first = spark.createDataFrame(docs, "doc_id long, text string")
    judge = toxicity.learn(first, learnable(spark.read.parquet(f"{SF}/labels.parquet"), 5, 0))
    docs = [d for d in docs if judge.score(d[1]) < 0.5]

    least = plain_components(docs, 5)
    docs = [d for d in docs if least[d[0]] == d[0]]

    items = [plain_items(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda own: any(i and 100 * len(i & own) >= 80 * len(i) for i in items)
    docs = [d for d in docs if not leaks(plain_items(d[1]))]

    library = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < rows.count()
