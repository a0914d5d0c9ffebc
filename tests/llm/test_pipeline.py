"""The pipeline against its stages in plain Python."""

import math
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_corpus_operators import base_spans, brute_components
from tidegauge.llm import quality, queries

pytestmark = pytest.mark.filterwarnings("ignore")


def test_stages_and_result(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = quality.train(docs)
    kept = {}
    for r in docs.collect():
        words = r.text.split()
        z = float(np.sqrt(quality.features(words)) @ weights[:-1].astype(np.float32) + weights[-1])
        if words and 1 / (1 + math.exp(-z)) >= 0.5:
            kept[r.doc_id] = r.text
    ids = sorted(kept)
    component = brute_components([kept[k] for k in ids], 5, 80, 100)
    left = {ids[i]: kept[ids[i]] for i, (_, c) in component.items() if c == i}
    tokenizer, want = Tokenizer.from_file(queries.JSON_TOKENIZER), {}
    for k, t in left.items():
        at, out = 0, ""
        for a, _, b in base_spans(t):
            out, at = (out + t[at:a] + "[SECRET]" if a >= at else out), max(at, b)
        want[k] = len(tokenizer.encode(out + t[at:], add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
