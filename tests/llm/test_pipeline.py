"""The corpus pipeline, stage by stage, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import secrets
from strandline.llm.common import written
from tests.llm.helpers import awkward, empty
from tests.llm.test_operators import brute_components, brute_secrets

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        new = written(f(spark, docs, SF), "test")
        out.append((name, docs, new))
        docs = new
    return out


def test_stages_keep_columns(stages):
    assert [s[0] for s in stages] == ["quality classifier", "language ID", "n-gram Jaccard join", "secret scans", "packing"]
    assert all(new.columns == COLUMNS for _, _, new in stages[:-1])


def test_filters_keep_clean_documents(spark, stages):
    clean = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    for _, before, after in stages[:2]:
        a, b = ({r[0] for r in df.select("doc_id").collect()} & clean for df in (before, after))
        assert len(b) >= 0.9 * len(a)


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[2]
    known = {r[0]: r[1] for r in before.select("doc_id", "text").collect()}
    want = {d for d, (n, c) in brute_components(known, 5, 80).items() if d == c}
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(want)


def test_secrets_go_and_documents_stay(stages):
    _, before, after = stages[3]
    a, b = ({r[0]: r for r in df.collect()} for df in (before, after))
    assert set(a) == set(b)
    for d in a:
        found = brute_secrets(a[d]["text"])
        assert found == "" or b[d]["text"] != a[d]["text"]
        assert brute_secrets(b[d]["text"]) == "" and b[d]["n_chars"] == len(b[d]["text"])
        if a[d]["text"] == b[d]["text"]:
            assert not re.search("AKIA[A-Z0-9]{16}", a[d]["text"])


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    want = stages[-1][2].collect()
    total = lambda rs: Counter({r["doc_id"]: r["doc_tokens"] for r in rs})
    assert total(rows) == total(want) and sum(r["length"] for r in rows) == sum(total(rows).values())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_and_empty_tables(spark, k):
    f = corpus_pipeline.STAGES[k][1]
    d = awkward(spark)
    rows = f(spark, d, SF).collect()
    if k == 3:
        assert len(rows) == d.count() and sum(r["text"] is None for r in rows) == 2
    if k == 2:
        kept = Counter(r["doc_id"] for r in rows)
        assert kept[6] == 1 and kept[7] == 0
    assert f(spark, empty(spark), SF).count() == 0


def test_redaction_is_whole_text(spark):
    t = "x" * 1_000_000 + " AKIA" + "A" * 20
    (row,) = secrets.redact_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    assert row["text"] == "x" * 1_000_000 + " [access]" and np.isclose(len(row["text"]), 1_000_009)
