"""The pipeline's stages, one after another, against what each must keep."""

import re
from collections import defaultdict

from peakfield.llm.queries import queries

from .conftest import frame, prose
from .test_near_dedup import shingles


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(i, 60 + i)) for i in range(20)]
    near = [(100, clean[3][1] + " extra"), (101, "prefix " + clean[4][1])]
    docs = [*clean, *near, (200, clean[7][1]), (201, None), (202, "too short"), (203, " ".join(f"ab{i}***" for i in range(50))), (204, prose(77, 70) + " password=hunter2222 " + prose(78, 5))]
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = now.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns
        left[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(left["quality"]) == {i for i, _ in docs} - {201, 202, 203}
    assert set(left["exact_dedup"]) == set(left["quality"]) - {7}
    assert set(left["near_dedup"]) == set(left["exact_dedup"]) - {100, 101}
    assert len(shingles(near[0][1], 5) & shingles(clean[3][1], 5)) > 40
    assert re.search(r" \[SECRET\] ", left["secrets"][204]) and left["secrets"][1] == clean[1][1]
    tokens = defaultdict(int)
    for r in queries()["pipeline"](spark, str(tmp_path)).collect():
        assert len(r.ids) == r.length
        tokens[r.doc_id] += r.length
        assert r.doc_tokens >= r.length
    assert set(tokens) == set(left["secrets"])


def test_names(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    assert len([k for k in queries() if k.startswith("op")]) == 10
