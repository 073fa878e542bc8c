"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline
    from codrel.llm import decontamination, quality
    from codrel.llm.common import table, written
    from test_operators import brute_components

    docs = table(spark, FOLDER, "documents")
    kept, frames = [docs], {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = written(stage(spark, kept[-1], FOLDER), "test-stage")
        kept.append(frames[name])
    rows = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in kept[:-1]]
    assert all(df.columns == docs.columns for df in kept[:-1])

    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    good = {d for d, _ in rows[1]}
    assert good < {d for d, _ in rows[0]}
    judged = [(d in good) == (y == 1) for d, y in labels.items() if d in {x for x, _ in rows[0]}]
    assert sum(judged) >= 0.95 * len(judged)

    before, after = dict(rows[1]), dict(rows[2])
    seen: set[str] = set()
    for d in sorted(before):
        lines = before[d].split("\n")
        left = after.get(d, "").split("\n")
        assert set(left) <= set(lines) | {""}
        for line in left:
            assert len(line.strip()) < 20 or line.strip() not in seen
        seen |= {x.strip() for x in lines}
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())

    least = {d for d, _, c in brute_components(rows[2], 5, 80) if d == c}
    assert {d for d, _ in rows[3]} == least

    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    matcher = decontamination.Matcher(items)
    assert {d for d, _ in rows[4]} == {d for d, t in rows[3] if not matcher.matches(t)}

    packed = frames["best-fit packing"].toPandas()
    assert set(packed["doc_id"]) == {d for d, _ in rows[4]}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert quality.score(kept[0].limit(0), quality.fit([], __import__("numpy").zeros(0))).count() == 0
