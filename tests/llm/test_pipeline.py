import duckdb
import pytest

import corpus_pipeline as P
from test_decontamination import brute as leaks
from test_mixing import brute as schedule
from test_near_dedup import brute as components
from test_secrets import brute as secret_spans
from tidelog.llm import mixing, quality, secrets
from tidelog.llm.scratch import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of every stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    yield {name: (before.orderBy("doc_id").collect(), after.orderBy("doc_id").collect(), after.columns) for name, before, after in out}
    for _, _, after in out:
        after.unpersist()


def test_order_and_columns(stages):
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]
    assert all(stages[name][2] == COLUMNS for name, _ in P.STAGES[:-1])
    assert stages["mixing"][2] == COLUMNS + list(mixing.ADDED)


def test_quality_keeps_what_is_scored_good(spark, stages):
    before, after, _ = stages["quality"]
    docs = table(spark, SF, "documents")
    keep = {r.doc_id for r in quality.score(docs, table(spark, SF, "labels")).where("keep").collect()}
    assert {r.doc_id for r in after} == keep and 0 < len(after) < len(before)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after, _ = stages["near_dedup"]
    comp = components([(r.doc_id, r.text) for r in before], 5, 80)
    assert [r.doc_id for r in after] == sorted(set(comp.values()))
    assert len(after) < len(before)


def test_decontamination_drops_leaks(stages):
    before, after, _ = stages["decontamination"]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    found = {before[k].doc_id for k, _ in leaks([r.text for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - found


def test_secrets_are_masked(stages):
    before, after, _ = stages["secrets"]
    spans = [base for base, _ in secret_spans([r.text for r in before])]
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    for old, new, found in zip(before, after, spans, strict=True):
        assert all(value not in new.text for _, _, _, value in found)
        assert (old.text == new.text) == (secrets.MASK not in new.text) and new.n_chars == len(new.text)


def test_mixture(stages):
    before, after, _ = stages["mixing"]
    got = {(r.doc_id, r.source): (r.source_block, r.position, r.place) for r in after}
    assert got == schedule([(r.doc_id, r.source) for r in before], mixing.BLOCK)


def test_run_applies_all_stages(spark, stages):
    got = sorted(map(tuple, P.run(spark, SF).collect()))
    assert got == sorted(map(tuple, stages["mixing"][1]))
