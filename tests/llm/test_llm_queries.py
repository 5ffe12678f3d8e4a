"""Registered queries against their SQL twins, and the pipeline against plain code, on a small table."""

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_check import connect, difference, duck_rows, spark_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from priorform.llm import bpe  # noqa: E402
from priorform.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, FOLDER)), duck_rows(connect(FOLDER), ORACLES[name])) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_language", "op5_quality"])
def test_held_out_accuracy(spark, name):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    column = "lang from documents" if name == "op1_language" else "quality from labels"
    truth = dict(connect("/root/testdata/sf0.01").sql(f"select doc_id, {column}").fetchall())
    said = "lang_pred" if name == "op1_language" else "predicted"
    asked = [i for i in truth if got[i]["held_out"]]
    assert len(got) == 1000 and sum(got[i][said] == truth[i] for i in asked) >= 0.97 * len(asked)


def test_language_model_beats_single_words_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op8_lm_scores"](spark, FOLDER).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())
    kept = [set(texts)]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, FOLDER).cache()
        if name != "encoded":
            assert frame.columns == docs.columns
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        assert kept[-1] <= kept[-2] and kept[-1]
    assert len(kept[3]) < len(kept[2]) and len(kept[4]) < len(kept[3]) and kept[5] == kept[4]
    for r in frame.collect():
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from test_llm_operators import brute_groups, brute_hits

    groups = brute_groups([(i, texts[i]) for i in sorted(kept[2])], 5, 80)
    assert kept[3] == {i for i, n, c in groups if i == c or not n}
    items = [(str(i), t) for i, t in connect(FOLDER).sql("select item_id, text from benchmark").fetchall()]
    assert kept[4] == {i for i in kept[3] if not brute_hits(texts[i], items)[1]}


def test_stages_with_awkward_rows(spark):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "s", 0), (None, "a text without an id", "en", "s", 1), (3, "plain words of a text", "en", "s", 1),
            (3, "plain words of a text", "en", "s", 1), (3, "another text under the same id", "en", "s", 1), (4, "Plain words of a text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str) == sorted(
        [(1, None), (2, ""), (None, "a text without an id"), (3, "plain words of a text"), (3, "another text under the same id")], key=str
    )
    assert corpus_pipeline.language(spark, docs, FOLDER).count() == 5
    assert corpus_pipeline.decontaminated(spark, docs, FOLDER).count() == 8
    assert corpus_pipeline.encoded(spark, docs, FOLDER).count() == 8
    assert corpus_pipeline.quality(spark, docs, FOLDER).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), FOLDER).count() == 0


def test_rank_file_is_complete():
    import public_tokenizers

    assert len(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))) == 50256
