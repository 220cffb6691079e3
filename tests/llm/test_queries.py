"""Each query with SQL against that SQL, the others against plain rules, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from lexiscore.llm.queries import ORACLES, QUERIES
from tests.compare import connect, normal
from tests.llm.cases import prose
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_ngram_join import near
from tests.llm.test_ngram_join import plain as plain_classes
from tests.llm.test_texts import plain_spans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(connect(SF_DIR).execute("SELECT doc_id, text FROM documents").fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toArrow().to_pandas(integer_object_nulls=True)
    want = connect(SF_DIR).execute(ORACLES[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    assert normal(got).equals(normal(want))


def test_secrets_against_plain_patterns(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op3_secret_scan"](spark, SF_DIR).collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        base = plain_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        # The network only adds.
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))


def test_tokens_and_pieces_against_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = dict(zip(docs, library.encode(list(docs.values()))))
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, SF_DIR).collect()}
    assert counts == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 4096) for i, t in docs.items()}
    rows = {r.doc_id: r for r in QUERIES["op9_sentence_pieces"](spark, SF_DIR).collect()}
    assert {i: r.ids for i, r in rows.items()} == ids
    assert all(rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items())


def test_toxicity_columns(spark, docs):
    rows = QUERIES["op8_toxicity"](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Documents with toxic ones, shared lines, copies and leaks, and the other tables of the pipeline."""
    folder = tmp_path_factory.mktemp("tables")
    item = prose(5000, 30)
    rows, labels = [], []
    for i in range(240):
        text = f"{prose(i, 60)}\n{prose(i + 300, 20)}"
        if i % 6 == 0:
            text += " vilething foulperson nastyword"
        if i % 5 == 1:
            text += "\nA footer that very many pages share, word by word"
        if i % 20 == 3:
            text += f" {item} and on {i}"
        rows.append((i, text))
        labels.append((i, int(i % 6 == 0)))
    rows += [(300 + i, near(rows[i][1], i, 1)) for i in (1, 2, 4, 5)] + [(310, rows[7][1]), (311, None), (312, ""), (None, "no id")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_lines string, node int")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_pipeline_stage_by_stage(spark, small_tables):
    folder, rows = small_tables
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "sentence_pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left[name] = [(r.doc_id, r.text) for r in docs.collect()]
    toxic = {i for i, t in rows if "vilething" in (t or "")}
    assert sorted(left["toxicity"], key=str) == sorted(((i, t) for i, t in rows if i not in toxic), key=str)
    lines = sorted(((i, t) for i, t, _, _ in plain_lines(left["toxicity"])), key=str)
    assert sorted(left["line_dedup"], key=str) == lines
    first = {(d, c) for d, c, _, _ in plain_classes(left["line_dedup"])}
    kept = [(i, t) for i, t in left["line_dedup"] if (i, i) in first]
    assert sorted(left["ngram_jaccard"], key=str) == sorted(kept, key=str) and len(kept) < len(lines)
    leaking = {i for i, t in left["ngram_jaccard"] if prose(5000, 30) in t}
    assert leaking
    clean = [(i, t) for i, t in left["ngram_jaccard"] if i not in leaking]
    assert sorted(left["decontamination"], key=str) == sorted(clean, key=str)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id].append(r.ids)
    assert got == {i: [library.encode(t)] for i, t in clean}


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in {
        "documents": "doc_id long, text string", "labels": "doc_id long, toxic int", "benchmark": "item_id long, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
