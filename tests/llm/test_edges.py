"""Repeated rows, rows without an id, empty texts and columns of clashing names, for every operator over documents."""

import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import attention_lm, decontam, exact_dedup, near_copies, pii, repeats, simhash, sp_lattice, toxicity
from ledgerlink.llm.common import shared_dir
from ledgerlink.llm.token_shards import read_token_shards, write_token_shards

ROWS = [(1, "mail a@b.com now"), (1, "mail a@b.com now"), (2, None), (3, ""), (None, "no id"), (4, "x " * 30), (5, "mail a@b.com now")]
CLASHES = "id shard digest fp n word pos unit phrase score predicted h label spans hits slot".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in ROWS], "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES)).repartition(3, "n")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda i: (i is None, i or 0))


ALL, NAMED = [1, 1, 2, 3, 4, 5, None], [1, 1, 2, 3, 4, 5]


def test_rows_are_reported_one_by_one(spark, docs):
    bench = spark.createDataFrame([(1, "a@b com now")], "item_id long, text string")
    assert ids(decontam.contamination(docs, bench)) == ALL
    assert ids(pii.find_pii(docs)) == ALL
    assert ids(exact_dedup.exact_dedup(docs)) == ALL
    marks = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert ids(toxicity.toxicity(docs, model)) == ALL
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert ids(simhash.simhash_components(docs)) == NAMED
    assert ids(repeats.remove_repeats(docs)) == NAMED


def test_repeated_ids_in_token_files_and_encodings(spark, docs):
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    write_token_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(read_token_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == NAMED and [r.start for r in rows][1:] == [r.start + r.n_tokens for r in rows][:-1]
    encoded = sp_lattice.Encoding(docs, public_tokenizers.path("piece_bpe_32k.model")).documents()
    assert ids(encoded) == NAMED and encoded.filter("not round_trip").count() == 0


def test_repeated_ids_are_one_document_to_the_others(spark, docs):
    scores = attention_lm.score_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), F.col("doc_id") != 2)
    assert {r.doc_id: r.n_tokens for r in scores.collect()} == {1: 8, 2: 1, 3: 1, 4: 31, 5: 4}
    assert {r.doc_id: r.keep_id for r in near_copies.near_copies(docs).collect()} == {5: 1}
