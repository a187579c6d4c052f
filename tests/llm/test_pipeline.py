"""The pipeline against a plain version of its five stages on a small table with planted cases."""

from __future__ import annotations

import random

import pytest
import regex

import corpus_pipeline
from sparkloom.llm import secrets, simhash, toxicity, vocab
from tests.llm.test_brute import print_of, secrets_of, toxicity_of
from tests.llm.test_llm_operators import near_brute, prose

SECRET = "kX9fQ2mZ7vB4nT1pL8sR3wY6"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    d = tmp_path_factory.mktemp("sf")
    item = prose(rng, 20)
    docs = [(i, prose(rng, 60), "en", "web", 0) for i in range(30)]
    docs += [(100, docs[0][1], "en", "web", 0), (101, docs[1][1] + " more", "en", "hot", 0)]
    docs += [(102, "you are an idiot and a moron " + prose(rng, 30), "en", "web", 0), (103, f"token = {SECRET} " + prose(rng, 50), "en", "web", 0)]
    docs += [(104, prose(rng, 20) + " " + item.upper() + ". " + prose(rng, 20), "en", "web", 0), (105, "", "en", None, 0), (106, None, None, "web", None), (None, "a text of no number", "en", "web", 0), (None, "a text of no number", "en", "web", 0)]
    docs += [docs[2], docs[2], (107, prose(rng, 9000), "en", "web", 0)]  # repeated rows, a very long text
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (102, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, item


def brute(docs, item):
    """The five stages in plain Python; nothing of the operators but their parameters."""
    docs = [r for r in docs if not (r[1] and toxicity_of(r[1], toxicity.SEEDS) >= toxicity.THRESHOLD)]
    prints = {r[0]: p for r in docs if r[0] is not None and (p := print_of(r[1] or ""))}
    gone = {a for a, b in near_brute(prints, simhash.PROBE_BITS, simhash.VERIFY_BITS) if a != b}
    once = list(dict.fromkeys(r for r in docs if r[0] is not None))
    docs = [r for r in once if r[0] not in gone] + [r for r in docs if r[0] is None]
    word = lambda t: regex.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda t: {tuple(word(t)[i : i + 8]) for i in range(len(word(t)) - 7)}
    docs = [r for r in docs if not grams(r[1]) & grams(item)]
    enc = vocab.encoding(vocab.DEFAULT_VOCAB)
    out = []
    for doc_id, text, *_ in docs:
        for a, b in reversed(secrets_of(text or "")):
            text = text[:a] + secrets.PLACEHOLDER + text[b:]
        out.append((doc_id, None if text is None else tuple(enc.encode_ordinary(text))))
    return out


def test_same_as_the_plain_version(spark, folder):
    d, docs, item = folder
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted(((r["doc_id"], None if r["token_ids"] is None else tuple(r["token_ids"])) for r in got), key=repr) == sorted(brute(docs, item), key=repr)
    ids = {r["doc_id"] for r in got}
    assert not ids & {100, 101, 102, 104} and {0, 1, 103, 105, 106, None} <= ids
    assert all(r["round_trip"] for r in got if r["token_ids"] is not None)


def test_stages_keep_columns_and_empty_tables(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("source", "digest").selectExpr("*", "1 as key", "'x' as g")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), d).count() == 0, name
