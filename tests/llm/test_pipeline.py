"""Each stage of the pipeline on its own input, and the whole against the stages' plain versions."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from ledgerloom.llm import bpe

from .test_jaccard import plain_classes
from .test_secrets import base, linked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    part = ["the", "ing", "er", "tion", "on", "re", "st", "ly", "ou", "ha"]
    rows, labels = [], []
    for i in range(300):
        words = ["".join(r.choice(part) for _ in range(r.randint(1, 4))) for _ in range(60)]
        if i % 4 == 0:
            words[r.randint(0, 59)] = r.choice(["idiot", "clown"])
        if i % 7 == 1:
            words.append('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(300 + i, rows[i][1] + " more", "en", "s0", 1) for i in range(1, 60)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def redact(text):
    out, at = [], 0
    for a, _, b in sorted(base(text) + linked(text)):
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = p.toxic_out(spark, docs, folder)
    assert clean.columns == docs.columns
    left = {x.doc_id: x.text for x in clean.collect()}
    toxic = {x.doc_id for x in docs.collect() if x.text and ("idiot" in x.text or "clown" in x.text)}
    assert len(toxic & set(left)) <= 2 and len(set(left)) >= docs.count() - len(toxic) - 2
    assert 400 in left and 401 in left
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    one = p.near_copies_out(spark, clean, folder)
    classes = plain_classes([(t, i) for i, t in left.items()])
    assert one.columns == docs.columns and sorted(x.doc_id for x in one.collect()) == sorted({c for _, c in classes.values()})
    one = spark.createDataFrame(one.collect(), docs.schema)
    blotted = p.secrets_out(spark, one, folder)
    before = {x.doc_id: x.text for x in one.collect()}
    assert blotted.columns == docs.columns
    for x in blotted.collect():
        assert x.text == (None if before[x.doc_id] is None else redact(before[x.doc_id])) and x.n_chars == (None if x.text is None else len(x.text))
    mix = p.mixed(spark, spark.createDataFrame(blotted.collect(), docs.schema), folder)
    assert mix.columns == docs.columns and 0 < mix.count() and not {400, 401} & {x.doc_id for x in mix.collect()}


def test_whole_run_encodes_what_is_left(spark, folder):
    out = p.run(spark, folder).collect()
    texts = {x.doc_id: redact(x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").collect() if x.text}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(out) > 100
    for x in out:
        ids = library.encode_ordinary(texts[x.doc_id])
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


CLASHES = ("score", "predicted", "_first", "node", "component", "_time", "_times", "taken", "size", "n", "row", "shard", "spans", "kind", "ids", "held_out", "Doc")


def test_clashing_columns_long_texts_and_repeated_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(120)
    long = ("harmless words and more of them " * 40_000).strip()
    extra = spark.createDataFrame([(900, long, "en", "s0", 1), (901, "same here now", "en", "s1", 1), (901, "same here now", "en", "s1", 1)], docs.schema)
    docs = docs.union(extra).select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(p.STAGES):
        now = stage(spark, now, str(tmp_path))
        if i < len(p.STAGES) - 1:
            assert now.columns == docs.columns and now.filter(" or ".join(f"`{c}` <> '{c}!'" for c in CLASHES)).isEmpty()
            now = spark.createDataFrame(now.collect(), docs.schema)
            assert {900, 901} <= {r.doc_id for r in now.select("doc_id").collect()}
    assert {r.doc_id for r in now.collect()} >= {900, 901}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
