"""Encodings against the library, round trips, appends and edits."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab' \n\t\x1c\x85 thes1é漢🙂", max_size=80)))
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_appends_and_edits_are_exact():
    r = random.Random(3)
    vocabulary = CODEC.vocabulary
    for _ in range(60):
        data = bytes(r.choice(b"abcdehinorst ") for _ in range(r.randint(0, 60)))
        p = bpe.Prefixes(vocabulary, data[:20])
        p.append(data[20:])
        assert p.ids() == vocabulary.merged(data)
        a = r.randint(0, len(data))
        b = min(len(data), a + r.randint(0, 5))
        new = bytes(r.choice(b"the xq") for _ in range(r.randint(0, 4)))
        p.edit(a, b, new)
        assert p.data == data[:a] + new + data[b:] and p.ids() == vocabulary.merged(p.data)


def test_an_edit_stays_local():
    p = bpe.Prefixes(CODEC.vocabulary, b"the cat and the dog went home " * 60)
    assert p.edit(5, 6, b"u") < 600
    assert p.ids() == bpe.Prefixes(CODEC.vocabulary, p.data).ids()


def test_query_columns_nulls_repeats_and_long_texts(spark):
    texts = [None, "", " ", "Hello  world\n\nagain", "Hello  world\n\nagain", "naïve 漢字 🙂", "x" * 3000 + " y" * 3000]
    docs = spark.createDataFrame([(t, i, "n") for i, t in enumerate(texts)], "text string, doc_id long, n_tokens string")
    got = {x.doc_id: x for x in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    full = {x.doc_id: x for x in bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert full[3].ids == LIBRARY.encode_ordinary(texts[3]) and bytes(full[5].decoded) == texts[5].encode()
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        bpe.Prefixes(bpe.Vocabulary({b"a": 0}), b"b")
