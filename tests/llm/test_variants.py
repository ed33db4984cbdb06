"""Spelling variants against loops over all pairs of words, and the plain SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import variants as v


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if one_edit(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def plain_words(docs, least_length=6, least=5, one_in=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("seed,letters,longest,big", [(0, "ab", 7, 1024), (1, "abc", 5, 4), (2, "aé", 8, 2), (3, "abcdefg", 4, 64)])
def test_trie_finds_all_pairs_once(spark, monkeypatch, seed, letters, longest, big):
    monkeypatch.setattr(v, "BIG", big)
    monkeypatch.setattr(v, "NAMED", 3)
    r = random.Random(seed)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.choice([1, 2, 2, 11, 60, 301, 1600]) for _ in range(130)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(v.grouped(words)) == plain(counts)


def test_words_of_texts(spark):
    r = random.Random(9)
    stems = ["Garten", "garten", "gartén", "gärten", "gartens", "rgarten", "gartenx", "Straßen", "straßen", "straen", "kurz", "×÷×÷×÷", "ÀÉÎÕÜÿ"]
    docs = [(i, " ".join(r.choice(stems) + r.choice([",", ".", "-", "1", " ", "'"]) for _ in range(40))) for i in range(120)]
    docs += [(None, "garten " * 9), (1, None), (2, ""), (3, "1234 !!"), (4, "İstanbul istanbul " * 6), *docs[:3]]
    frame = spark.createDataFrame([(*d, "a", 1, 2) for d in docs], "doc_id long, text string, word string, n long, depth int")
    found = v.runs(frame)
    assert got(v.grouped(v.counted(found.select(v.misspelt(found, 7).alias("word")), 6, 5))) == plain(plain_words(docs, one_in=7))


def test_long_words_and_shared_prefixes(spark):
    long = "ab" * 6_000
    counts = {long: 30, long[:-1]: 6, long[:5000] + "x" + long[5000:]: 6, long[1:]: 5, "a" * 2000: 5, "a" * 2001: 25, "a" * 2002: 125}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(v.grouped(words)) == plain(counts)


def test_chains_of_forms(spark):
    counts = {"a" * (6 + i): 5 ** (i + 1) for i in range(12)}
    out = got(v.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == plain(counts) and {r[2] for r in out} == {"a" * 17}


def test_ties_go_to_the_smallest_word(spark):
    counts = {"zaaaaa": 5, "zaaaab": 50, "zaaaac": 50, "baaaaa": 50, "zaaaa": 50}
    out = {r[0]: r for r in got(v.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert out["zaaaaa"][1] == "baaaaa" and out["zaaaaa"][4] == 4 and out["zaaaab"][1] is None


def test_sql_and_empty_table(spark, tmp_path):
    r = random.Random(4)
    docs = [(i if i % 7 else None, " ".join("".join(r.choice("aBé") for _ in range(r.randint(5, 8))) for _ in range(60))) for i in range(90)]
    for name, rows in (("some", docs), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/{name}/documents.parquet/*.parquet'")
        sql = con.execute(v.OP11_SQL).fetchall()
        query = v.op11_spelling_variants(spark, f"{tmp_path}/{name}")
        assert query.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert got(query) == sorted(sql) and (name == "none") == (not sql)
        assert got(query) == plain(plain_words(rows))
