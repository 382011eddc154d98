import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from brute import jaccard_components, removed

from cellframe.llm import blocks, exact_dedup, jaccard_join, substring_dedup

SF = "/root/testdata/sf0.001"


def documents(spark, extra=()):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + list(extra)


def odd_documents():
    """Nulls, blanks, ties, repeated rows, one long text, near copies and shared passages."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(60)]
    base = [draw.choice(words) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One  two"), (6, "one two"), (6, "one two"), (7, "a" * 300), (8, "a" * 120), (9, "é" * 60), (10, "xé" * 60)]
    for k in range(40):
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = f"edit{draw.randrange(9)}"
        rows.append((20 + k, " ".join(copy[: draw.choice([120, 120, 115, 60])])))
    rows += [(70 + k, " ".join(draw.choices(words, k=draw.randint(1, 300)))) for k in range(20)]
    rows += [(95, " ".join(base)), (96, " ".join(base)), (97, " ".join(base).upper()), (98, " ".join(words * 400))]
    draw.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    """With columns whose names clash with those that the operators make."""
    schema = "doc_id long, text string, block long, n long, label string, owner int, item string, a string, n_chars long"
    return spark.createDataFrame([(d, t, 1, 2, "x", 3, "y", "z", len(t or "")) for d, t in rows], schema).repartition(parts)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join_equals_brute_force(spark, n, percent):
    rows = odd_documents() + [(d + 1000, t) for d, t in documents(spark)]
    found = jaccard_join.jaccard_components(frame(spark, rows), n, percent).collect()
    assert sorted(map(tuple, found)) == jaccard_components(rows, n, percent)


@pytest.mark.parametrize("length", [50, 8, 3])
def test_substrings_equal_brute_force(spark, length):
    rows = odd_documents() + ([(d + 1000, t) for d, t in documents(spark)[:120]] if length == 50 else [])
    found = substring_dedup.removed(frame(spark, rows), length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == removed(rows, length)


@pytest.mark.parametrize("limit", [1, 40, 5000])
def test_hot_owners_are_split(spark, limit):
    """A notice in every document and one string that many texts go on from; blocks of a few documents each."""
    draw = random.Random(limit)
    notice = "all rights reserved by the owner of this page, who may be asked for leave to print it in whole or in part"
    rows = [(d, " ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=draw.randint(0, 20))) + notice + str(d % 7) * draw.choice([3, 60])) for d in range(120)]
    rows += odd_documents() + [(None, notice), (None, notice), (3, notice), (200, "same sixteen byte" * 12)]
    spark.conf.set("cellframe.blockBytes", "600")
    try:
        found = substring_dedup.removed(frame(spark, rows), 50, limit=limit)
        found = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    finally:
        spark.conf.unset("cellframe.blockBytes")
    last = 1 << 62
    wanted = removed([(last if d is None else d, t) for d, t in rows], 50)
    assert sorted((last if r[0] is None else r[0], *r[1:]) for r in found) == wanted


def test_a_rack_sends_a_suffix_once():
    """However many blocks sent it; and who has a larger doc_id is settled in the rack."""
    text = "".join(random.Random(1).choices("abcdefgh", k=97)).encode()
    size = len(text).to_bytes(4, "little")
    sent = [(0, b, zstandard.compress(text, 1), zstandard.compress(size + (7 + b).to_bytes(8, "little"), 1)) for b in range(500)]
    table = pa.Table.from_batches([blocks.rows(blocks.SENT, list(zip(*sent)))])
    rack = substring_dedup._Rack(table, 50, 10)
    told = [(part, len(zstandard.decompress(about)) // 12) for part, _, about in rack.dealt()]
    assert sum(n for _, n in told) == 48
    none = pa.table({"part": [p for p, _ in told], "reply": [zlib.compress(np.packbits(np.zeros(n, bool))) for _, n in told]})
    assert [blocks.said(x, 48).all() for x in rack.answers(none)] == [False] + [True] * 499


def test_substrings_keep_columns(spark):
    docs = frame(spark, odd_documents())
    out = substring_dedup.drop_substrings(docs, 50)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[8] == "" and texts[1] is None and texts[7] == "a" * 300


@pytest.mark.parametrize("bytes_", [exact_dedup.FILTER_BYTES, 0])
def test_exact_duplicates(spark, bytes_, monkeypatch):
    """By the bitmap of suspects, and by the salted join; one text is a third of all rows."""
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", bytes_)
    rows = odd_documents()
    rows += [(1000 + i, "the same text") for i in range(len(rows) // 2)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    wanted = sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""])) for d, t in rows)
    found = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == wanted
    assert {r.doc_id: r.text_sha256 for r in found} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows}
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(ids) for ids in groups.values())


def test_empty_table(spark):
    docs = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert substring_dedup.removed(docs).count() == 0


def thue_morse(odd):
    """Letters of a cell varied in Thue-Morse order or its complement: sums of powers modulo 2**64 are equal."""
    return "".join("ab"[bin(i).count("1") % 2 ^ odd] + "qkzmwtx" for i in range(1024))


def test_texts_that_polynomial_hashes_confuse(spark):
    rows = [(1, thue_morse(0)), (2, thue_morse(1)), (3, "x " + thue_morse(0)), (4, "y " + thue_morse(1))]
    assert sorted(map(tuple, substring_dedup.removed(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == removed(rows, 50)
    assert sorted(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect())) == jaccard_components(rows, 3, 90)


def test_a_rack_reads_its_rows_in_any_order():
    draw = random.Random(2)
    sent = []
    for b in range(30):
        texts = list({"".join(draw.choices("ab", k=draw.randint(6, 9))).encode() for _ in range(5)})
        about = np.array(list(map(len, texts)), np.uint32).tobytes() + np.array([draw.randrange(40) for _ in texts], np.int64).tobytes()
        sent.append((0, b, zstandard.compress(b"".join(texts), 1), zstandard.compress(about, 1)))
    table = pa.Table.from_batches([blocks.rows(blocks.SENT, list(zip(*sent)))])
    other = table.take(draw.sample(range(30), 30))
    one, two = (substring_dedup._Rack(t, 6, 9) for t in (table, other))
    assert one.block == two.block == list(range(30)) and list(one.dealt()) == list(two.dealt())
