"""What the dropping stages do with rows that share an id or a text, null ids, and clashing names."""

import pytest

from cellframe.llm import exact_dedup, jaccard_join, quality, substring_dedup

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(5, "dup"), (5, "unique text"), (9, "dup"), (5, LONG), (5, LONG), (6, LONG), (None, "no id"), (None, "no id"), (None, LONG + " more"), (7, None), (8, ""), (None, ""), (11, LONG.replace("word7 ", "other "))]
SCHEMA = "doc_id long, text string, _gone long, _text string, block long, row int, maybe boolean, slot long, bits string, source string, lang string, keep boolean, n_chars long"


def odd(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, i, "x", 1, 2, False, 3, "y", "s", None, True, 4) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("bytes_", [exact_dedup.FILTER_BYTES, 0])
def test_exact_duplicates_leave_one_row_of_each_text(spark, monkeypatch, bytes_):
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", bytes_)
    docs = odd(spark)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.schema.names == docs.schema.names
    assert pairs(out) == sorted([(9, "dup"), (5, "unique text"), (6, LONG), (None, "no id"), (None, LONG + " more"), (8, ""), (11, LONG.replace("word7 ", "other "))], key=str)
    by = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert len(by) == 11
    # Rows that stay are rows of the input, whole.
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_near_duplicates_leave_one_row_of_each_component(spark):
    docs = odd(spark)
    out = jaccard_join.drop_near_duplicates(docs)
    assert out.schema.names == docs.schema.names
    assert pairs(out) == sorted([(5, "dup"), (5, "unique text"), (5, LONG), (None, "no id"), (7, None), (8, ""), (None, "")], key=str)
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_rejection_is_by_row(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    good, bad = "An ordinary sentence, of words that differ.", "!!! $$$ ### !!! $$$"
    docs = odd(spark, [(i, good if i % 2 else bad) for i in range(20)] + [(1, bad), (2, good), (None, good), (None, bad)])
    out = quality.drop_rejected(docs, labels)
    assert out.schema.names == docs.schema.names
    assert pairs(out) == sorted([(i, good) for i in range(1, 20, 2)] + [(2, good), (None, good)], key=str)


def test_repeated_ids_and_clashing_names_in_substrings(spark):
    docs = odd(spark)
    out = substring_dedup.drop_substrings(docs)
    assert out.schema.names == docs.schema.names and out.count() == len(ROWS)


def test_empty_tables(spark):
    docs = odd(spark).where("doc_id < 0")
    for stage in (exact_dedup.drop_exact_duplicates, jaccard_join.drop_near_duplicates, substring_dedup.drop_substrings):
        out = stage(docs)
        assert out.schema.names == docs.schema.names and out.count() == 0
    assert quality.drop_rejected(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
