import hashlib
import random
import zlib

import numpy as np
import pytest
from test_dedup import frame, odd_documents

from cellframe.llm import bpe, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    draw = random.Random(3)
    out = ["", " ", "a<|endoftext|>b <|startoftext|>X<", "don't I'LL you've 's ' s", "ΣΑΣ ΟΔΟΣ İstanbul", "a\x1cb\x85c\xa0d", "é ́x", "日本語 한국어 🎉", "!!!!?????", "a" * 500, "½'S'Re ß"]
    for _ in range(300):
        out.append("".join(draw.choice("aeinrsthlo .,'") for _ in range(draw.randrange(1, 60))))
        out.append("".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(32, 600), draw.randrange(0x300, 0x3000)])) for _ in range(draw.randrange(1, 20))))
    return out


def test_bpe_equals_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5000, None), (5001, "the same"), (5001, "the same")]
    found = bpe.decode(bpe.encode(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    by = dict(rows)
    for r in found:
        ids = library.encode(by[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, np.uint32).tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    v = bpe.Vocabulary()
    e = bpe.Encoder(v)
    for s, i in list(e.ids.items())[:: 7]:
        if s.endswith("\xff"):
            assert e.word(s[:-1].encode("latin-1")) == [i]


def test_packing_places_every_id_once(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + odd_documents()[:20] + [(9000, "word " * 9000), (9001, None)]
    rows = list({d: (d, t) for d, t in rows}.values())
    found = packing.packed(frame(spark, rows), with_ids=True).collect()
    documents, sequences = {}, {}
    for r in found:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        documents.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], np.uint32).tobytes()
        pieces = sorted(documents[d])
        assert b"".join(p[1] for p in pieces) == ids and all(p[2] == len(ids) // 4 for p in pieces)
    for slots in sequences.values():
        slots.sort()
        assert [o for o, _ in slots] == np.cumsum([0, *(n for _, n in slots[:-1])]).tolist() and sum(n for _, n in slots) <= 4096
    used = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= used // 4096 + 2


def test_plan_meets_the_histogram_with_little_padding():
    draw = np.random.default_rng(5)
    histogram = np.bincount(np.minimum(4095, draw.gamma(1.2, 900, 20000).astype(int) + 1), minlength=4096)
    rows, repeats = packing.plan(histogram)
    met = np.zeros(4096, np.int64)
    np.add.at(met, rows[:, 1], repeats[rows[:, 0]])
    assert (met == histogram).all()
    assert 1 - (histogram @ np.arange(4096)) / (repeats.sum() * 4096) < 0.01


def test_least_squares_is_nonnegative_and_optimal():
    draw = np.random.default_rng(6)
    a, b = draw.random((12, 30)), draw.random(12)
    x = packing.nonnegative_least_squares(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_empty_table(spark):
    docs = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert packing.packed(docs).count() == 0 and bpe.decode(bpe.encode(docs)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
