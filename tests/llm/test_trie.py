"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from cellframe.llm import prefix_trie


def brute_trie(rows, family=100, shared=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(w)] for c, w in own.items()}
    built = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + w[h:])
    nodes = {}
    for c, w in built.items():
        for d in range(len(w) + 1):
            nodes.setdefault(w[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in nodes)]
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p]
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, top string, at long").repartition(5)


@pytest.mark.parametrize("run", [prefix_trie.RUN, 3])
def test_trie_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    draw = random.Random(5)
    said = ["", "a", "bc", "ä€😀", "x" * 3000]
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(said)) for c in [*range(0, 8), *range(95, 108), 250, 251, 399, -3, -100, -101, -250] for t in range(draw.randrange(1, 9))]
    # A conversation with a third of all turns, copies of one conversation, odd turns, a family without its first.
    rows += [(3, t, "user", "long") for t in range(100, 177)]
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 530) for t in range(4)]
    rows += [(600, None, None, None), (600, None, "user", "b"), (600, None, "user", "a"), (600, 1, "user", None), (600, 1, "user", ""), (601, 5, None, "z"), (None, 1, "user", "nobody's"), (701, 1, "u", "v"), (702, 1, "u", "v"), (703, 1, "u", "v"), (704, 1, "u", "w"), (705, 1, "u", "w"), (706, 1, "u", "w")]
    assert any(zlib.crc32(str(c).encode()) % 6 > 0 for c in range(701, 707))  # some are left without turns
    found = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert found == brute_trie(rows)


def test_tries_without_turns(spark):
    assert prefix_trie.prefix_trie(frame(spark, [(1, 1, "a", "b")]).where("turn > 1")).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1)
    assert [tuple(r) for r in prefix_trie.prefix_trie(frame(spark, [(c, 1, "a", "b")])).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
