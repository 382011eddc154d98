import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_dedup import frame, odd_documents

from cellframe.llm import bit_sliced, language_id, license_scan, lm_scoring, quality

SF = "/root/testdata/sf0.01"


def plain_words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("order,least,part", [(3, 1, 3 << 20), (2, 2, 3 << 20), (3, 1, 300), (2, 2, 1)])
def test_backoff_equals_brute_force(spark, order, least, part):
    """The small parts put several of them into a block, with n-grams in common, and documents that fill one or more."""
    rows = odd_documents()
    texts = [plain_words(t) for _, t in rows]
    counts = Counter(tuple(w[i : i + o]) for w in texts for o in range(order + 1) for i in range(len(w) - o + (o > 0)))
    wanted = []
    for (d, _), w in zip(rows, texts):
        total = 0.0
        own = Counter(tuple(w[i : i + o]) for o in range(order + 1) for i in range(len(w) - o + (o > 0)))
        for j in range(len(w)):
            lost = 0
            for o in range(order, 0, -1):
                if j - o + 1 < 0:
                    continue
                gram = tuple(w[j - o + 1 : j + 1])
                count = counts[gram] - own[gram] if o > 1 else max(1, counts[gram] - own[gram])
                if count >= (least if o > 1 else 1):
                    total += math.log10(count / max(1, counts[gram[:-1]] - own[gram[:-1]])) + lost * math.log10(0.4)
                    break
                lost += 1
        wanted.append((d, len(w), total))
    spark.conf.set("cellframe.blockBytes", str(part))
    try:
        found = sorted((r.doc_id, r.n_tokens, r.log10_sum) for r in lm_scoring.scores(frame(spark, rows), order, 0.4, least).collect())
    finally:
        spark.conf.unset("cellframe.blockBytes")
    for a, b in zip(found, sorted(wanted), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


def brute_top(rows, k, every):
    ok = [(n, i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for m, i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, j, v in ok if n != m and len(v) == len(q))[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale,limit", [(1.0, 1 << 26), (1e-3, 0), (2e5, 100), (6e5, 1 << 26), (1e12, 0), (5e15, 1 << 26)])
def test_top_k_equals_brute_force(spark, scale, limit, monkeypatch):
    """The last scale's scores do not fit a long."""
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bit_sliced, "BROADCAST_BYTES", limit)
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, scale) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, None] * 8), (402, [math.inf] * 16), (403, [math.nan] * 16), (500, [0.0] * 16), (600, [1.0, 2.0]), (605, [3.0, 4.0]), (700, []), (40, rows[40][1]), (40, rows[41][1]), (600, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, block long, ids string").repartition(4)
    found = sorted(map(tuple, bit_sliced.top_k(docs, every=20, k=10).collect()))
    assert found == brute_top(rows, 10, 20)


def test_top_k_of_large_numbers(spark):
    rows = [(0, [1 / 1024, 2.0]), (1, [5e15, 0.0]), (2, [3.0, 0.0]), (3, [1e308, 1e-5]), (4, [-1e308, 7.0]), (20, [1e306, -1e300])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found = sorted(map(tuple, bit_sliced.top_k(docs, every=20, k=10).collect()))
    assert found == brute_top(rows, 10, 20)
    assert [r[2] for r in found if r[0] == 0] == [3, 20, 1, 2, 4]
    assert bit_sliced.top_k(docs.where("vec_id < 0")).count() == 0
    keys = [-(10**40), -257, -256, -255, -1, 0, 1, 255, 256, 10**40]
    assert sorted(keys, key=bit_sliced.sort_key) == keys


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, model).join(docs.where(language_id.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    en, de = (next(r.text for r in docs.where(f"lang = '{k}' and length(text) between 800 and 2000").collect()) for k in ("en", "de"))
    mixed = spark.createDataFrame([(1, en + "\n" + de), (2, None), (3, "123 !!"), (4, "…")], "doc_id long, text string")
    by = {r.doc_id: r for r in language_id.identify(mixed, model).collect()}
    assert {s.lang for s in by[1].spans} == {"en", "de"} and len(by[1].spans) <= 4
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[2].score == 0
    assert language_id.identify(mixed.where("doc_id < 0"), model).count() == 0


def test_viterbi_equals_brute_force():
    draw = np.random.default_rng(2)
    scores, by_doc = draw.normal(0, 3, (60, 3)).astype(np.float32), np.array([0, 0, 17, 17, 18, 60])
    found = language_id.viterbi(scores, by_doc, 2.5)
    for a, b in zip(by_doc[:-1], by_doc[1:]):
        if a == b:
            continue
        value, back = scores[a].astype(float), []
        for s in scores[a + 1 : b]:
            step = value[None, :] - 2.5 * (1 - np.eye(3))
            back.append(step.argmax(1))
            value = step.max(1) + s
        path = [int(value.argmax())]
        for p in reversed(back):
            path.append(int(p[path[-1]]))
        assert path[::-1] == found[a:b].tolist()


def test_word_scores_equal_brute_force():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 50, (3, language_id.TRIGRAMS + language_id.SCRIPTS)).astype(float)
    counts[:, language_id.TRIGRAMS :] = 0
    counts[0, language_id.TRIGRAMS], counts[1, language_id.TRIGRAMS], counts[1, language_id.TRIGRAMS + 1], counts[2, language_id.TRIGRAMS + 13] = 100, 90, 10, 5
    model = language_id.Model(["a", "b", "c"], counts)
    texts = ["Hello wörld 12x", "", "Ελλάδα x", "漢字 𠀀𠀁 d\u2019e", None]
    words = language_id.Words(texts)
    found, at = model.scores(words), 0
    logs = np.log((counts[:, : language_id.TRIGRAMS] + 0.5) / (counts[:, : language_id.TRIGRAMS] + 0.5).sum(1, keepdims=True))
    for t in texts:
        data = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in (t or "").lower().encode())
        for w in data.split():
            script = max([next(s for first, s in reversed(language_id.SCRIPT_RANGES) if ord(c) >= first) for c in w.decode() if ord(c) > 127], default=0)
            padded = b" " + w + b" "
            for k in range(3):
                total = sum(logs[k, (int.from_bytes(padded[i : i + 3], "big") * 2654435761 % 2**32) >> 17] for i in range(len(w)))
                allowed = {0: (0, 1), 1: (1,), 13: (2,)}.get(script, (0, 1, 2))
                assert abs(found[at, k] - total + (0 if k in allowed else 1000)) < 1e-2
            at += 1
    assert at == len(found)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "the cat sat" if i % 2 else "die Katze sitzt", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, "doc_id", "text", "lang")
    rows = [(1, "\U00020000\U00020001"), (2, "the cat"), (2, "the cat"), (None, "die Katze"), (3, "the cat \U00020000"), (4, "x" * 3_000_000)]
    found = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(frame(spark, rows), model).collect()), key=str)
    assert found[0] == (1, "de", 0.0) and found[1] == found[2] == (2, "en", 1.0) and found[3] == (3, "en", 1.0) and found[4][0] == 4 and found[5] == (None, "de", 1.0)


def test_posteriors_equal_brute_force(spark):
    """Many sparse sites: shrinkage by the moments of the corpus, level by level."""
    draw = random.Random(8)
    good, bad = "An ordinary sentence, of words that differ and go on.", "!!! $$$ ### !!! $$$ AAA BBB"
    rows = [(i, draw.choice([good, good, bad]) + " w" * draw.randrange(6), f"h{int(draw.paretovariate(0.6)) % 50}", draw.choice(["p", "q", None]), 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep int").repartition(3)
    labels = spark.createDataFrame([(i, int(t.startswith("An"))) for i, t, *_ in rows if i % 3], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    p = {i: found[i].p_document for i, *_ in rows}
    site = {i: (h, q or "") for i, _, h, q, _ in rows}

    def strength(groups, near):
        n = sum(map(len, groups.values()))
        between = sum(len(v) * (np.mean(v) - near[k]) ** 2 for k, v in groups.items())
        within = sum(near[k] * (1 - near[k]) for k in groups)
        spread = sum(len(v) * near[k] * (1 - near[k]) for k, v in groups.items()) / n
        excess = (between - within) / n
        return min(1e6, max(2.0, spread / excess - 1)) if excess > 0 else 1e6

    def grouped(key):
        out = {}
        for i in p:
            out.setdefault(key(site[i]), []).append(p[i])
        return out

    mean = np.mean(list(p.values()))
    hosts, paths = grouped(lambda s: s[0]), grouped(lambda s: s)
    k = strength(hosts, dict.fromkeys(hosts, mean))
    at_host = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    k = strength(paths, {s: at_host[s[0]] for s in paths})
    for i, r in found.items():
        own = paths[site[i]]
        near = min(0.999, max(0.001, (k * at_host[site[i][0]] + sum(own) - p[i]) / (k + len(own) - 1)))
        odds = sum(s * math.log(x / (1 - x)) for s, x in ((1, p[i]), (1, near), (-1, mean)))
        assert abs(r.p_host - at_host[site[i][0]]) < 1e-9 and abs(r.p_path - near) < 1e-9 and abs(r.quality - 1 / (1 + math.exp(-odds))) < 1e-9 and r.keep == (r.quality >= 0.5)


def test_quality_tells_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = quality.classify(docs, train)
    assert found.count() == docs.count()
    rows = found.drop("quality").join(test, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.985
    assert np.mean([not r.keep for r in rows if r.quality == 0]) > 0.9


def test_quality_odd_rows(spark):
    rows = odd_documents()
    docs = spark.createDataFrame([(d, t, None if d % 3 else "h", "p", 1.0, 2) for d, t in rows], "doc_id long, text string, source string, lang string, x double, n int")
    labels = spark.createDataFrame([(1, 0), (20, 1), (21, 1), (3, 0), (None, 1), (70, None)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert sorted(r.doc_id for r in out) == sorted(d for d, _ in rows)
    assert all(r.keep for r in quality.classify(docs, labels.where("quality = 1")).collect())
    assert quality.classify(docs.where("doc_id < 0"), labels).count() == 0
    assert quality.drop_rejected(docs, labels).columns == docs.columns


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"][2].replace("this software", "this program").replace(" and to permit", "\nand to permit")
    rows = [(1, None), (2, "no such words"), (3, "text\nLicensed under CC BY-NC 4.0.\nmore text here"), (4, "Copyright 2020 A\n\n" + mit), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "the license plate was red"), (6, "x " * 30000 + "\nReleased under the MIT License.")]
    by = {}
    for r in license_scan.scan(frame(spark, rows)).collect():
        by.setdefault(r.doc_id, []).append(r.license)
    assert by[1] == [None] and by[2] == [None] and by[3] == ["CC-BY-NC-4.0"] and by[4] == ["MIT"] and by[5] == ["GPL-3.0"] and sorted(by[6], key=str) == ["MIT", None]
    assert license_scan.differences(["a", "b", "c"], ["x", "a", "c", "y"]) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    notices = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    wanted = {(d.doc_id, k) for d in docs.collect() for k, s in notices.items() if s in d.text}
    assert {(r.doc_id, k) for r in license_scan.scan(docs).collect() for k in r.licenses} == wanted


def test_licenses_within_a_long_line(spark):
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 5000").limit(8).collect() for w in r.text.split() if license_scan.words(w) and license_scan._CODES.get(license_scan.words(w)[0]) is None]
    rows, wanted = [], {}
    for size in (800, 4000, 17000):
        for name, texts in license_scan.TEMPLATES.items():
            for notice in texts:
                filler = (words * (1 + size // len(words)))[:size]
                rows.append((len(rows), " ".join([*filler[: size // 2], notice, *filler[size // 2 :]])))
                wanted[rows[-1][0]] = name
    # A wrapped notice, and much text without a blank line after it.
    rows.append((len(rows), license_scan.TEMPLATES["MIT"][2].replace(" and to permit", "\nand to permit") + "\n" + "\n".join(words[i % len(words)] for i in range(17000))))
    wanted[rows[-1][0]] = "MIT"
    assert {r.doc_id: r.license for r in license_scan.scan(frame(spark, rows)).collect()} == wanted


def brute_matches(text):
    """Every match by the plain edit distance of all templates at all words; then the best that do not overlap."""
    spans = [m.span() for m in license_scan._WORD.finditer(text)]
    w = [text[a:b].lower() for a, b in spans]
    found = []
    for i, own in enumerate(license_scan._TEMPLATE_WORDS):
        for start in range(len(w)):
            # By number of words read from start: least changes of the whole template.
            row = list(range(len(own) + 1))
            for end in range(start + 1, min(len(w), start + 2 * len(own)) + 1):
                now = [row[0] + 1]
                for j, x in enumerate(own, 1):
                    now.append(min(row[j - 1] + (x != w[end - 1]), row[j] + 1, now[-1] + 1))
                row = now
                if row[-1] <= 0.15 * len(own):
                    found.append((row[-1] / len(own), license_scan._NAMES[i], start, end))
    return found


def test_license_matches_equal_brute_force():
    draw = random.Random(5)
    t = license_scan.TEMPLATES
    scanner = license_scan.Scanner()
    for _ in range(12):
        parts = [draw.choice(draw.choice(list(t.values()))).split() for _ in range(2)]
        for p in parts:
            for _ in range(draw.randrange(4)):
                p[draw.randrange(len(p))] = draw.choice(["x", "the license", ""])
        text = " ".join(w for p in parts for w in ["some", "words", "under", *p, "of", "this"])
        every = brute_matches(text)
        found = scanner.matches(text)
        # The best share is found, and whatever is not found overlaps a match that is no worse.
        assert bool(found) == bool(every)
        for share, _, a, b in every:
            assert any(n / m <= share + 1e-12 and start < b and a < end for _, _, n, m, start, end in found)
        for name, _, n, m, a, b in found:
            assert any(k == name and x == a and y == b and abs(s - n / m) < 1e-12 for s, k, x, y in every)


def test_short_notices_and_tags(spark):
    rows = [(1, "SPDX-License-Identifier: MIT"), (2, "Licensed under the terms of the MIT license"), (3, "released under GPL v3"), (4, "// spdx-license-identifier: GPL-2.0-or-later"), (5, "the mit campus, under licence plates"), (6, "See LICENSE."), (7, "")]
    by = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [by[i].license for i in range(1, 8)] == ["MIT", "MIT", "GPL-3.0", "GPL-2.0", None, None, None]
    assert [by[i].n_blocks for i in (1, 6)] == [1, 0] and license_scan.scan(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_several_licenses_of_a_block(spark):
    t = license_scan.TEMPLATES
    wrapped = t["GPL-3.0"][1].replace("of the GNU ", "of the GNU\n# ").replace("Software Foundation, ", "Software Foundation,\n# ")
    rows = [(1, "Released under the MIT License. Licensed under CC BY 4.0."), (2, "x\n" + " ".join(x for v in t.values() for x in v) + "\ny"), (3, wrapped), (4, "Released under the MIT License.\nand " + t["MPL-2.0"][0]), (5, t["GPL-2.0"][0] + " " + t["LGPL-3.0"][0])]
    by = {r.doc_id: r.licenses for r in license_scan.scan(frame(spark, rows)).collect()}
    assert by == {1: ["CC-BY-4.0", "MIT"], 2: sorted(t), 3: ["GPL-3.0"], 4: ["MIT", "MPL-2.0"], 5: ["GPL-2.0", "LGPL-3.0"]}
    found = license_scan.Scanner().matches(rows[0][1])
    assert sorted((m[0], m[4], m[5]) for m in found) == [("CC-BY-4.0", 5, 10), ("MIT", 0, 5)]


def test_labels_heads_and_mentions(spark):
    found = {
        "license: MIT": "MIT",
        "Lizenz: MIT License": "MIT",
        'license = "Apache-2.0"': "Apache-2.0",
        "MIT License\n\nCopyright (c) 2020 A": "MIT",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0",
        "it is distributed under the terms of the GNU GPL v2": "GPL-2.0",
        "We discuss whether code under GPL v2 is free": None,
        "eine Lizenz mit Auflagen": None,
        "the license MIT gave": None,
        "the MIT License is short": None,
        "x" * 5000 + " Released under the MIT License": "MIT",
        "nonlicensed under cc by 4.0": None,
    }
    rows = list(enumerate(found))
    got = {r.doc_id: r.license for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {t: got[i] for i, t in rows} == found


def test_ranking_spares_confirmations_and_changes_nothing(monkeypatch):
    t = [x for v in license_scan.TEMPLATES.values() for x in v] + list(license_scan.HEADS.values())
    draw = random.Random(11)
    texts = [" ".join(draw.choice(t) if draw.random() < 0.7 else "other words" for _ in range(6)) for _ in range(60)]
    some = license_scan.Scanner()
    found = [some.matches(x) for x in texts]
    windows = sum(len(w) for x in texts for _, _, w in license_scan.candidates(license_scan.coded(x)))
    monkeypatch.setattr(license_scan, "_room", lambda taken, size: True)
    every = license_scan.Scanner()
    assert found == [every.matches(x) for x in texts]
    assert every.confirmed == windows > some.confirmed


def test_anchors_stand_in_every_match():
    """Whatever words of a template may differ, one of its anchors is left."""
    draw = random.Random(3)
    for i, (own, most) in enumerate(zip(license_scan._TEMPLATE_WORDS, license_scan._MOST)):
        for _ in range(3):
            gone = set(draw.sample(range(len(own)), most))
            text = " ".join("zzz" if j in gone else w for j, w in enumerate(own))
            assert license_scan.has_anchor(text), text
            codes = license_scan.coded(text)
            assert any(w[2] == i for _, _, ws in license_scan.candidates(codes) for w in ws) or license_scan.words(text) != text.split()
