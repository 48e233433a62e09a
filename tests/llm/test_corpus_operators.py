"""Operators over the whole corpus, against brute force on small tables, cut into many chunks and shelves."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.llm import common, katz, licenses, near, packed, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_chunks(monkeypatch):
    whole = packed.layout
    for module in (katz, repeats):
        monkeypatch.setattr(module, "layout", lambda d, t: whole(d, t, 40_000))


# Helpers


def test_hashes_of_words():
    texts = [b"", b" ", b"a", b"A b  c\x0b\x1cx\xa0", None, b"x" * 1_200_000 + b" y z", b" ".join(b"w%d" % i for i in range(30_000))]
    hashes, counts = common.Hasher(lower=True).of_texts(texts)
    words = [w for t in texts for w in (t or b"").lower().split()]
    assert counts.tolist() == [len((t or b"").split()) for t in texts]
    by_word = dict(zip(words, hashes.tolist()))
    assert [by_word[w] for w in words] == hashes.tolist() and len(set(by_word.values())) == len(by_word)
    cased = common.Hasher(lower=False).words(b"A a")[0]
    assert cased[0] != cased[1]


@pytest.mark.parametrize("width", [1, 8, 40, 63, 64])
def test_places_equal_unique(width):
    draw = np.random.default_rng(width)
    for n in (0, 1, 2, 3, 100, 3000):
        x = draw.integers(0, min(2**width, 2**63) - 1, n, dtype=np.uint64, endpoint=True)
        if n > 10:
            x[::3], x[1::5] = x[0], x[0] ^ np.uint64(1)
        want, at = np.unique(x, return_inverse=True)
        got, places = common.places(x, width)
        assert (got == want).all() and (places == at).all() and (common.distinct(x) == want).all()


def test_packing():
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.array([2**64 - 1, 5, 0], np.uint64), np.arange(1000, dtype=np.uint64) * np.uint64(77)):
        assert (packed.unpack(packed.pack(values), len(values)) == values).all()
        ordered = np.sort(values)
        assert (packed.unpack_sorted(packed.pack_sorted(ordered), len(values)) == ordered).all()
    flags = np.array([True, False, True] * 7)
    assert (packed.unbits(packed.bits(flags), 21) == flags).all()


# Substring dedup


def brute_repeats(rows, least=13):
    first, words = {}, [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in words:
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            first[key] = min(first.get(key, math.inf), -math.inf if k is None else k)
    out = []
    for k, w in words:
        own, covered = -math.inf if k is None else k, set()
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] < own:
                covered.update(range(i, i + least))
        kept = b" ".join(x for i, x in enumerate(w) if i not in covered)
        out.append((k, len(w), len(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark, texts, many_chunks):
    got = sorted((tuple(r) for r in repeats.query(spark, SF).collect()), key=str)
    want = brute_repeats(texts.items())
    assert got == want and sum(r[2] for r in want) > 0


def test_repeats_at_all_offsets(spark, many_chunks):
    shared = [f"s{i}" for i in range(20)]
    rows = []
    for k in range(60):  # runs of 12, 13 and 14 shared words after k other words, also twice in one text
        rows.append((k, " ".join([f"a{k}.{i}" for i in range(k)] + shared[k % 4 : k % 4 + 12 + k % 3] + [f"b{k}"] + (shared[:13] if k % 7 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (13, 12, 2):
        got = repeats.remove_repeats(docs, least=least).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, least)


def test_repeats_special_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = repeats.remove_repeats(odd).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)
    assert repeats.remove_repeats(empty).collect() == []


# Katz model


def katz_model(rows):
    tokens = {k: [None, *(t or "").encode().lower().split(), ""] for k, t, _ in rows}
    one, two = Counter(), Counter()
    for k, _, train in rows:
        if train:
            one.update(tokens[k][1:])
            two.update(zip(tokens[k], tokens[k][1:]))
    t1, t2 = (katz.totals(np.array([*c.values()], np.int64)) for c in (one, two))
    p = dict(zip(one, katz.words(np.array([*one.values()], np.int64), t1)))
    unknown, d, after = float(katz.words(np.array([0]), t1)[0]), katz.discounts(t2), defaultdict(dict)
    for (h, w), n in two.items():
        after[h][w] = n

    def of(h, w):
        if h not in after:
            return p.get(w, unknown)
        total, kept = sum(after[h].values()), sum(n * (d[n] if n <= katz.REACH else 1) for n in after[h].values())
        total += kept >= total * (1 - 1e-12)
        if w in after[h]:
            n = after[h][w]
            return n * (d[n] if n <= katz.REACH else 1) / total
        return (total - kept) / total / (1 - sum(p[x] for x in after[h])) * p.get(w, unknown)

    return tokens, one, p, unknown, after, of


def test_katz_equals_brute_force_and_normalises(spark, texts, many_chunks):
    import zlib

    rows = [(k, t, zlib.crc32(str(k).encode()) % 7 != 2) for k, t in texts.items()]
    tokens, one, p, unknown, after, of = katz_model(rows)
    for h in [None, b"the", *list(after)[:40], b"never seen"]:
        assert abs(sum(of(h, w) for w in p) + of(h, b"never seen") - 1) < 1e-9
    total, kinds = sum(one.values()), len(one)
    got = {r["doc_id"]: r for r in katz.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, _, train in rows:
        w = tokens[k]
        want = (k, not train, len(w) - 1, sum(x in one for x in w[1:]), total, sum(math.log10((one[x] + 1) / (total + kinds + 1)) for x in w[1:]), sum(math.log10(of(h, x)) for h, x in zip(w, w[1:])))
        assert all(a == b or abs(a - b) < 1e-9 * abs(b) for a, b in zip(got[k], want))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_katz_hot_words_use_many_shelves(spark, many_chunks):
    rows = [(k, " ".join(f"the x{(k * i) % 50} the" for i in range(300)), k % 5 > 0) for k in range(60)]
    tokens, _, _, _, _, of = katz_model(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for r in katz.score(docs, F.col("train")).collect():
        w = tokens[r["doc_id"]]
        want = sum(math.log10(of(h, x)) for h, x in zip(w, w[1:]))
        assert abs(r["score"] - want) < 1e-9 * abs(want)


def test_good_turing_discounts():
    n = np.array([100, 40, 20, 12, 8, 6])
    d = katz.discounts(np.array([0, 0, *n]))
    common = 6 * 6 / 100
    for r in range(1, 6):
        assert abs(d[r] - ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)) < 1e-12
    assert katz.discounts(np.zeros(katz.TOTALS, np.int64))[1:].tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_katz_special_rows(odd, empty):
    got = katz.score(odd, F.col("doc_id") != 7).collect()
    assert len(got) == odd.count() and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert katz.score(empty, F.lit(True)).collect() == []
    untrained = katz.score(odd, F.lit(False)).collect()
    assert {(r["train_tokens"], r["score"]) for r in untrained} == {(0, 0.0)}


# Near duplicates


def sets_of(rows, size):
    out = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_components(sets):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates_equal_brute_force(spark, texts):
    sets = sets_of(texts.items(), 2)
    want = brute_components(sets)
    got = {r["doc_id"]: r for r in near.query(spark, SF).collect()}
    assert {k: (len(sets[k]), want[k], want[k] == k) for k in sets} == {k: tuple(r)[1:] for k, r in got.items()}
    assert len(set(want.values())) < len(want)


def chain(draw, n, words):
    """Copies of one text with a few changed words each: many pairs lie around the threshold."""
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        for at in draw.choice(words, draw.integers(0, 7), replace=False):
            w[at] = f"n{k}.{at}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [near.BLOCK, 16])
def test_dense_groups_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BUCKET", block)
    monkeypatch.setattr(near, "SLOT", 7)
    draw = np.random.default_rng(7)
    rows = [(k + 1000 * g, t) for g in range(3) for k, t in chain(draw, 60, 40 + 20 * g)]
    rows += [(5000 + i, " ".join(f"u{i}.{j}" for j in range(i))) for i in range(9)]
    want = brute_components(sets_of(rows, 2))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_second_round_finds_what_the_first_text_hides(spark):
    """a is first in every bucket, but only b and c are linked."""
    shared = [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(shared + [f"a{i}" for i in range(25)])), (2, " ".join(shared + [f"b{i}" for i in range(25)])), (3, " ".join(shared + [f"b{i}" for i in range(24)]))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 2}


def test_registers_and_estimate():
    draw = np.random.default_rng(2)
    both, a, b = (draw.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = near.registers([np.concatenate([both, a]), np.concatenate([both, b])])
    assert abs(near.estimate(np.array([(x == y).mean()]))[0] - 0.8) < 0.12
    value = (np.array([3], np.uint64) * near.permutations()).tolist()
    want = [(64 - v.bit_length()) << 10 | (v >> max(0, v.bit_length() - 11)) & 1023 for v in value]
    got = near.registers([np.array([3], np.uint64)])[0].tolist()
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.98  # rounding to a float may carry at a power of two


def test_near_special_rows(odd, empty):
    got = sorted((tuple(r) for r in near.near_duplicates(odd, size=2).collect()), key=str)
    assert len(got) == odd.count()
    assert {(r[2], r[3]) for r in got if r[0] in (1, 6)} == {(1, True), (1, False)} and all(r[3] for r in got if r[0] is None)
    assert {r[1:] for r in got if r[0] in (2, 3, 4)} == {(0, 2, True), (0, 3, True), (0, 4, True)}
    assert near.near_duplicates(empty).collect() == []
    left = near.one_of_each(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1


# Licenses


def brute_cosines(rows, wordings=licenses.TEMPLATES, least=licenses.LEAST):
    """The best (license, cosine) of each file by plain TF-IDF over its units and all runs of consecutive units; every term has its own document frequency."""
    import re

    def words(t):
        return Counter(w for w in re.split(licenses.TERM_ENDS, t.lower()) if w)

    held = Counter()
    for _, t in rows:
        held.update(set(words(t or "")))
    weigh = {w: math.log((1 + len(rows)) / (1 + held[w])) + 1 for w in set(held).union(*(words(t) for ts in wordings.values() for t in ts))}

    def norm(c):
        return math.sqrt(sum((n * weigh[w]) ** 2 for w, n in c.items()))

    sides = [(name, words(t)) for name, ts in wordings.items() for t in ts]
    sides = [(name, c, norm(c)) for name, c in sides]
    longest, theirs = max(sum(c.values()) for _, c, _ in sides), set().union(*(c for _, c, _ in sides))
    out = {}
    for k, t in rows:
        units = [c for c in map(words, re.split(licenses.UNIT_ENDS, t or "")) if c]
        for i in range(len(units)):
            run, inner = Counter(), 0
            for j in range(i, len(units)):
                inner += sum(units[j - 1].values()) if j > i + 1 else 0
                if inner > longest:  # a wording's inner lines have no more terms than it
                    break
                run = run + units[j]
                if theirs & run.keys():
                    for name, c, length in sides:
                        cos = round(sum(n * weigh[w] ** 2 * run[w] for w, n in c.items()) / norm(run) / length, 9)
                        if cos >= least:
                            out[k] = min(out.get(k, (0, "")), (-cos, name))
    return {k: (name, -minus) for k, (minus, name) in out.items()}


def same_licenses(spark, rows, least=licenses.LEAST, path_type="long"):
    docs = spark.createDataFrame(rows, f"path {path_type}, text string")
    got = {r["path"]: (r["license"], r["cosine"]) for r in licenses.own_licenses(docs, least=least).collect()}
    want = brute_cosines(rows, least=least)
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    return got


NOTICES = ["Licensed under the Apache License", "Licensed by the MIT under version 3", "GNU Lesser General Public License, version 3.0 or later", "# SPDX: Released under the MIT License. Next.", "Licensed under CC BY",
           "This is licensed\nunder the Apache License, Version 2.0,\nby us", "the terms of the GNU General Public License as published", "Source Code Form subject to the Mozilla Public License v. 2.0 today"]


def test_licenses_equal_brute_force(spark, texts):
    rows = [*texts.items(), *((100_000 + i, t) for i, t in enumerate(NOTICES))]
    assert any(k in texts for k in same_licenses(spark, rows))


@pytest.mark.parametrize("size", [20, 205, 1500])
def test_notices_near_the_threshold_at_three_sizes(spark, size):
    """Notices with more and more other words, so that cosines lie on both sides of the threshold, beside files of ordinary text."""
    common = "it was a day and this is the project of our code and all that license text here by version".split()
    beside = ["", " here", " it was", " of our project", " by all that code of this day", " zebra", " unheard zebra words"]
    cut = [n.split() for n in NOTICES + [ts[0] for ts in licenses.TEMPLATES.values()]]
    rows = list(enumerate(" ".join(w[: len(w) - drop]) + b for w in cut for drop in (0, 1, 2) for b in beside))
    rows += [(10_000 + i, " ".join(common[(i * j) % len(common)] for j in range(1, 8))) for i in range(size)]
    got = same_licenses(spark, rows)
    near = [c for _, c in got.values() if c <= 0.78]
    assert len(near) > 5 and len(got) < len(rows) - size
    lower = same_licenses(spark, rows, least=0.6)
    assert {k: v for k, v in lower.items() if v[1] >= licenses.LEAST} == got  # one threshold never contradicts another


def test_joins_without_broadcasts(spark, texts, monkeypatch):
    rows = [*list(texts.items())[:40], *((100_000 + i, t) for i, t in enumerate(NOTICES))]
    want = same_licenses(spark, rows)
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", 0)
    assert same_licenses(spark, rows) == want


@pytest.mark.parametrize("times", [1, 40])
def test_notices_inside_sentences_at_two_sizes(spark, times):
    notices = ["It was released under the MIT License.", "This project is released under the MIT License.", "Our code is licensed under CC BY 4.0.", "All of it is licensed under the Apache License, Version 2.0, as it was before.",
               "It was, it was, it was and it was released here under the old License."]
    common = ["it was a day and this is the project", "it was here, is it", "all of it was as it was before", "our code is here"] * 5
    rows = list(enumerate(notices + common * times))
    assert {0, 1, 2, 3} <= same_licenses(spark, rows).keys()


@pytest.mark.parametrize("columns,mark", [(66, "# "), (60, " * "), (55, "// "), (40, ""), (18, "; "), (1, "")])
def test_wrapped_notices(spark, columns, mark):
    import textwrap

    def header(notice):
        return "\n".join(["#!/bin/sh", mark.strip(), *(mark + line for line in textwrap.wrap(notice, columns, break_long_words=False)), mark.strip(), "import os and run it"])

    rows = [(f"{name} {i}", header(notice)) for name, ts in licenses.TEMPLATES.items() for i, notice in enumerate(ts)]
    rows += [(f"none {i}", "import os and run it\nwith use of the source\nfor this and that") for i in range(60)]
    got = {r["path"]: r for r in licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: r["license"] for k, r in got.items()} == {k: k.split()[0] for k, _ in rows if not k.startswith("none")}
    assert all(r["share"] <= 1 and r["share"] < len(t) / (len(t) + 1) for r, t in ((got[k], t) for k, t in rows if k in got))


def test_whole_license_files(spark):
    wholes = {name: ts[0] for name, ts in licenses.whole_templates().items()}
    assert wholes.keys() >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "ISC", "Unlicense", "Apache-2.0"}
    rows = [(f"{name}/LICENSE", "Copyright (c) 2020 Some Body\n\n" + text) for name, text in wholes.items()]
    rows += [(f"{name}/code.py", "import os") for name in wholes] + [("Other/LICENSE", "All rights are ours alone."), ("Other/ISC.py", "x = 1")]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in wholes:
        assert got[f"{name}/LICENSE"] == (name, "own") and got[f"{name}/code.py"] == (name, "inherited")
    assert got["Other/LICENSE"] == got["Other/ISC.py"] == (None, None)


def test_license_query_finds_notices(spark, texts):
    got = {r["doc_id"]: r["license"] for r in licenses.query(spark, SF).collect()}
    assert got.keys() == texts.keys()
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for k, t in texts.items():
        held = {n for line, n in notices.items() if line in (t or "")}
        assert got[k] in held if held else got[k] is None


def test_license_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("LICENSE", mit), ("a/b/x.py", "code"), ("a/COPYING", gpl), ("a/b/c/y.py", "z"), ("z.py", None), ("a/b/own.py", "Licensed under the Apache License, Version 2.0.\nfoo bar and more"), (None, "q"), ("ab/x", "w"), ("a/COPYING", gpl)]
    docs = spark.createDataFrame(files, "path string, text string")
    got = sorted(((r["path"], r["license"], r["origin"], r["directory"]) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([
        ("LICENSE", "MIT", "own", None), ("a/b/x.py", "GPL-3.0", "inherited", "a"), ("a/COPYING", "GPL-3.0", "own", None), ("a/COPYING", "GPL-3.0", "own", None),
        ("a/b/c/y.py", "GPL-3.0", "inherited", "a"), ("z.py", "MIT", "inherited", ""), ("a/b/own.py", "Apache-2.0", "own", None), (None, None, None, None), ("ab/x", "MIT", "inherited", ""),
    ], key=str)
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_license_special_rows(odd, empty):
    assert len(licenses.scan(odd, "doc_id", "source").collect()) == odd.count()
    assert licenses.scan(empty, "doc_id", "source").collect() == []
