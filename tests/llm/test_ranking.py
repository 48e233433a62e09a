"""Ranked lexical search against a restatement of its formula and against its SQL twin."""

import math
from collections import Counter

import numpy as np
from compare import check
from conftest import SF

from fleetlake.llm import catalog, ranking
from fleetlake.llm.ranking import Ranker, bounds, grouped, terms


def brute(docs, items, top=ranking.TOP):
    """(item, rank, key, score) rows by the formula; docs are (key, text) rows, items (key, text) rows."""
    counts = [(k, Counter(ranking.TERM.findall((t or "").translate(ranking.LOWER)))) for k, t in docs]
    counts = [(k, c, sum(c.values())) for k, c in counts if c]
    total, df = sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for k, c, n in counts:
            m = 50 + 50 * n * len(counts) // total
            s = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0 and k is not None:
                scored.append((-s, k))
        out += [(i, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ranking_equals_sql_twin(spark, duckdb_tables):
    assert check(spark, duckdb_tables, SF, "op11_ranking", catalog.QUERIES["op11_ranking"], catalog.ORACLE["op11_ranking"]) == ""


def test_ranking_of_odd_rows(spark, odd, monkeypatch):
    items = [(1, "The LAZY dog, été!"), (2, None), (3, ""), (None, "fox"), (4, "word1 word2 word976 x"), (4, "fox"), (5, "中文 unheard"), (6, "!!! ...")]
    bench = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, doc_id string")
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert rows(ranking.ranked(odd, bench)) == want and {r[0] for r in want} == {1, 4, 5}
    monkeypatch.setattr(ranking, "ITEM_BYTES", 16)  # several passes
    assert rows(ranking.ranked(odd, bench)) == want
    assert rows(ranking.ranked(odd, bench, top=1)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], items, 1)


def test_ranking_of_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    for docs, items in ((empty, bench), (odd, bench.limit(0)), (odd.where("text is null"), bench)):
        found = ranking.ranked(docs, items)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "doc_id string, text string")
    found = ranking.ranked(docs, spark.createDataFrame([("q", "one two")], "item_id string, text string"))
    assert [(r["rank"], r["doc_id"]) for r in found.sort("rank").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_copies_beyond_the_last_place(spark):
    """A third of all rows is one text; equal scores rank by key and none is lost at the last place."""
    docs = [(i, "alpha beta gamma") for i in range(400, 0, -1)] + [(1000 + i, f"alpha w{i} beta{' gamma' * (i % 5)}") for i in range(800)]
    items = [(1, "alpha beta gamma"), (2, "beta w7")]
    found = ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == brute(docs, items)


def test_masks_of_many_terms():
    rng = np.random.default_rng(3)
    masks, largest = rng.integers(0, 1 << 63, (500, 3), dtype=np.uint64), rng.integers(0, 1 << 40, 150)
    groups, member = grouped(masks)
    assert (groups[member] == masks).all()
    want = [sum(int(v) for j, v in enumerate(largest) if int(m[j // 64]) >> j % 64 & 1) for m in masks]
    assert bounds(masks, largest).tolist() == want


def test_search_stops_early_and_keeps_the_right_rows():
    """Most masks lie below the bound, and what was found in one block spares work in the next."""
    rng = np.random.default_rng(5)
    terms_, docs = 70, 20_000
    weights = np.sort(rng.integers(1, 9000, terms_))
    held = rng.random((docs, terms_)) < np.linspace(0.4, 0.02, terms_)
    tf = rng.integers(1, 6, held.shape) * held
    n = tf.sum(axis=1) + rng.integers(1, 50, docs)
    ranker = Ranker([("all", np.arange(terms_)), ("few", np.array([3, 50, 69]))], weights, docs, int(n.sum()), 50)
    for part in np.array_split(np.arange(docs), 4):
        d, t = np.nonzero(tf[part])
        ranker.block(part, n[part], np.concatenate([[0], np.cumsum((tf[part] > 0).sum(axis=1))]), t, tf[part][d, t])
    m = 50 + 50 * n * docs // int(n.sum())
    gain = weights * (10**9 * tf // (1000 * tf + 20 * m[:, None]))
    for (_, wanted), (scores, keys) in zip(ranker.items, ranker.best):
        total = gain[:, wanted].sum(axis=1)
        order = np.lexsort([np.arange(docs), -total])[:50]
        assert keys.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert ranker.evaluated < docs  # of 2 * docs
