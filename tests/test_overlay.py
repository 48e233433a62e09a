"""Overlay of nested documents against a recursive merge."""

import json
import random

import pytest

from fleetlake.operators import overlay


def merged(default, override):
    if isinstance(default, dict) and isinstance(override, dict):
        return {k: merged(default[k], override[k]) if k in default and k in override else override.get(k, default.get(k)) if k in override else default[k] for k in {**default, **override}}
    return override


def flat(value, path=()):
    if isinstance(value, dict) and (value or not path):
        return [leaf for k, v in value.items() for leaf in flat(v, (*path, k))]
    return [(path, json.dumps(value, separators=(",", ":")))]


def made(rng, depth=0):
    """A random document with few names, so that both sides meet."""
    return {k: rng.choice([made(rng, depth + 1), made(rng, depth + 1), {}, None, rng.randrange(9), "t", [1, {"a": 2}]]) if depth < 3 else rng.randrange(9) for k in rng.sample("abcd", rng.randrange(0, 4))}


def result(spark, pairs):
    docs = spark.createDataFrame([(i, d, o) for i, (d, o) in enumerate(pairs)], "k int, d string, o string")
    rows = overlay.overlaid(overlay.leaves(docs, "k", "d"), overlay.leaves(docs, "k", "o"), "k").collect()
    return sorted((r["k"], tuple(r["path"]), r["value"]) for r in rows), rows


def test_overlay_equals_recursive_merge(spark):
    rng = random.Random(4)
    pairs = [(made(rng), made(rng)) for _ in range(120)]
    got, _ = result(spark, [(json.dumps(d), json.dumps(o)) for d, o in pairs])
    assert got == sorted((i, p, v) for i, (d, o) in enumerate(pairs) for p, v in flat(merged(d, o)))


def test_documents_that_are_no_objects(spark):
    got, rows = result(spark, [('{"a":{"b":1}}', None), (None, '{"a":null}'), ("[1]", "5"), ("{}", "{broken"), ('{"a":1}', '{"a":null,"b":{}}')])
    assert got == [(0, ("a", "b"), "1"), (1, ("a",), "null"), (4, ("a",), "null"), (4, ("b",), "{}")]
    assert {(r["k"], r["source"]) for r in rows} == {(0, "default"), (1, "override"), (4, "override")}


def test_depth_is_stated(spark, monkeypatch):
    monkeypatch.setattr(overlay, "DEPTH", 2)
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "k int, d string")
    with pytest.raises(ValueError, match="deeper"):
        overlay.leaves(docs, "k", "d")
