"""Vectors, conversations, components, the pipeline and the entry module."""

import ctypes
import inspect
import json
import math
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gridloom.llm import chat, components, embdedup, langid, neardup, tokens
from gridloom.llm.shared import lean
from tests.llm.conftest import odd_rows


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 7), (10, 9), (9, 8), (5, 4), (4, 3), (None, 1), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4, 5], 1), **dict.fromkeys([8, 9, 10], 8), **dict.fromkeys(range(100, 141), 100)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "TILE", 8)
    rng = np.random.default_rng(0)
    rows = []
    for c in range(6):
        centre = rng.normal(size=32)
        for _ in range(15):
            rows.append((len(rows), (centre + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.25, 0.35])).tolist(), c % 2))
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], None), (n + 2, [0.0] * 32, 0), (n + 3, None, 0), (n + 4, [math.nan] + [1.0] * 31, 0), (n + 5, [None] + [1.0] * 31, 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (None, rows[0][1], 0), (n + 8, [], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, kept string, links int")
    got = {r.vec_id: r for r in embdedup.near_vectors(table).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = {i: 0 for i in got}, {i: i for i in got}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, (i, v, k) in enumerate(good):
        for j, w, m in good[:p]:
            if k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert len(got) == len(rows)
    assert {i: r.n_links for i, r in got.items()} == links
    assert all(r.component_id is None and r.kept if i is None else r.component_id == find(i) and r.kept == (find(i) == i) for i, r in got.items())
    assert embdedup.near_vectors(table.where("false")).count() == 0


def test_chat(spark):
    calls = lambda *c, content=None: json.dumps({"content": content, "tool_calls": list(c)})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hi {x}"), (1, 1, "assistant", calls({"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "search", "arguments": {"limit": "no"}, "after": ["a"]}, content="let me")),
        (1, 2, "tool", result("a", "R1")), (1, 3, "tool", result("b", "R2")), (1, 4, "tool", result("zz", "R3")), (1, 5, "tool", result("a", "again")),
        (2, 0, "tool", result("c", "early")), (2, 1, "assistant", calls({"id": "c", "name": "calculator", "arguments": {"expression": "1"}}, {"id": "d", "name": "calculator", "arguments": {"expression": "1"}, "after": ["e"]}, {"id": "e", "name": "zork", "after": ["d"]})),
        (2, 2, "assistant", calls({"id": "c", "name": "calculator", "arguments": {"expression": "1", "more": 1}}, {"id": "f", "name": "zork"}, {"id": "g", "name": "get_weather", "arguments": {"city": "X"}}, {"id": "h", "name": "search", "arguments": [1]})),
        (None, None, None, None), (3, 0, "user", '{"tool_calls": broken'), (3, 0, "user", '{"tool_calls": broken'), (3, 1, "user", ""), (3, 2, "user", "y" * 200_000),
    ]
    got = chat.format_chat(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message string")).orderBy("conv_id", "turn", "level", "part").collect()
    status = {(r.conv_id, r.call_id, json.loads(r.message)["type"], r.turn): r.status for r in got if r.call_id}
    assert status == {
        (1, "a", "tool_call", 1): "ok", (1, "b", "tool_call", 2): "invalid_arguments", (1, "a", "tool_result", 2): "ok", (1, "b", "tool_result", 3): "ok", (1, "zz", "tool_result", 4): "orphan_result", (1, "a", "tool_result", 5): "duplicate_result",
        (2, "c", "tool_call", 1): "ok", (2, "c", "tool_result", 1): "ok", (2, "d", "tool_call", 1): "cycle", (2, "e", "tool_call", 1): "cycle", (2, "c", "tool_call", 2): "duplicate_call", (2, "f", "tool_call", 2): "unknown_tool", (2, "g", "tool_call", 2): "unanswered", (2, "h", "tool_call", 2): "invalid_arguments",
    }
    order = [(r.call_id, json.loads(r.message)["type"]) for r in got if r.conv_id == 1 and r.call_id in ("a", "b")][:4]
    assert order == [("a", "tool_call"), ("a", "tool_result"), ("b", "tool_call"), ("b", "tool_result")]
    first = next(r for r in got if r.call_id == "a")
    assert json.loads(json.loads(first.message)["arguments"]) == {"limit": 3, "query": "x"} and '{\\"limit\\":3,\\"query\\":\\"x\\"}' in first.message
    assert sum(r.conv_id == 3 for r in got) == 4 and sum(r.conv_id is None for r in got) == 1
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_long_chain(spark):
    """70 calls, each waiting for the one before; the result of the first comes last. Behind them a true cycle and a call waiting for it."""
    call = lambda i, *after: json.dumps({"tool_calls": [{"id": i, "name": "calculator", "arguments": {"expression": "1"}, "after": list(after)}]})
    rows = [(1, k, "assistant", call(f"c{k}", *[f"c{k - 1}"] * (k > 0))) for k in range(70)] + [(1, 90, "tool", json.dumps({"tool_call_id": "c0", "content": "R"}))]
    rows += [(2, 0, "assistant", call("x", "y")), (2, 1, "assistant", call("y", "x")), (2, 2, "assistant", call("z", "y"))]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = {r.call_id: r for r in got if json.loads(r.message)["type"] == "tool_call"}
    assert {i: calls[i].status for i in "xyz"} == dict.fromkeys("xyz", "cycle")
    assert [calls[f"c{k}"].level for k in range(70)] == list(range(70)) and [calls[f"c{k}"].turn for k in range(70)] == [0] + [90] * 69
    assert calls["c0"].status == "ok" and {calls[f"c{k}"].status for k in range(1, 70)} == {"unanswered"}


def test_chat_of_random_graphs(spark):
    """Levels, turns and status against a plain walk through each conversation."""
    rng = random.Random(31)
    rows, calls, results = [], {}, {}
    for conv in range(25):
        n = rng.randint(1, 12)
        for k in range(n):
            after = sorted({f"c{rng.randrange(n + 2)}" for _ in range(rng.choice([0, 1, 1, 2]))} - ({f"c{k}"} if rng.random() < 0.9 else set()))
            turn, name, argument = rng.randrange(8), rng.choice(["search", "zork"]), rng.choice(["query", "limit"])
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": name, "arguments": {argument: "x"}, "after": after}]})))
            calls[conv, f"c{k}"] = (turn, after, name, argument)
            if rng.random() < 0.6:
                answer = rng.randrange(10)
                rows.append((conv, answer, "tool", json.dumps({"tool_call_id": f"c{k}", "content": "R"})))
                results[conv, f"c{k}"] = answer
    placed: dict = {}
    moved = True
    while moved:  # a call is placed once all calls that it waits for are
        moved = False
        for (conv, i), (turn, after, *_) in calls.items():
            waits = [(conv, a) for a in after if (conv, a) in calls]
            if (conv, i) not in placed and all(w in placed for w in waits):
                level = 1 + max((placed[w][0] for w in waits), default=-1) if after else 0
                at = max([turn, *(placed[w][2] for w in waits)])
                placed[conv, i] = (max(level, 0), at, max(at, results.get((conv, i), -1)))
                moved = True
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen = 0
    for r in got:
        key, kind = (r.conv_id, r.call_id), json.loads(r.message)["type"]
        turn, after, name, argument = calls[key]
        cycle, (level, at, _) = key not in placed, placed.get(key, (0, turn, turn))
        if kind == "tool_call":
            status = "cycle" if cycle else "unknown_tool" if name == "zork" else "invalid_arguments" if argument == "limit" else "ok" if key in results else "unanswered"
            assert (r.level, r.turn, r.status) == (level, at, status), (key, r)
            seen += 1
        else:
            assert (r.level, r.turn, r.status) == (level, max(results[key], at), "ok")
    assert seen == len(calls) and any(k not in placed for k in calls) and max(p[0] for p in placed.values()) > 2


def test_pipeline(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == odd.columns, name
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == {4, 5, 6, 7, 8, 9, None} and 7 not in kept[1] and 6 in kept[1] and not kept[2] & {4, 5} and kept[3] <= kept[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name


def test_stages_with_clashing_names(spark, tmp_path):
    """Extra columns under the names that stages and operators use themselves come through unchanged."""
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = ["score", "lang_pred", "bits_per_byte", "kept", "row", "_hit", "_h", "_t", "_d", "n_hit", "text_hash", "row_hash", "rid", "size", "pass", "block", "source_size", "component_id", "n_shingles", "a", "b", "w", "c", "c.d"]
    rows = [(i, f"document {i} has the words number {i * 7} and {i * 11} and some more {i}", "en", "s", 50, *[f"{c}{i}" for c in own]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in own))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *own], name
        for r in docs.collect():
            assert [r[c] for c in own] == [f"{c}{r.doc_id}" for c in own], name
    assert {r.doc_id for r in docs.collect()} <= set(range(20)) and corpus_pipeline.token_ids(spark, docs, "").count() == docs.count()


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, None, None), (3, "12 --", None), (4, None, "en"), (5, "\u6771\u4eac", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "plain words", None), (5, "\u6771\u4eac", None)]


def test_workers_give_memory_back(spark):
    """What a task's many small strings took is no longer the worker's in the stage after it."""
    if not pathlib.Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs Linux and glibc")

    def run(batches):
        def mb():
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text()))) / 1024

        for _ in batches:
            start = mb()
            made = [b"x" * 600 for i in range(100_000)]
            made = [bytes(x + b"%d" % i) for i, x in enumerate(made)]
            most, last = mb(), made[-1] + b"!"  # made last, so that the heap doesn't shrink by itself
            pa.kept = last
            del made
            yield pa.RecordBatch.from_pydict({"start": [start], "most": [most]})

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"now": [sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text()))) / 1024]})

    one = spark.range(1).coalesce(1)
    took = one.mapInArrow(lean(run), "start double, most double").first()
    now = one.mapInArrow(look, "now double").first().now
    assert took.most - took.start > 40 and now < took.start + (took.most - took.start) / 2
    for module in (langid, neardup, tokens, components):
        assert all("lean(" in x for x in inspect.getsource(module).splitlines() if ".mapInArrow(" in x)


def test_entry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and len(odd_rows()) == 11
