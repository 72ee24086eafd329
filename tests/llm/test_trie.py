"""The conversation trie against prefixes counted one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from paperloom.llm import convtrie, queries

CONVS = "conv_id long, turn long, role string, text string, k string, seg int, pos long"


def brute(convs):
    """convs: {conv_id: [(role, text)]} -> {(least member, depth): the node's other columns}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in own if len(convs[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[min(own), len(path)] = (min(members[path[:-1]]) if path else None, len(own), kids, leaves, saved, sha)
    return out


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            ident = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn, ident, role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def collected(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def fixture():
    rng = random.Random(11)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 9]))
    rows = []
    for c in [*range(0, 60), 101, 203, -3, -5, 10**12]:
        n = rng.choice([1, 2, 3, 8, 12]) if c % 7 else rng.choice([1, 40])
        rows += [(c, k if rng.random() < 0.9 else None, *turn()) for k in range(n)]
    long = [(k, *turn()) for k in range(30)]
    for c in range(300, 330):  # copies of one conversation, some cut short, some going on
        rows += [(c, *t) for t in long[: rng.choice([30, 30, 9, 17])]]
        if rng.random() < 0.3:
            rows.append((c, 99, *turn()))
    rows += [rows[4], rows[4], (None, 0, "user", "x"), (777, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("segment", "block"), [(512, 1024), (4, 5), (2, 1)])
def test_trie_equals_brute_force(spark, segment, block):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONVS)
    turns, convs = convtrie.shared_starts(*convtrie.turns_of(df))
    assert collected(convtrie.trie(turns, convs, segment, block)) == brute(rebuilt(rows))


def test_turnless_conversations_and_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, idx long, id string, n long")
    none = spark.createDataFrame([], "conv_id long, size long")
    assert convtrie.trie(turns, none).count() == 0
    assert collected(convtrie.trie(turns, spark.createDataFrame([(4, 0), (9, 0), (2, 0)], "conv_id long, size long"))) == brute({4: [], 9: [], 2: []})
    assert convtrie.trie(*convtrie.shared_starts(*convtrie.turns_of(spark.createDataFrame([], CONVS)))).count() == 0


def test_many_equal_conversations_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "IDS_IN_CHUNK", 7)
    convs = {c: [("u", "t")] if c % 3 else [("u", "t"), ("a", "z")] for c in range(95)}
    rows = [(c, k, *t) for c, v in convs.items() for k, t in enumerate(v)]
    turns, sizes = convtrie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert collected(convtrie.trie(turns.withColumnRenamed("k", "idx"), sizes.select("conv_id", "size"), block=10)) == brute(convs)


def test_nearest_smaller_values_in_other_blocks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64):
        minima = rng.integers(0, 5, n)
        tables = convtrie.doubled(minima)
        for b in range(n):
            for v in range(6):
                want = max((j for j in range(b) if minima[j] < v), default=-1)
                assert convtrie.block_before(tables, np.array([b]), np.array([v]))[0] == want
        lo = rng.integers(0, n, 20)
        hi = np.array([rng.integers(x, n) + 1 for x in lo])
        assert convtrie.range_min(tables, lo, hi).tolist() == [minima[a:b].min() for a, b in zip(lo, hi, strict=True)]


def test_query_equals_brute_force_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op11_conversation_trie(spark, "/root/testdata/sf0.001")) == brute(rebuilt(rows))
