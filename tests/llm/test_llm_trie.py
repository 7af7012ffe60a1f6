"""The conversations' prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tokenfold.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", digest(r or "", x or ""), x or ""))
    turns = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: tuple(turns.get(c - c % 20, [])[:h[c]] + own[h[c]:]) for c, own in turns.items()}


def brute(rows):
    members, children = defaultdict(list), defaultdict(set)
    whole = rebuilt(rows)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        value = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += value
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(children[s]), leaves[s], saved[s],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == s).encode()).hexdigest()) for s, m in members.items())


def expanded(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "depth", "path", "a", "words", "row")})
    got = T.conversation_trie(df, **more)[1].collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in got)


def random_conversations(n, words, longest, seed, sparse=False):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(10 * n), n) if sparse else range(n):
        for t in range(rng.randrange(1, longest)):
            out.append((c, t, rng.choice(["user", "assistant"]) if t % 5 else "system", " ".join("ab"[rng.random() < 0.8] for _ in range(rng.randrange(words)))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("first_batch, per_group", [(1, 0), (3, 1 << 17), (2, 40)])
def test_nodes_equal_brute_force(spark, first_batch, per_group):
    rows = random_conversations(120, 3, 12, first_batch, sparse=first_batch == 3)
    assert expanded(spark, rows, first_batch=first_batch, per_group=per_group) == brute(rows)


def test_chains_of_prefixes_and_copies(spark, monkeypatch):
    """Conversations that are prefixes of one another, copies, and one that holds most turns, cut into many slices."""
    monkeypatch.setattr(T.running, "__defaults__", (False, False, 8))
    rows = [(c, t, "user", f"w{t} x") for c in range(60) for t in range(c % 37)] + [(200, t, "user", f"w{t} x") for t in range(300)]
    rows += [(1000 + c, t, "user", "same") for c in range(50) for t in range(3)]
    assert expanded(spark, rows, first_batch=2) == brute(rows) == expanded(spark, rows, first_batch=2, per_group=50)


def test_odd_rows(spark):
    rows = [
        (40, None, None, None), (40, 3, "user", "b"), (40, 3, "user", "a"), (40, 3, "assistant", "a"), (40, 3, "user", "a"), (41, 0, None, ""), (41, 1, "", None),
        (None, 0, "user", "lost"), (61, 0, "user", "x y"), (62, 0, "user", "x y z"), (63, 5, "user", "x y"), (64, None, "user", "x"), (65, 1, "u", "s"),
        (66, 0, "us", "er"), (67, 0, "user", ""), (-3, 0, "user", "below zero"), (-25, 1, "user", "below zero"), (1 << 40, 0, "user", "far"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert expanded(spark, rows) == brute(rows)
    assert any(n[1] == 0 and n[7] != hashlib.sha256(b"").hexdigest() for n in expanded(spark, rows)), "turnless conversations end at the root"
    assert expanded(spark, []) == []
    turnless = [(c, 0, "user", "x") for c in (61, 62, 63, 64, 65, 66) if zlib.crc32(str(c).encode()) % 4]
    assert turnless and expanded(spark, turnless) == brute(turnless) and len(brute(turnless)) == 1


def test_ids_are_hashed_in_order_over_runs(spark):
    ids = [(k % 2, c) for k, c in enumerate(random.Random(1).sample(range(1 << 20), 3000))]
    df = spark.createDataFrame(ids, "kind int, conv long").repartition(7)
    got = {r.kind: (r.n, r.least, r.digest) for r in T.id_digests(df, ["kind"]).collect()}
    for k in (0, 1):
        own = sorted(c for j, c in ids if j == k)
        assert got[k] == (len(own), own[0], hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", T.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_handles_name_every_compacted_node(spark):
    rows = random_conversations(80, 3, 9, 7)
    trie, _ = T.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    nodes = trie.nodes().collect()
    whole = set(rebuilt(rows).values()) - {()}
    cuts = {s for s in whole} | {s[:d] for s in whole for d in range(1, len(s)) if len({t[d] for t in whole if t[:d] == s[:d] and len(t) > d}) > 1}
    assert len(nodes) == len(cuts) == len({(n.handle, n.a, n.b) for n in nodes}) and all(n.above < n.handle <= n.depth for n in nodes)
    exits = trie.located(trie.turns.groupBy("conv").agg(F.max("depth").alias("size"))).collect()
    assert all(r.depth == r["size"] for r in exits)
