"""Vector, url and sharding operators and the two scorers against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenfold.llm import pivots, quality, queries, sharding, topk, toxicity, url_rules

NAN, INF = float("nan"), float("inf")


# ---- sharding ----------------------------------------------------------------------------------------------------

def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    rng = random.Random(1)
    keys = [0, 1, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(400)]
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump_shards(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_sharded_documents(spark):
    rows = [(i, ["x" * i, "é", "", None][i % 4], "s") for i in range(500)] + [(3, "again", "s"), (None, None, None), (7, "é", "s"), (7, "é", "s")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 24).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots, place = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert place.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert len(slots) == 24 and any(r.grown_shard == 24 for r in got)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0


# ---- url rules ---------------------------------------------------------------------------------------------------

def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls_equal_brute_force(spark):
    rng = random.Random(4)
    rules = [*queries.RULES, url_rules.Rule("a.b", "/x/y", "block"), url_rules.Rule("b", "/x/", "allow"), url_rules.Rule("a+c.b", "/(q", "block")]
    hosts = ["example.net", "www.Example.net", "xexample.net", "net", "NET", "a.b", "z.a.b", "b", "a+c.b", "É.org", "org", "example.com", "", "net.x"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/1", "/fr/?q=/de/", "/x/y", "/x/yy", "/x/", "?a=/en/", "#/en/", "/(q)", "/a\nb", "//en/"]
    urls = [None, "", "example.net/en/", "://", "http://", "ftp://net/://org/fr/"]
    urls += [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(0, None, "v"), (None, "http://net/", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_rules.judge_urls(df, rules).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter((i, *plain_verdict(u, rules)) for i, u, _ in rows)
    assert max(r.n_candidates for r in got) < len(rules)
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(df, []).collect()} == {"allow"}


# ---- exact top-k -------------------------------------------------------------------------------------------------

def plain_top(rows, is_query, k=10):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    out = Counter()
    for q, v in {(i, tuple(v)) for i, v in ok if is_query(i)}:
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in ok if i != q)[:k]
        out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_products_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24)) * scale
    base[50:60] = base[49]  # ties
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1010, []), (1020, [None] * 24), (1030, [NAN] + [1.0] * 23), (1040, [INF] + [1.0] * 23), (None, rows[0][1]), (2000, [0.5, -0.5]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_products(df, F.col("vec_id") % 10 == 0, per_block=70, per_queries=9, pilot=40)
    assert Counter(tuple(r) for r in got.collect()) == plain_top(rows, lambda i: i % 10 == 0)


def test_top_products_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_products(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 5 * 1024 * 1024)]
    assert topk.top_products(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_are_upper_bounds():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(50, 37))
    exact = q @ x.T
    last = np.full(exact.shape, np.inf)
    for n in (1, 2, 8, 16, 37):
        bound = topk.segment_statistics(q, n) @ topk.segment_statistics(x, n).T
        assert (bound >= exact - 1e-9).all() and bound.sum() <= last.sum()
        last = bound


# ---- near-duplicate vectors --------------------------------------------------------------------------------------

def plain_links(rows):
    ok = {n: np.array(v, float) for n, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = defaultdict(set)
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[a].add(b)
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            todo = [m for t in todo for m in links[t] if m not in seen and not seen.add(m)]
        group = min(rows[m][0] for m in seen)
        out.append((i, len(links[n]), group, i == group))
    return out


@pytest.mark.parametrize("per_tile", [20_000, 25])
def test_near_vectors_reach_brute_force(spark, per_tile):
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=32) for _ in range(250)]
    vectors += [vectors[7] + rng.normal(size=32) * 0.02 for _ in range(120)]  # one large group of near copies
    vectors += [vectors[7]] * 40
    for i in range(100):  # links near the bound
        v = vectors[i]
        w = rng.normal(size=32)
        w -= w @ v / (v @ v) * v
        vectors.append(v + w / np.linalg.norm(w) * np.linalg.norm(v) * rng.uniform(0.1, 0.45))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 32), (902, [NAN] * 32), (903, [None] + [1.0] * 31), (904, []), (905, [INF] * 32)]
    df = spark.createDataFrame([(i, v, "p") for i, v in rows], "vec_id long, embedding array<float>, point string").repartition(3)
    got = {r.vec_id: tuple(r) for r in pivots.near_vectors(df, per_tile=per_tile).collect()}
    want = {r[0]: r for r in plain_links(rows)}
    assert set(got) == set(want)
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.97 * sum(r[1] for r in want.values())
    assert sum(got[i][2:] == want[i][2:] for i in want) >= 0.97 * len(want)
    assert all(got[i] == (i, 0, i, True) for i in range(900, 906))


def test_near_vectors_of_repeated_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (2, [2.0, 0.1]), (9, [0.0, 1.0])], schema)
    assert Counter(tuple(r) for r in pivots.near_vectors(df).collect()) == Counter({(5, 2, 2, False): 2, (2, 2, 2, True): 1, (9, 0, 9, True): 1})
    assert pivots.near_vectors(df.limit(0)).count() == 0


def crowd(rng, n, cosine, dim=64):
    """Unit vectors of which a third form one isotropic group with about ``cosine`` between any two; the others are far or near pairs."""
    def units(k):
        x = rng.normal(size=(k, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    centre, m = units(1), n // 3
    spread = units(m)
    spread -= spread @ centre.T * centre
    group = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * spread / np.linalg.norm(spread, axis=1, keepdims=True)
    far = units(n - m)
    far[:n // 9] = 0.97 * far[n // 9:2 * (n // 9)] + 0.22 * far[:n // 9]
    return np.concatenate([group, far])


@pytest.mark.parametrize("n,cosine,per_tile", [(1500, 0.95, 20_000), (1500, 0.98, 200), (9000, 0.96, 20_000), (9000, 0.955, 1100)])
def test_near_vectors_of_a_group_of_a_third(spark, n, cosine, per_tile):
    x = crowd(np.random.default_rng(n), n, cosine)
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), per_tile=per_tile).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.95
    want = links.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(n)])
    m = n // 3
    assert (found <= want).all()
    assert found[:m].sum() >= 0.995 * want[:m].sum() > 0.4 * m * m
    assert found[m:].sum() >= 0.97 * want[m:].sum() > 0
    assert np.mean([got[i].component_id == 0 for i in range(m)]) >= 0.995


def test_near_vectors_within_one_group_meet(spark):
    x = crowd(np.random.default_rng(5), 900, 0.95)[:300]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(df).collect()}
    assert [got[i] for i in range(300)] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("dense", [0.2, 0.6])
def test_spanning_links_join_the_same_rows(dense):
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.permutation(40)[:rng.integers(1, 20)], np.arange(40, 40 + rng.integers(1, 30))
        hits = rng.random((len(a), len(b))) < dense * rng.random()
        i, j = np.nonzero(hits)
        x, y = pivots._spanning(hits, a, b)
        plain = lambda links: sorted(map(sorted, _joined(links)))
        assert plain(zip(x.tolist(), y.tolist())) == plain(zip(a[i].tolist(), b[j].tolist()))


def _joined(links):
    groups = []
    for a, b in links:
        own = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in own] + [{a, b}.union(*own)]
    return groups


# ---- quality -----------------------------------------------------------------------------------------------------

def test_chunks_cover_every_byte():
    sizes = np.array([0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 5000])
    start, end, doc = quality.chunk_spans(sizes)
    base = np.cumsum(sizes) - sizes
    for d, n in enumerate(sizes):
        seen = np.zeros(n, bool)
        for a, b in zip(start[doc == d], end[doc == d]):
            assert 0 <= a - base[d] <= b - base[d] <= n and b - a <= quality.CHUNK
            seen[a - base[d]:b - base[d]] = True
        assert seen.all() and (doc == d).any()


def test_repetition_marks():
    data = np.frombuffer(b"one two three four five six " + b"again " * 6, np.uint8)
    marked = quality.byte_kinds(data) >= quality._KINDS
    assert not marked[:44].any() and marked[-10:].all()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghimnoprst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        t = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        good, toxic = i % 3 != 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(["gromble", "fuzzwit", "snarkle" + rng.choice(["an", "os", "it", "ur"])])
        rows.append((i, " ".join(t) if good else " ".join(w.upper() + "!!" for w in t), "x"))
        if i < 400:
            labels.append((i, int(good), int(toxic)))
    rows += [(900, None, None), (901, "", "x"), (902, " ".join(rng.choice(vocab) for _ in range(20000)), "x"), (None, "a b c", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_network_learns(labelled):
    docs, labels = labelled
    network = quality.train(docs, labels, ~quality.held_out(F.col("doc_id"), 4, 2))
    got = quality.scored(docs.select("doc_id", "text"), network).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.7) == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(right) >= 0.97 * len(right) > 50
    # batches do not matter, whole texts do
    again = {r.doc_id: r.score for r in quality.scored(docs.select("doc_id", "text").repartition(7), network).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    long = next(r.text for r in docs.collect() if r.doc_id == 902)
    assert quality._score_texts(network, [(long + " JUNK!!" * 200).encode()])[0] < quality._score_texts(network, [long.encode()])[0]
    assert quality.scored(docs.select("doc_id", "text").limit(0), network).count() == 0


def test_quality_without_labels(labelled):
    docs, labels = labelled
    assert quality.train(docs, labels.limit(0), F.lit(True)) == 0.5
    assert {r.score for r in quality.scored(docs.select("doc_id", "text"), 0.5).collect()} == {0.5}


def test_held_out_parts(spark):
    got = spark.range(50).select("id", quality.held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


# ---- toxicity ----------------------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(7)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    words, stems = sorted(set(terms[:25])), sorted(set(terms[25:]))
    trie, matcher = toxicity.Trie(words, stems), toxicity.Matcher(toxicity.Lexicon(words, stems))
    for _ in range(600):
        w = "".join(rng.choice("abcw") for _ in range(rng.randint(0, 10)))
        want = {}
        for kind, held in (("w", words), ("s", stems)):
            for t in held:
                d = edits(w, t) if kind == "w" else min(edits(w[:n], t) for n in range(len(w) + 1))
                if d <= (1 if len(t) >= toxicity.LEAST_MISSPELLED else 0):
                    want[t + "-" * (kind == "s")] = d
        assert trie.matches(w) == want
        assert not want or matcher.possible(w)


def test_quotation_counts_in_part():
    lexicon = toxicity.Lexicon(["gromble"], [], {("gromble", 0): 4.0, ("gromble", 1): 3.0}, (1.0, 0.0, -2.0))
    m = toxicity.Matcher(lexicon)
    abuse, quoted, typo = m.score("you are a gromble"), m.score("he said “you are a gromble” and left"), m.score("you are a gr0mble!")
    assert abuse > 0.7 > quoted > m.score("all is well") and abuse > typo > 0.7
    assert m.score("") == m.score(" \n") == m.score("all is well")


def test_toxicity_learns(labelled):
    docs, labels = labelled
    lexicon = toxicity.train(docs, labels, ~quality.held_out(F.col("doc_id"), 3, 1))
    assert {"gromble", "fuzzwit"} <= set(lexicon.words) | {s for s in lexicon.stems}.union(w for w in lexicon.words)
    got = toxicity.scored(docs.select("doc_id", "text"), lexicon).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(right) >= 0.95 * len(right) > 50
    assert toxicity.scored(docs.select("doc_id", "text").limit(0), lexicon).count() == 0


def test_toxicity_learns_short_words(spark):
    rng = random.Random(16)
    vocab = ["".join(rng.choice("abcdefghimnoprst") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        t = [w for w in rng.choices(vocab, k=rng.randint(20, 200))]
        for _ in range(3 * (i % 4 == 0)):
            t.insert(rng.randrange(len(t)), rng.choice(["kux", "zw", "~kux"]))
        rows.append((i, " ".join(t)))
        if i < 400:
            labels.append((i, int(i % 4 == 0)))
    rows += [(900, "zw kux"), (901, "kuxa zwe ku z"), (902, "a b")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, F.lit(True))
    assert {"kux", "zw"} <= set(lexicon.words) and all(len(x) >= toxicity.LEAST_STEM for x in lexicon.stems)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, lexicon).collect()}
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in range(400, 500)) >= 97
    assert got[900] >= 0.7 > got[901] and got[902] < 0.7


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert toxicity.Matcher(toxicity.train(docs, labels.limit(0), F.lit(True))).score("x") == pytest.approx(0.5)
