"""Text operators against brute force: SimHash groups, repeated passages, packing, mixing."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenfold.llm import mixing, packing, queries, repeats, simhash
from tokenfold.llm.common import components, numbered
from tokenfold.llm.words import word_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, Size int, fp string, chunk string"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, blanks, a long text and a repeated row."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß!", "日本", "Ab"]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    texts = []
    for i in range(n):
        t = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        if i % 7 == 0:
            t[len(t) // 2:len(t) // 2] = passage.split()
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(t))
    texts += [texts[3], texts[3], texts[5] + " more", None, "", " \n\t", " ".join(rng.choice(vocab) for _ in range(9000)), "a " * 80, "Ab\x0bcd\x1cef gh"]
    rows = [(i * 3, t, rng.choice(["b", "a", "hot", "hot", "hot", None, "é", "B"]), i, "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "only w1 w2 w3 w4", "a", 1, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- SimHash -----------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    t = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(t[i:i + 3]) for i in range(len(t) - 2)] or ([" ".join(t)] if t else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(items, linked):
    """Smallest reachable index of every index."""
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(len(items)):
                if linked(items[i], items[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_equal_brute_force(docs, rows):
    got = Counter((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((d, plain_fingerprint(t)) for d, t, *_ in rows)


def test_spark_hash_is_the_shingle_hash(spark):
    row = spark.sql("select xxhash64('w1 w2 é') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("w1 w2 é".encode(), 42)


def test_fingerprint_links_equal_brute_force(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    for _ in range(200):
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.fingerprint_links(df).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df, 4)


def test_simhash_groups_equal_brute_force(docs, rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = grouped(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = defaultdict(list)
    for (d, *_), g in zip(rows, label):
        least[g].append(d)
    want = Counter((d, min((x for x in least[g] if x is not None), default=None)) for (d, *_), g in zip(rows, label))
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*chain, *hub, (7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeated passages -------------------------------------------------------------------------------------------

def plain_repeats(texts, window):
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 8, 1])
def test_repeats_equal_brute_force(docs, rows, window):
    got = repeats.remove_repeats(docs, window=window, per_chunk=3000, per_bucket=5000)
    assert Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(
        (row[0], *p) for row, p in zip(rows, plain_repeats([r[1] for r in rows], window)))


def test_words_are_digested_without_an_object_each():
    rng = random.Random(4)
    texts = [b"", bytes(range(256)), b" \x0b a  b\x1c\xc2\xa0c ", *(
        bytes(rng.choice(b"ab \t\n\x0b\x0c\r\xc3\x00\x1c") for _ in range(rng.randrange(40))) for _ in range(200))]
    got, n = word_digests(texts)
    flat = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    assert got.tobytes() == b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in flat)
    for none in ([], [b""], [b" \n"]):
        got, n = word_digests(none)
        assert got.shape == (0, 2) and n.tolist() == [0] * len(none)
    many = [b" ".join(b"word%d" % (k % 100) for k in range(200_000))]
    tracemalloc.start()
    word_digests(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 200_000  # a bytes object for every word takes more


def test_repeats_of_a_tiny_vocabulary(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (5, 11, 16):
        got = repeats.remove_repeats(df, window=window, per_chunk=300, per_bucket=300).collect()
        assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(plain_repeats(texts, window)))


def test_repeats_tell_apart_what_sums_of_powers_do_not(spark):
    """Thue and Morse's sequence and its swap: as letters of one word, and as words of a long window."""
    turns = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = "".join("ab"[t] for t in turns[:1024]), "".join("ba"[t] for t in turns[:1024])
    start = " ".join(f"w{k}" for k in range(34))
    df = spark.createDataFrame([(0, f"{start} {one}"), (1, f"{start} {two}")], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame([(0, f"{start} {one}"), (1, f"{start} {one}")], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(df).collect()] == [35, 35]
    df = spark.createDataFrame([(k, " ".join(ab[t] for t in turns)) for k, ab in enumerate(("ab", "ba"))], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(df, window=4096).collect()] == [0, 0]


def test_without_repeats_leaves_other_texts_alone(docs, rows):
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns
    want = Counter((r[0], p[2] if p[1] else r[1]) for r, p in zip(rows, plain_repeats([r[1] for r in rows], 35)))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


# ---- packing -----------------------------------------------------------------------------------------------------

def check_places(pieces, capacity):
    bins = defaultdict(list)
    for s, o, n in pieces:
        bins[s].append((o, n))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_plans_are_whole_and_dense():
    rng = random.Random(2)
    for capacity in (10, 37, 2048):
        for _ in range(60):
            counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 50))}
            places = [(b + j // per, off + j % per * n, n) for n, _, items, b, per, off in packing.plan_sequences(counts, capacity).tolist() for j in range(items)]
            assert Counter(n for _, _, n in places) == Counter(counts)
            assert check_places(places, capacity) <= 1.25 * math.ceil(sum(n * c for n, c in counts.items()) / capacity) + sum(c for n, c in counts.items() if 3 * n > capacity)


def test_large_items_pair_greedily():
    steps = packing.plan_sequences({6: 2, 4: 3, 5: 2}, 10)
    assert len({b + j // per for _, _, items, b, per, _ in steps.tolist() for j in range(items)}) == 4  # 6+4, 6+4, 5+5, 4


def test_token_ids_equal_the_tokenizer():
    enc = packing.Encoder(packing.default_tokenizer(), cut=16)
    rng = random.Random(3)
    letters = "ab Z\t\n\r  é'slldmß12²½—日本 ・\x1c\x85  .!,ǆ|$~"
    for i in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) + ("<|endoftext|>" if i % 50 == 0 else "")
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == want


def test_packed_documents(docs, rows):
    got = packing.pack_documents(docs).collect()
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    want = Counter()
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 2048)
        cuts = [0, *[len(ids) - (n - 1 - p) * 2048 for p in range(n)]]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_pack_refuses_other_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 11)], "doc_id long, piece int, length long"), 10)


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 50), (None, 7), ("b", 1)) for i in range(n)], "g string, i long")
    got = numbered(df, ["g"], ["i"], 58, "slot", per_slice=5).collect()
    for g, n in (("a", 50), (None, 7), ("b", 1)):
        assert sorted(r.slot for r in got if r.g == g) == list(range(n))


# ---- mixing ------------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_targets(docs, rows):
    got = mixing.mix_documents(docs, block=16).collect()
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(words(t))) for d, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_documents(docs.repartition(5), block=16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixed_texts_hold_the_taken_words(docs, rows):
    mixed = mixing.mixed_texts(docs, block=16)
    assert mixed.columns == docs.columns
    held, by_id = Counter(), {d: words(t) for d, t, *_ in rows}
    for r in mixed.collect():
        got = words(r.text)
        held[r.doc_id] += len(got)
        assert not Counter(got) - Counter(by_id[r.doc_id])
    taken = Counter()
    for r in mixing.mix_documents(docs, block=16).collect():
        taken[r.doc_id] += r.taken
    assert held == Counter({d: n for d, n in taken.items() if n})


def test_shards_add_up_to_the_sources(docs, empty):
    taken, held, slots, shards = Counter(), Counter(), Counter(), set()
    for r in mixing.mix_documents(docs, block=16).collect():
        taken[r.source] += r.taken
    got = mixing.shard_words(docs, block=16, words=500).collect()
    for r in got:
        held[r.source] += r.words
        slots[r.source] += r.slots
        shards.add(r.shard)
        assert 0 < r.words <= 16 * r.slots
    assert held == Counter({s: n for s, n in taken.items() if n}) and len(got) == len({(r.shard, r.source) for r in got})
    assert shards <= set(range(sum(taken.values()) // 500 + 2)) and len(shards) > 3
    # dealt at random: no source stands in one shard, and shares of a large source vary about their mean
    source, n = slots.most_common(1)[0]
    most = max(r.slots for r in got if r.source == source)
    assert n / len(shards) < most < n / len(shards) + 6 * (n / len(shards)) ** 0.5 + 1
    assert sorted(map(tuple, mixing.shard_words(docs.repartition(5), block=16, words=500).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.shard_words(empty).count() == 0


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100, 1009):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(n)).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_targets_of_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_documents(df).collect()] == [(0, 0.0, 0)] * 2


# ---- empty tables ------------------------------------------------------------------------------------------------

def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mixed_texts(empty).count() == 0


def test_repeats_query_digest(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_fixed_block_repeats"](spark, str(tmp_path)).collect()
    want = Counter((r[0], n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows, plain_repeats([r[1] for r in rows], 35)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    prints = queries.QUERIES["op9_simhash_grid"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in prints) == Counter((r[0], f"{plain_fingerprint(r[1]):016x}") for r in rows)
