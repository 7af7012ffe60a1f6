"""The corpus pipeline stage by stage against brute force, and the optional parts' registration."""

import random
from collections import Counter

import pytest
from test_llm_text import check_places, grouped, plain_fingerprint, plain_repeats, plain_targets, words

import corpus_pipeline as P
from tokenfold.llm import packing, quality


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for i in range(160):
        t = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        if i % 9 == 0:
            t[2:2] = passage.split()
        text = " ".join(t)
        if i % 5 == 0:
            text = " ".join(f"{w.upper()}!!" for w in t)
        rows.append([i, text, rng.choice(["en", "de"]), rng.choice(["src0", "src0", "src1", "src2", None]), len(text)])
    rows += [[200 + i, rows[i * 7 + 1][1], "en", "src0", rows[i * 7 + 1][4]] for i in range(12)]  # copies
    rows += [[300 + i, rows[i * 6 + 2][1] + " more", "en", "src1", 1] for i in range(8)]
    rows += [[400, None, None, None, None], [401, "", "en", "src0", 0], [402, " ".join(rng.choice(vocab) for _ in range(6000)), "en", "src2", 5], list(rows[3])]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, corpus_dir, tmp_path_factory):
    """The input and every stage's output, each written and read again."""
    folder, docs = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{corpus_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, corpus_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def rows(part):
    return Counter(map(tuple, part))


def test_quality_stage(spark, corpus_dir, stages):
    network = quality.train(spark.read.parquet(f"{corpus_dir}/documents.parquet"), spark.read.parquet(f"{corpus_dir}/labels.parquet"),
                            ~quality.held_out(P.F.col("doc_id"), 4, 2))
    scores = {r: quality._score_texts(network, [(r.text or "").encode()])[0] for r in stages[0]}
    sure = [r for r in stages[0] if abs(scores[r] - 0.7) > 1e-4]
    kept = rows(stages[1])
    assert all((kept[tuple(r)] > 0) == (scores[r] >= 0.7) for r in sure)
    clean = [r for r in stages[0] if r.doc_id < 150 and r.doc_id % 5]
    assert all(kept[tuple(r)] for r in clean)
    assert not [r for r in stages[1] if r.text and "!!" in r.text]


def test_dedup_stage(stages):
    before, after = stages[1], stages[2]
    label = grouped([plain_fingerprint(r.text) for r in before], lambda a, b: bin(a ^ b).count("1") <= 3)
    groups = {}
    for r, g in zip(before, label):
        groups.setdefault(g, []).append(r)
    ids = Counter(min(r.doc_id for r in held) for held in groups.values())
    assert Counter(r.doc_id for r in after) == ids and not rows(after) - rows(before)


def test_repeats_stage(stages):
    want = Counter()
    for r, (_, gone, kept) in zip(stages[2], plain_repeats([r.text for r in stages[2]], 35)):
        text = kept if gone else r.text
        want[(r.doc_id, text, r.lang, r.source, None if text is None else len(text))] += 1
    assert rows(stages[3]) == want
    assert stages[2] and sum(len(words(r.text)) for r in stages[3]) < sum(len(words(r.text)) for r in stages[2])


def test_mixing_stage(stages):
    size, taken = Counter(), Counter()
    for r in stages[3]:
        size[r.source] += len(words(r.text))
    for r in stages[4]:
        taken[r.source] += len(words(r.text))
    want = plain_targets(size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    by_id = {r.doc_id: Counter(words(r.text)) for r in stages[3]}
    held = {}
    for r in stages[4]:
        held.setdefault(r.doc_id, Counter()).update(words(r.text))
    assert all(n <= 2 * by_id[d][w] for d, c in held.items() for w, n in c.items())


def test_packing_stage(stages):
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == total
    bins = check_places([(r.sequence_id, r.offset, r.length) for r in stages[5]], 2048)
    assert bins <= 1.1 * total / 2048 + 1


def test_run_is_the_chain(spark, corpus_dir, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = P.run(spark, corpus_dir).select(*cols).collect()
    assert rows(got) == rows([tuple(r[c] for c in cols) for r in stages[5]])


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
