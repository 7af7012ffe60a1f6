"""Toxicity by Levenshtein automata over a lexicon trie, with context windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.llm.quality import labelled_sample
from tokenfold.session import settle

#: Labelled documents of each class that the lexicon and the weights are learnt from, and the longest lexicon.
ONES, ZEROS, TERMS = 2_000, 4_000, 2_000
#: Tokens on each side that make a context, and how much a quoted match counts.
WINDOW, QUOTED = 20, 0.25
#: Shortest term that may be misspelled, and the edits it may have.
LEAST_MISSPELLED, EDITS = 5, 1
LEAST_SHARE, LEAST_STEM, LEAST_FORMS = 0.9, 4, 4
_TOKEN = re.compile(r"[^\s.,;:/|?!()\[\]{}<>\"“”„«»]+|[\"“”„«»]")
_QUOTE = frozenset('"“”„«»')
_EDGE = "'’‘`*_-~#$%&@+=^"
_SPARK_TOKEN = r"([^\s.,;:/|?!()\[\]{}<>\"“”„«»]+)"


class Trie:
    """Lexicon terms; whole words match words, stems match beginnings of words."""

    def __init__(self, words: list[str], stems: list[str]):
        self.root: dict = {}
        for kind, terms in (("word", words), ("stem", stems)):
            for t in terms:
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[kind] = t if kind == "word" else t + "-"

    def matches(self, word: str) -> dict[str, int]:
        """Terms within reach of ``word`` and their edits.

        The states (letters read, edits made) of the word's Levenshtein automaton
        run along the branches of the trie; a branch ends when no state is left.
        """
        found: dict[str, int] = {}
        n = len(word)
        stack = [(self.root, 0, 0, 0)]
        seen = set()
        while stack:
            node, i, e, depth = stack.pop()
            if (id(node), i, e) in seen:
                continue
            seen.add((id(node), i, e))
            reach = EDITS if depth >= LEAST_MISSPELLED else 0
            for kind, rest in (("word", n - i), ("stem", 0)):
                term = node.get(kind)
                if term is not None and e + rest <= reach and e + rest < found.get(term, EDITS + 1):
                    found[term] = e + rest
            if i < n and (child := node.get(word[i])) is not None:
                stack.append((child, i + 1, e, depth + 1))
            if e < EDITS:
                if i < n:
                    stack.append((node, i + 1, e + 1, depth))
                for c, child in node.items():
                    if len(c) == 1:
                        stack.append((child, i, e + 1, depth + 1))
                        if i < n and c != word[i]:
                            stack.append((child, i + 1, e + 1, depth + 1))
        return found


@dataclass
class Lexicon:
    """Terms with the weight of an exact and of a misspelled match, and the coefficients of a document's score."""

    words: list[str]
    stems: list[str]
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)


class Matcher:
    """Finds weighted matches in texts; remembers tokens it has met, within a bound.

    One edit leaves the first or the second half of a term as it is: a token can
    match only if it starts like a term's first half or holds the start of a
    second half at most one place off. Only such tokens meet the trie.
    """

    def __init__(self, lexicon: Lexicon, kept: int = 200_000):
        self.lexicon, self.trie, self.kept = lexicon, Trie(lexicon.words, lexicon.stems), kept
        self.met: dict[str, tuple[str, int] | None] = {}
        terms = [*lexicon.words, *lexicon.stems]
        self.heads = {t[:2] for t in terms}
        tails: dict[int, set[str]] = {}
        for t in terms:
            if len(t) >= LEAST_MISSPELLED:
                half = len(t) // 2
                for at in (half - 1, half, half + 1):
                    tails.setdefault(at, set()).add(t[half:half + 3])
        self.tails = sorted(tails.items())

    def possible(self, token: str) -> bool:
        if token[:2] in self.heads:
            return True
        for at, held in self.tails:
            if token[at:at + 3] in held:
                return True
        return False

    def best(self, token: str) -> tuple[str, int] | None:
        """The term that ``token`` spells, with its edits: fewest edits, then the longest term."""
        try:
            return self.met[token]
        except KeyError:
            pass
        bare = token.strip(_EDGE)
        found = self.trie.matches(bare) if bare and self.possible(bare) else {}
        got = min(found.items(), key=lambda x: (x[1], -len(x[0]), x[0])) if found else None
        if len(self.met) >= self.kept:
            self.met.clear()
        self.met[token] = got
        return got

    def hits(self, text: str) -> tuple[int, list[tuple[int, str, int, bool]]]:
        """(tokens, matches as (position, term, edits, quoted)) of a whole text."""
        tokens = _TOKEN.findall(text.lower())
        spelled = {t: b for t in set(tokens) if (b := self.best(t)) is not None}
        if not spelled:
            return len(tokens), []
        out, opened, last = [], False, -1
        inside = np.zeros(len(tokens) + 1, np.int8)
        for i, t in enumerate(tokens):
            if t in _QUOTE:
                if opened and i - last <= 2 * WINDOW:
                    inside[last:i] = 1
                    opened = False
                else:
                    opened, last = True, i
        for i, t in enumerate(tokens):
            if t in spelled:
                out.append((i, *spelled[t], bool(inside[i])))
        return len(tokens), out

    def features(self, text: str) -> tuple[float, float]:
        """(heaviest context window, logarithm of the whole weight); quoted matches count in part."""
        _, found = self.hits(text)
        if not found:
            return 0.0, 0.0
        at = np.array([f[0] for f in found])
        weight = np.array([self.lexicon.weights.get((t, e), 0.0) * (QUOTED if quoted else 1.0) for _, t, e, quoted in found])
        total = np.concatenate([[0.0], np.cumsum(weight)])
        window = total[np.searchsorted(at, at + 2 * WINDOW, side="right")] - total[:-1]
        return float(max(0.0, window.max())), float(np.log1p(max(0.0, weight.sum())))

    def score(self, text: str) -> float:
        a, b, c = self.lexicon.coefficients
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a * min(x, 12.0) + b * y + c, -30, 30))))


def _telling(counted: DataFrame, base: float) -> DataFrame:
    """Terms with so many toxic groups that, were labels dealt by chance, less than half a term would be expected to have them."""
    sizes = {r["k"]: r["m"] for r in counted.groupBy(F.least("n", F.lit(50)).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
    need = next((k for k in range(3, 50) if sum(m * base**n for n, m in sizes.items() if n >= k) < 0.5), 50)
    return counted.where((F.col("ones") >= need) & (F.col("ones") >= LEAST_SHARE * F.col("n")))


def learn_terms(sample: DataFrame, terms: int = TERMS) -> tuple[list[str], list[str]]:
    """(words, stems) that stand almost only in labelled documents of a (doc_id, text, _label) sample.

    Copies of a document must not make its words a lexicon, so support counts
    groups of documents that share their smallest token hash, not documents. Words
    have any length; those under ``LEAST_STEM`` letters are tested apart and match
    exactly. A stem needs several words that go on from it, is as long as its
    documents allow, and takes these words' place.
    """
    token = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_SPARK_TOKEN))
    bare = F.transform(F.array_distinct(token), lambda t: F.regexp_replace(t, rf"^[{re.escape(_EDGE)}]+|[{re.escape(_EDGE)}]+$", ""))
    doc = sample.select("_label", F.array_distinct(F.filter(bare, lambda t: t != "")).alias("ts"))
    # nearly every document holds the same few short tokens: they only tell groups where there is no other
    least = [F.array_min(F.transform(ts, lambda t: F.xxhash64(t))) for ts in (F.filter("ts", lambda t: F.length(t) >= LEAST_STEM), F.col("ts"))]
    doc = doc.withColumn("g", F.coalesce(*least))
    held = doc.select("_label", "g", F.explode("ts").alias("t")).groupBy("t", "g").agg(F.max("_label").alias("one"))
    held = settle(held)
    base = held.groupBy("g").agg(F.max("one").alias("one")).agg(F.avg("one")).first()[0]
    support = [F.sum("one").alias("ones"), F.count(F.lit(1)).alias("n")]
    lengths = F.when(F.length("t") >= LEAST_STEM, F.sequence(F.lit(LEAST_STEM), F.least(F.length("t"), F.lit(8))))
    cuts = F.explode(F.transform(lengths, lambda k: F.substring(F.col("t"), F.lit(1), k)))
    words = settle(held.groupBy("t").agg(*support))
    forms = words.select(cuts.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("forms")).where(F.col("forms") >= LEAST_FORMS)
    cut = held.select("g", "one", cuts.alias("s")).groupBy("s", "g").agg(F.max("one").alias("one"))
    stems = settle(cut.groupBy("s").agg(*support).join(forms, "s"))
    kinds = (words.where(F.length("t") >= LEAST_STEM), words.where(F.length("t") < LEAST_STEM), stems)
    words, short, stems = (_telling(x, base).orderBy(F.desc("ones"), x.columns[0]).limit(terms).collect() for x in kinds)
    taken: list[str] = []
    for s in sorted((r["s"] for r in stems), key=lambda s: (len(s), s)):
        if not any(s.startswith(x) for x in taken):
            taken.append(s)
    seen = {r["s"]: r["ones"] for r in stems}
    for i, s in enumerate(taken):  # the longest stem that stands for the same documents
        while longer := [e for e in seen if len(e) == len(s) + 1 and e.startswith(s) and seen[e] >= 0.98 * seen[s]]:
            s = taken[i] = longer[0]
    return sorted(r["t"] for r in [*words, *short] if not any(r["t"].startswith(x) for x in taken)), taken


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", key: str = "doc_id", text: str = "text",
          ones: int = ONES, zeros: int = ZEROS) -> Lexicon:
    """Lexicon, match weights and score coefficients from a bounded sample of labelled rows."""
    sample = settle(labelled_sample(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels, label, usable, ones, zeros))
    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Lexicon([], [], {}, (0.0, 0.0, float(np.log(share / (1 - share)))))
    lexicon = Lexicon(*learn_terms(sample))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            out = [(own, t, e) for value, own in zip(b.column(0), b.column(1).to_pylist())
                   for t, e in {(t, e) for _, t, e, _ in matcher.hits(value.as_py() or "")[1]}]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.string(), pa.int32()))],
                                             names=["label", "term", "edits"])

    spread = sample.select("text", "_label")
    counted = spread.mapInArrow(seen, "label int, term string, edits int").groupBy("term", "edits").agg(
        F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")).collect()
    counts = {(r["term"], r["edits"]): (r["ones"], r["zeros"]) for r in counted}
    base = np.log((sizes[1] + 1) / (sizes[0] + 1))
    terms = [*lexicon.words, *[s + "-" for s in lexicon.stems]]
    for t in terms:
        for e in range(EDITS + 1):  # an unseen misspelling is four documents with one innocent among five
            one, zero = counts.get((t, e), (0, 0))
            lexicon.weights[t, e] = max(0.0, float(np.log((one + 3.2) / (zero + 0.8)) - base))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            x = [matcher.features(value.as_py() or "") for value in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array([f[i] for f in x], pa.float64()) for i in (0, 1)]], names=["label", "x", "y"])

    table = spread.mapInArrow(measured, "label int, x double, y double").orderBy("x", "y", "label").toArrow()  # as many rows as the sample
    y = table.column("label").to_numpy().astype(np.float64)
    design = np.stack([np.minimum(table.column("x").to_numpy(), 12.0), table.column("y").to_numpy(), np.ones(len(y))], axis=1)
    lexicon.coefficients = tuple(_logistic(design, y).tolist())
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; slopes are kept from going below zero."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of every whole text as column ``name``.

    Tokens are matched with the lexicon trie within the edits that a term
    allows, so misspelled terms count by what the labels say of them. Matches
    inside quotation marks count in part; the score rests on the heaviest window
    of 40 tokens and on the whole text. Defined cases: null and empty texts have
    no match; equal texts score alike; an empty table gives no rows.
    """
    nth = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([matcher.score(x.as_py() or "") for x in b.column(nth)], pa.float64())],
                                             names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
