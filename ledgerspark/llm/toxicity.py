"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over the words and word beginnings that tell the labels of a
bounded sample apart; all other words share one coordinate, so that the share of telling
words in a text counts. The nearest examples by cosine are found exactly in an inverted
index with the greatest weight of each term in each block of examples: blocks are visited
in order of their bounds until none can hold a nearer example. The examples found vote
with their distance, and votes are calibrated on the examples themselves, each judged
without its own label.

The sample (``max_examples``) and the terms (``max_terms``) are bounds of the fitted model
alone; it is small enough to be broadcast at any size of the input. Every text is read
whole."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import with_text_struct

#: Labelled rows that a model is fitted on, and terms that it keeps, at most.
MAX_EXAMPLES, MAX_TERMS = 12_000, 512
#: Chi-square of a term and the label from which it is telling, and the examples that
#: must have it.
TELLING, LEAST_EXAMPLES = 30.0, 3
#: Lengths of word beginnings.
SHORTEST, LONGEST = 3, 8
#: Weight of one other word, and what is added to distances before votes are weighed.
REST_WEIGHT, NEAR = 0.02, 0.05
NEIGHBOURS, BLOCK, THRESHOLD = 15, 64, 0.3
#: A broadcast model's bytes at most: every example with every term, and the tables of bounds.
MODEL_BYTES = 1 << 28

_WORD = re.compile(r"[^\x00-@\[-`{-\x7f]+")
_EVIDENCE = T.ArrayType(
    T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("toxic_share", T.DoubleType(), False),
        T.StructField("cosine", T.DoubleType(), False),
    ]),
    False,
)
_FIELDS = T.StructType([
    T.StructField("score", T.DoubleType(), False),
    T.StructField("predicted", T.IntegerType(), False),
    T.StructField("evidence", _EVIDENCE, False),
])


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    """Terms of a word: its beginnings, and the whole word with a space behind it."""
    return [word[:k] for k in range(SHORTEST, min(len(word) - 1, LONGEST) + 1)] + [word + " "]


class Terms:
    """Counts of telling terms in texts."""

    def __init__(self, terms: list[str]):
        self.ids = {t: k for k, t in enumerate(terms)}
        self.heads = {t.rstrip(" ")[:SHORTEST] for t in terms}

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Telling terms with their numbers, and the number of all words."""
        all_words = words(text)
        found: dict[int, int] = {}
        for word, n in Counter(all_words).items():
            if word[:SHORTEST] in self.heads:
                for term in beginnings(word):
                    if (k := self.ids.get(term)) is not None:
                        found[k] = found.get(k, 0) + n
        return found, len(all_words)


class BlockMaxIndex:
    """Unit vectors by id, found by cosine. ``vectors`` is a list of (terms, weights)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, int)
        weights = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        owners = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((owners, terms))
        self.owners, self.weights, terms = owners[order], weights[order], terms[order]
        cells = terms * max(self.blocks, 1) + self.owners // block
        self.bounds = np.zeros((n_terms, max(self.blocks, 1)))
        np.maximum.at(self.bounds.reshape(-1), cells, self.weights)
        self.at = np.searchsorted(cells, np.arange(n_terms * max(self.blocks, 1) + 1))
        self.visited = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k greatest (cosine, vector) in order, equal ones by their number."""
        best: list[tuple[float, int]] = []
        if not self.n:
            return best
        bounds = weights @ self.bounds[terms]
        for b in np.argsort(-bounds, kind="stable"):
            if len(best) == k and bounds[b] < -best[-1][0] - 1e-9:
                break
            self.visited += 1
            first, held = b * self.block, np.zeros(min(self.block, self.n - b * self.block))
            for t, w in zip(terms, weights, strict=True):
                start, end = self.at[t * self.blocks + b], self.at[t * self.blocks + b + 1]
                held[self.owners[start:end] - first] += w * self.weights[start:end]
            held = np.round(held, 12)
            least = -best[-1][0] if len(best) == k else -1.0
            found = [(-float(held[i]), first + int(i)) for i in np.flatnonzero(held >= least) if first + i != skip]
            best = sorted(best + found)[:k]
        return [(-c, v) for c, v in best]


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    index: BlockMaxIndex
    counts: np.ndarray
    toxic: np.ndarray
    firsts: np.ndarray
    votes: np.ndarray
    shares: np.ndarray
    neighbours: int

    def vector(self, found: dict[int, int], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector; the last coordinate is that of all words. A text without words
        has that coordinate alone."""
        ids = np.array([*sorted(found), len(self.idf)], int)
        weights = np.array([found[k] * self.idf[k] for k in ids[:-1]] + [REST_WEIGHT * max(n_words, 1)])
        return ids, weights / math.sqrt(weights @ weights)

    def neighbourhood(self, found: dict[int, int], n_words: int) -> list[tuple[float, int]]:
        return self.index.nearest(*self.vector(found, n_words), self.neighbours)

    def vote(self, near: list[tuple[float, int]], own: int = -1, own_label: int = 0) -> float:
        """The toxic share of the near examples, weighed by distance. ``own`` is a vector
        that one example of label ``own_label`` is left out of."""
        top = low = 0.0
        for cosine, v in near:
            n, toxic = int(self.counts[v]), int(self.toxic[v])
            if v == own:
                n, toxic = n - 1, toxic - own_label
            if n:
                weight = 1 / (NEAR + math.sqrt(max(0.0, 2 - 2 * cosine)))
                top, low = top + weight * toxic / n, low + weight
        return top / low if low else 0.0

    def score(self, vote: float) -> float:
        """The calibrated chance of the label; grows with the vote throughout."""
        if not len(self.votes):
            return 0.0
        return float(0.999 * np.interp(vote, self.votes, self.shares) + 0.001 * vote)


def usable(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of the doc_id as text modulo 4 isn't 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the numbers of toxic and other examples that have them."""
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else other).update({t for w in set(words(text)) for t in beginnings(w)})
        names = list(toxic | other)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([other[t] for t in names], pa.int64())],
            names=["term", "toxic", "other"],
        )


def telling_terms(examples: DataFrame, n_toxic: int, n_other: int, max_terms: int) -> list[tuple[str, int]]:
    """Terms whose presence goes with the toxic label, with the examples that have them.
    A beginning that is never found without one longer telling term is that term again,
    and left out."""
    counted = examples.mapInArrow(_term_counts, "term string, toxic long, other long").groupBy("term")
    c = counted.agg(F.sum("toxic").cast("double").alias("a"), F.sum("other").cast("double").alias("b"))
    n = float(n_toxic + n_other)
    have, cross = F.col("a") + F.col("b"), F.col("a") * n_other - F.col("b") * n_toxic
    chi = n * cross * cross / (F.lit(float(n_toxic * n_other)) * have * (n - have))
    found = c.where((have >= LEAST_EXAMPLES) & (have < n) & (cross > 0)).withColumn("chi", chi).where(F.col("chi") >= TELLING)
    rows = found.orderBy(F.desc("chi"), "term").limit(max_terms).collect()
    df = {r.term: (int(r.a), int(r.b)) for r in rows}
    again = {t[:k] for t in df for k in range(SHORTEST, len(t)) if df.get(t[:k]) == df[t]}
    return [(t, sum(df[t])) for t in sorted(df) if t not in again]


def fit(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, neighbours: int = NEIGHBOURS) -> Model:
    """A model of labels (doc_id, toxic) on documents (doc_id, text), fitted on at most
    ``max_examples`` labelled rows that ``usable`` allows, chosen by a hash of their ids.

    Null labels and ids are left out; a doc_id with several labels is toxic if one says
    so. Without examples of both labels no text is toxic."""
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = documents.select("doc_id", "text")
    examples = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).persist()
    n = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    terms = telling_terms(examples, n_toxic, n_other, max_terms) if n_toxic and n_other else []
    book = Terms([t for t, _ in terms])

    def found(batches):
        for batch in batches:
            counts = [book.counts(t) for t in batch.column("text").to_pylist()]
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            columns = [[sorted(c) for c, _ in counts], [[c[k] for k in sorted(c)] for c, _ in counts], [w for _, w in counts]]
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *arrays], names=["doc_id", "toxic", "ids", "counts", "n_words"])

    schema = "doc_id long, toxic int, ids array<int>, counts array<int>, n_words long"
    rows = examples.mapInArrow(found, schema).collect() if terms else []
    examples.unpersist()
    idf = np.array([math.log((1 + n_toxic + n_other) / (1 + have)) for _, have in terms])
    return _built(spark, book, idf, rows, neighbours)


def _built(spark, book: Terms, idf: np.ndarray, rows: list, neighbours: int) -> Model:
    """Equal directions are one vector with its numbers of examples; vectors that share
    their heaviest term lie together, so that bounds of blocks are tight."""
    held: dict[tuple, list] = {}
    for r in rows:
        whole = math.gcd(r.n_words, *r.counts) or 1
        key = (tuple(r.ids), tuple(c // whole for c in r.counts), r.n_words // whole if r.ids else 1)
        held.setdefault(key, []).append((r.doc_id, r.toxic))
    model = Model(book, idf, None, None, None, None, np.empty(0), np.empty(0), neighbours)
    vectors = []
    for (ids, counts, n_words), members in held.items():
        vectors.append((*model.vector(dict(zip(ids, counts, strict=True)), n_words), members))
    vectors.sort(key=lambda v: (int(v[0][np.argmax(v[1])]), -float(v[1].max()), min(v[2])))
    model.index = BlockMaxIndex([(t, w) for t, w, _ in vectors], len(idf) + 1)
    model.counts = np.array([len(m) for _, _, m in vectors], int)
    model.toxic = np.array([sum(x for _, x in m) for _, _, m in vectors], int)
    model.firsts = np.array([min(m)[0] for _, _, m in vectors], int)
    if not vectors:
        return model
    shared = shipped(spark, model)

    def judged(batches):
        own = shared.value
        for batch in batches:
            votes, toxic, other = [], [], []
            for v in batch.column(0).to_pylist():
                near = own.index.nearest(*_row(own.index, v), neighbours + 1)
                for label, n in ((1, int(own.toxic[v])), (0, int(own.counts[v] - own.toxic[v]))):
                    if n:
                        votes.append(round(own.vote(_without(own, near, v, neighbours), v, label), 3))
                        toxic.append(n * label)
                        other.append(n * (1 - label))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())], names=["vote", "toxic", "other"])

    ways = spark.range(0, len(vectors), 1, min(32, -(-len(vectors) // 64))).mapInArrow(judged, "vote double, toxic long, other long")
    bins = ways.groupBy("vote").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).orderBy("vote").collect()
    model.votes, model.shares = calibrated([(r.vote, r.toxic, r.toxic + r.other) for r in bins])
    shared.unpersist()
    return model


def _row(index: BlockMaxIndex, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector number v."""
    at = np.flatnonzero(index.owners == v)
    return np.searchsorted(index.at[:: index.blocks], at, side="right") - 1, index.weights[at]


def _without(model: Model, near: list, v: int, k: int) -> list:
    """k neighbours of an example of vector v; v counts if other examples share it."""
    return [x for x in near if x[1] != v or model.counts[v] > 1][:k]


def calibrated(bins: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Votes and chances that never fall as votes grow: neighbouring bins (vote, toxic,
    all) are pooled until shares rise; one example of the overall share joins each pool."""
    total = sum(n for _, _, n in bins)
    share = sum(t for _, t, _ in bins) / total
    pools: list[list[float]] = []
    for vote, toxic, n in bins:
        pools.append([vote * n, toxic, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    shares = np.maximum.accumulate([(t + share) / (n + 1) for _, t, n in pools])
    return np.array([v / n for v, _, n in pools]), shares


def shipped(spark, model: Model):
    """The model as a broadcast, within MODEL_BYTES."""
    size = len(pickle.dumps(model))
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes: fit it with fewer examples or terms")
    return spark.sparkContext.broadcast(model)


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity", evidence: int = 3) -> DataFrame:
    """df with struct ``out``: score (0 to 1), predicted (score of at least THRESHOLD) and
    the nearest examples, at most ``evidence``: the least doc_id of an example, the toxic
    share of the examples at its place, and the cosine.

    Null and empty texts are scored as texts without telling words, as are long ones that
    have none; repeated rows are scored alike; equally near examples count in the order of
    the index. An empty table gives no rows; an existing column named ``out`` is replaced."""
    shared = shipped(df.sparkSession, model)

    def make():
        own = shared.value
        memory: dict[tuple, tuple] = {}

        def judge(text):
            found, n_words = own.terms.counts(text)
            key = (1, ()) if not found else (n_words, tuple(sorted(found.items())))
            if key not in memory:
                if len(memory) >= 4096:
                    memory.clear()
                near = own.neighbourhood(found, n_words)
                value = own.score(own.vote(near))
                seen = [{"doc_id": int(own.firsts[v]), "toxic_share": own.toxic[v] / own.counts[v], "cosine": c} for c, v in near[:evidence]]
                memory[key] = (value, int(value >= THRESHOLD), seen)
            return memory[key]

        return judge

    return with_text_struct(df, text_col, out, _FIELDS, make)
