"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import stored

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a longer word that also count as a term of their own, so that forms of one stem support each other.
STEM = 4


@dataclass
class Settings:
    """Bounds and smoothing of the scorer.

    ``examples`` bounds the sample of labelled rows the index is fitted on, ``terms`` the words it indexes. A word is indexed
    if its share among toxic examples differs from that among the others by ``min_z`` standard errors and ``min_lift`` times,
    and the larger share is at least ``min_share``, lest the words of one text and its copies count as signs.
    """

    examples: int = 20_000
    terms: int = 2_048
    min_z: float = 6.0
    min_lift: float = 8.0
    min_share: float = 0.03
    neighbours: int = 15
    block: int = 64
    prior_votes: float = 1.0
    threshold: float = 0.3


def held_out(id_column: str) -> Column:
    """Rows whose labels may not be learned from: crc32 of the id's decimal text is 2 modulo 4; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(text: str | None) -> Counter:
    """Lower-case words and, marked by a hyphen, the stems of longer ones."""
    words = WORD.findall((text or "").lower())
    counts = Counter(words)
    counts.update(w[:STEM] + "-" for w in words if len(w) > STEM)
    return counts


def counts_within(text: str | None, known: Collection[str]) -> Counter:
    """``term_counts`` of the terms in ``known`` alone."""
    words = WORD.findall((text or "").lower())
    counts = Counter([w for w in words if w in known])
    counts.update([s for s in [w[:STEM] + "-" for w in words if len(w) > STEM] if s in known])
    return counts


class BlockMaxIndex:
    """Distinct unit vectors in blocks; a term's posting list keeps the largest weight per block, which bounds a block's best cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int) -> None:
        self.count, self.terms = len(vectors), terms
        self.blocks = -(-max(self.count, 1) // block)
        rows = np.repeat(np.arange(self.count), [len(t) for t, _ in vectors]) if vectors else np.zeros(0, int)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, int)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((rows, term))
        self.rows, self.weights = rows[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        place = self.rows // block
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (term[order][1:] != term[order][:-1])]) if len(rows) else np.zeros(0, int)
        self.block_of, self.block_start = place[starts], np.r_[starts, len(rows)]
        self.block_max = np.maximum.reduceat(self.weights, starts) if len(rows) else np.zeros(0)
        self.block_first = np.searchsorted(term[order][starts], np.arange(terms + 1)) if len(rows) else np.zeros(terms + 1, int)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` vectors of highest positive cosine, ties to the smaller number; blocks that cannot reach them are not opened."""
        bound = np.zeros(self.blocks)
        for t, w in zip(terms, weights):
            span = slice(self.block_first[t], self.block_first[t + 1])
            bound[self.block_of[span]] += w * self.block_max[span]
        candidates = np.flatnonzero(bound)
        candidates = candidates[np.argsort(-bound[candidates], kind="stable")]
        found, scores = np.zeros(0, int), np.zeros(0)
        for step in range(0, len(candidates), 16):
            opened = candidates[step : step + 16]
            if len(scores) >= k and bound[opened[0]] < scores[k - 1] - 1e-12:
                break
            cells = np.sort(opened)
            score: dict[int, float] = {}
            for t, w in zip(terms, weights):
                low, high = self.block_first[t], self.block_first[t + 1]
                hit = low + np.flatnonzero(np.isin(self.block_of[low:high], cells, assume_unique=True))
                for j in hit:
                    part = slice(self.block_start[j], self.block_start[j + 1])
                    for r, v in zip(self.rows[part].tolist(), self.weights[part].tolist()):
                        score[r] = score.get(r, 0.0) + w * v
            found = np.r_[found, np.fromiter(score.keys(), int, len(score))]
            scores = np.round(np.r_[scores, np.fromiter(score.values(), float, len(score))], 12)
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
        return found, scores


class ToxicityModel:
    """Indexed examples with vote counts, and a monotone map from raw votes to probabilities."""

    def __init__(self, idf: dict[str, float], examples: Iterable[tuple[int | None, list[str], list[int], int]], settings: Settings) -> None:
        self.settings = settings
        self.number = {term: i for i, term in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in self.number]) if idf else np.zeros(0)
        groups: dict[tuple, list] = {}
        rows = []
        for doc_id, terms, counts, toxic in examples:
            key = self.key(dict(zip(terms, counts)))
            entry = groups.setdefault(key, [0, 0, doc_id])
            entry[0] += 1
            entry[1] += toxic
            entry[2] = doc_id if entry[2] is None else min(entry[2], doc_id if doc_id is not None else entry[2])
            rows.append((key, toxic))
        blank = groups.pop((), [0, 0, None])
        keys = sorted(groups)
        self.votes = np.array([groups[k][0] for k in keys], float)
        self.toxic = np.array([groups[k][1] for k in keys], float)
        self.ids = [groups[k][2] for k in keys]
        self.place = {k: i for i, k in enumerate(keys)}
        self.index = BlockMaxIndex([self.vector(k) for k in keys], len(self.number), settings.block)
        total = self.votes.sum() + blank[0]
        self.prior = float((self.toxic.sum() + blank[1] + 1) / (total + 2))
        self.blank = blank
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.memory: dict[tuple, tuple[float, list]] = {}
        self.calibrate(rows)

    def key(self, counts: dict[str, int]) -> tuple:
        return tuple(sorted((self.number[t], n) for t, n in counts.items() if t in self.number))

    def vector(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array([t for t, _ in key], int)
        weights = (1.0 + np.log([n for _, n in key])) * self.idf[terms]
        return terms, weights / np.sqrt((weights**2).sum())

    def neighbours(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        return self.index.search(*self.vector(key), self.settings.neighbours)

    def vote(self, found: np.ndarray, cosine: np.ndarray, own: tuple[int, int] | None = None) -> float:
        """Toxic share of the votes, a vote weighing the inverse of its distance; ``own`` takes one example's vote out."""
        votes, toxic = self.votes[found].copy(), self.toxic[found].copy()
        if own is not None:
            at = np.flatnonzero(found == own[0])
            votes[at] -= 1
            toxic[at] -= own[1]
        weight = 1.0 / (0.05 + np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine)))
        return float(((weight * toxic).sum() + self.settings.prior_votes * self.prior) / ((weight * votes).sum() + self.settings.prior_votes))

    def blank_vote(self, own: int | None = None) -> float:
        n, toxic = self.blank[0] - (own is not None), self.blank[1] - (own or 0)
        return float((toxic + self.settings.prior_votes * self.prior) / (n + self.settings.prior_votes))

    def calibrate(self, rows: list[tuple[tuple, int]]) -> None:
        """Monotone fit (pool adjacent violators) of the labels on each example's vote without its own label."""
        if not rows:
            return
        searched = {key: self.neighbours(key) for key in self.place}
        tally: dict[float, list[float]] = {}
        for key, toxic in rows:
            raw = round(self.blank_vote(toxic) if key == () else self.vote(*searched[key], own=(self.place[key], toxic)), 6)
            cell = tally.setdefault(raw, [0.0, 0.0])
            cell[0] += toxic
            cell[1] += 1
        pools: list[list[float]] = []
        for raw in sorted(tally):
            toxic, n = tally[raw]
            pools.append([toxic, n, raw * n])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.knots = (np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5 * self.prior) / (p[1] + 0.5) for p in pools]))

    def score(self, counts: dict[str, int]) -> tuple[float, list]:
        key = self.key(counts)
        if key not in self.memory:
            if len(self.memory) >= 100_000:
                self.memory.clear()
            found, cosine = self.neighbours(key) if key else (np.zeros(0, int), np.zeros(0))
            raw = self.vote(found, cosine) if len(found) else self.blank_vote()
            calibrated = float(np.interp(raw, *self.knots))
            self.memory[key] = (min(1.0, max(0.0, 0.98 * calibrated + 0.02 * raw)), [self.ids[i] for i in found[:3]])
        return self.memory[key]


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples per term and label in each task; flushed before the tally of a task grows large."""
    tally: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in tally], pa.string()), "toxic": pa.array([x for _, x in tally], pa.int32()), "n": pa.array(tally.values(), pa.int64())})
        tally.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            tally.update((term, int(toxic)) for term in term_counts(text))
            if len(tally) > 1_000_000:
                yield flush()
    yield flush()


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", settings: Settings = Settings()) -> ToxicityModel:
    """Fits the scorer on a bounded sample of labelled rows that are not held out.

    The sample is the ``settings.examples`` labelled ids of smallest hash. Document frequencies of the indexed words are
    counted over all documents. A label that is null teaches nothing; of several labels of one id the largest counts. Ids are
    taken to be unique; a repeated one brings an example for each of its rows.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    sample = known.groupBy(F.col(id_column).alias("__id")).agg(F.max(F.col(label_column).cast("int")).alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(settings.examples)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    examples = stored(texts.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic"), "toxicity-examples")

    sizes = {row["toxic"]: row["n"] for row in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return ToxicityModel({}, [(None, [], [], int(t)) for t, n in sizes.items() for _ in range(n)], settings)
    per_term = examples.mapInArrow(_example_terms, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    share, p_bad, p_good = (F.col("bad") + F.col("good")) / float(bad + good), F.col("bad") / float(bad), F.col("good") / float(good)
    z = F.abs(p_bad - p_good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    lift = F.greatest((p_bad + 0.5 / bad) / (p_good + 0.5 / good), (p_good + 0.5 / good) / (p_bad + 0.5 / bad))
    chosen = per_term.where((z >= settings.min_z) & (lift >= settings.min_lift) & (F.greatest(p_bad, p_good) >= settings.min_share)).orderBy(z.desc(), "term").limit(settings.terms)
    vocabulary = {row["term"] for row in chosen.select("term").collect()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                tally.update(counts_within(text, vocabulary).keys())
                tally[""] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(tally), pa.string()), "n": pa.array(list(tally.values()), pa.int64())})

    counted = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rows = counted.pop("", 0)
    idf = {term: float(np.log(1.0 + rows / n)) for term, n in counted.items()}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(counts_within(text, vocabulary).items()) for text in batch["text"].to_pylist()]
            terms, counts = pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "terms": terms, "counts": counts, "toxic": batch["toxic"]})

    kept = examples.mapInArrow(vectors, "doc_id long, terms array<string>, counts array<int>, toxic int").collect()
    return ToxicityModel(idf, ((r["doc_id"], r["terms"], r["counts"], r["toxic"]) for r in kept), settings)


def toxicity_column(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> Column:
    """``struct(score, evidence)`` of a text: the calibrated probability and the ids of the three nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, evidence array<long>")
    def score(texts: pa.Array) -> pa.Array:
        scorer = shared.value
        out = [scorer.score(counts_within(text, scorer.number)) for text in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["score", "evidence"])

    return score(F.col(text_column))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` per input row; nothing but the text enters a score.

    Null, empty and wordless texts, and texts without any indexed word, get the toxic share among such examples. Without
    labelled rows of both kinds every score is that of the prior. Repeated rows score alike; no rows give no rows.
    """
    model = fit_toxicity(docs, labels, id_column, text_column, settings=settings)
    scored = docs.select(F.col(id_column).alias("doc_id"), toxicity_column(docs, model, text_column).alias("__s"))
    score = F.col("__s.score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= settings.threshold).cast("int").alias("predicted"), F.col("__s.evidence").alias("evidence"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The input rows whose score is below the threshold, with their own columns."""
    model = fit_toxicity(docs, labels, id_column, text_column, settings=settings)
    return docs.where(toxicity_column(docs, model, text_column)["score"] < settings.threshold)
