"""Quality scores: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import stored

#: Statistics of a text in the order of their numbers; shares are of characters, words or lines.
STATISTICS = (
    "log_chars", "log_words", "log_word_length", "word_length_spread", "lower_share", "upper_share", "digit_share", "space_share", "line_end_share", "stop_share", "shout_share",
    "comma_share", "symbol_share", "other_share", "upper_words", "distinct_words", "top_word_share", "short_words", "repeated_triples", "repeated_lines", "log_line_length", "compressed_share",
)
#: Steps of one unit of a statistic or a feature: sums of whole steps are exact, so reruns give the same model.
STEPS = 4096
#: Rounded raw scores that the calibration tells apart, per unit, and how far below 0 and above 1 they go.
BINS, BEYOND = 1024, 1.0

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _SHOUT, _COMMA, _SYMBOL, _OTHER = range(10)


@dataclass(frozen=True)
class Settings:
    """``features`` random cosines; ``width`` of the kernel in units of the square root of the number of statistics; ``ridge`` per
    labelled row; ``folds`` of the out-of-fold scores that the calibration is fitted on."""

    features: int = 256
    width: float = 1.0
    ridge: float = 1e-3
    folds: int = 4
    seed: int = 12
    threshold: float = 0.3


def held_out(id_column: str) -> Column:
    """Rows whose labels may not be learned from: crc32 of the id's decimal text is 0 modulo 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 2^16; the last entry stands for all above."""

    def of(c: str) -> int:
        for letters, kind in (("\n", _LINE), (".?;:", _STOP), ("!", _SHOUT), (",'\"()-", _COMMA)):
            if c in letters:
                return kind
        kind = unicodedata.category(c)
        return _SPACE if c.isspace() else _DIGIT if kind[0] == "N" else _UPPER if kind == "Lu" else _LOWER if kind[0] in "LM" else _SYMBOL if kind[0] in "PS" else _OTHER

    return np.array([of(chr(i)) for i in range(1 << 16)] + [_OTHER], np.uint8)


def text_statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; a null text counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(points))
    kinds = np.bincount(_classes()[np.minimum(points, 1 << 16)], minlength=10) / n
    words = text.split()
    many = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    known: dict[str, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    top = int(np.bincount(codes).max()) if words else 0
    triples = (codes[:-2] * len(known) + codes[1:-1]) * len(known) + codes[2:] if len(words) > 2 else np.zeros(0, np.int64)
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        float(np.log1p(len(points))), float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        kinds[_LOWER], kinds[_UPPER], kinds[_DIGIT], kinds[_SPACE], np.sqrt(kinds[_LINE]), np.sqrt(kinds[_STOP]), np.sqrt(kinds[_SHOUT]), np.sqrt(kinds[_COMMA]), np.sqrt(kinds[_SYMBOL]), np.sqrt(kinds[_OTHER]),
        sum(map(str.isupper, words)) / many, len(known) / many, top / many, float((lengths <= 3).sum()) / many if words else 0.0,
        1.0 - len(np.unique(triples)) / max(1, len(triples)), 1.0 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(points) / max(1, len(lines)))), len(zlib.compress(data, 1)) / (len(data) + 20),
    ]


def statistics_table(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, stats`` per row: statistics in whole steps."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_statistics(t.as_py()) for t in batch["text"]]).reshape(-1, len(STATISTICS))
            values = np.rint(found * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "stats": pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS)).cast(pa.list_(pa.int32()))})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(measure, "doc_id long, stats array<int>")


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["stats"].flatten()).reshape(batch.num_rows, len(STATISTICS)) / STEPS


class FourierMap:
    """Standardised statistics to ``features`` cosines of random directions, whose products average to a Gaussian kernel, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, settings: Settings) -> None:
        rng = np.random.default_rng(settings.seed)
        self.mean, self.spread = mean, np.maximum(spread, 4 / STEPS)
        self.directions = rng.normal(size=(len(mean), settings.features)) / (settings.width * np.sqrt(len(mean)))
        self.shifts = rng.uniform(0, 2 * np.pi, settings.features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Features in whole steps, as floats that hold them exactly; statistics over six spreads out count as six."""
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.rint(np.cos(x @ self.directions + self.shifts) * STEPS), np.full((len(x), 1), float(STEPS))], 1)


def pooled(bins: np.ndarray, good: np.ndarray, rows: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: raw score and label share of each pool, ascending, drawn a little to the prior."""
    pools: list[list[float]] = []
    for x, g, n in zip(bins.tolist(), good.tolist(), rows.tolist()):
        pools.append([g, n, x * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    share = np.array([(g + prior) / (n + 1.0) for g, n, _ in pools])
    return np.array([s / n for _, n, s in pools]), np.maximum.accumulate(share)


@dataclass
class QualityModel:
    """The feature map, ridge weights and calibration knots; without labels of both kinds the prior alone."""

    features: FourierMap
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        raw = raw_scores(self.features(stats), self.weights)
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def raw_scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(features @ weights * BINS) / BINS, -BEYOND, 1 + BEYOND)


def normal_sums(labelled: DataFrame, features: FourierMap, settings: Settings) -> np.ndarray:
    """Exact sums of products of features, and of features with the label, per fold: ``[fold, i, j]``, the label last."""
    size = settings.features + 2
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((settings.folds, size, size), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                part = batch.slice(low, 8192)
                rows = np.concatenate([features(stats_of(part)), np.asarray(part["good"]).astype(float)[:, None]], 1)
                fold = np.asarray(part["fold"])
                for f in np.unique(fold):
                    some = rows[fold == f]
                    sums[f] += np.rint(some.T @ some).astype(np.int64)
        for f in range(settings.folds):
            if sums[f].any():
                yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(upper[0]), f, np.int32)), "cell": pa.array(np.arange(len(upper[0]), dtype=np.int32)), "value": pa.array(sums[f][upper])})

    found = labelled.mapInArrow(add, "fold int, cell int, value long").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((settings.folds, size, size))
    cell, fold = np.asarray(found["cell"]), np.asarray(found["fold"])
    out[fold, upper[0][cell], upper[1][cell]] = out[fold, upper[1][cell], upper[0][cell]] = np.asarray(found["value"])
    return out


def ridge_weights(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of features in steps that least-squares predict the label; the constant, last of the features, is not shrunk."""
    rows = sums[-2, -2] / STEPS**2
    gram = sums[:-1, :-1].copy()
    gram[np.diag_indices(len(gram) - 1)] += ridge * max(rows, 1.0) * STEPS**2
    gram[-1, -1] += STEPS**2 * 1e-9
    return np.linalg.solve(gram, sums[:-1, -1])


def fit_quality(table: DataFrame, labels: DataFrame, id_column: str, label_column: str, settings: Settings) -> QualityModel:
    """Fits on every labelled row that is not held out. A null label teaches nothing; of several labels of one id the largest counts."""
    exact = lambda x: F.sum(x.cast("decimal(20,0)")).alias
    slots = range(len(STATISTICS))
    value = lambda i: F.get("stats", F.lit(i)).cast("long")
    moments = table.agg(F.count("*").alias("n"), *[exact(value(i))(f"s{i}") for i in slots], *[exact(value(i) * value(i))(f"q{i}") for i in slots]).first()
    n = max(1, moments["n"])
    mean = np.array([float(moments[f"s{i}"] or 0) / n for i in slots])
    spread = np.sqrt(np.maximum(0.0, np.array([float(moments[f"q{i}"] or 0) / n for i in slots]) - mean**2))
    features = FourierMap(mean / STEPS, spread / STEPS, settings)

    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).cast("long").alias("__id")).agg(F.max((F.col(label_column) > 0).cast("int")).alias("good"))
    labelled = table.join(known, F.col("doc_id") == F.col("__id")).select("stats", "good", F.pmod(F.xxhash64("doc_id"), F.lit(settings.folds)).cast("int").alias("fold"))
    labelled = stored(labelled, "kernel-labelled")
    sums = normal_sums(labelled, features, settings)
    total = sums.sum(0)
    rows, good = round(total[-2, -2] / STEPS**2), round(total[-1, -1])
    prior = (good + 1) / (rows + 2)
    if good in (0, rows):
        return QualityModel(features, None, (np.zeros(1), np.zeros(1)), prior)
    weights = ridge_weights(total, settings.ridge)
    folds = [ridge_weights(total - own, settings.ridge) for own in sums]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch["fold"])
            found = features(stats_of(batch))
            raw = np.zeros(batch.num_rows)
            for f in np.unique(fold):
                raw[fold == f] = raw_scores(found[fold == f], folds[f])
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.rint(raw * BINS).astype(np.int32)), "good": batch["good"]})

    bins = labelled.mapInArrow(tally, "bin int, good int").groupBy("bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).orderBy("bin").toArrow()
    knots = pooled(np.asarray(bins["bin"]) / BINS, np.asarray(bins["good"]), np.asarray(bins["n"]), prior)
    return QualityModel(features, weights, knots, prior)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per input row; nothing but the text's statistics enters a score.

    Whole texts are measured once; the narrow table of statistics is what is fitted and scored. All labelled rows that are
    not held out teach: a task passes on sums alone, whose number follows from ``settings``. Null texts score as empty ones.
    Without labelled rows of both kinds every score is the prior. Rows of a null id are scored and teach nothing; repeated
    rows score alike and teach each; no rows give no rows.
    """
    table = stored(statistics_table(docs, id_column, text_column), "kernel-statistics")
    model = fit_quality(table, labels, id_column, label_column, settings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(model.scores(stats_of(batch)), pa.float64())})

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
