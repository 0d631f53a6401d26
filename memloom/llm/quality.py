"""Quality rules: whole-text statistics, base thresholds, and robust outliers by minimum covariance determinant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import stored

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Bits of a word's place in a packed window; an array of more strings than this exceeds what one row can hold.
PLACE_BITS = 27


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in text order; none for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit([]).cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found at least twice in the same text.

    A window is packed into one number, hash above place; after sorting, equal windows are neighbours, and the words
    themselves confirm what the hash says.
    """

    def covered(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        packed = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.shiftleft(window(i), PLACE_BITS).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), among)

    def place(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def same(a: Column, b: Column) -> Column:
        equal = F.lit(True)
        for k in range(3):
            equal = equal & (F.get(words, place(a) + k) == F.get(words, place(b) + k))
        return F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), equal).otherwise(False)

    def among(entries: Column) -> Column:
        twin = F.filter(entries, lambda e, j: same(e, F.coalesce(F.get(entries, j + 1), -1 - e)) | same(e, F.coalesce(F.get(entries, j - 1), -1 - e)))
        return let(F.sort_array(F.transform(twin, place)), lambda starts: F.when(F.size(starts) == 0, F.lit(0)).otherwise(spread(starts)))

    def spread(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")), lambda acc: acc["n"])

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), covered)).cast("long")


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` per document, over whole texts."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    bare_length = lambda drop: F.char_length(F.translate(text, drop, ""))
    row = let(words_of(F.col(text_column)), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words")))
    counted = docs.select(
        F.col(id_column).alias("doc_id"), *[F.col(c) for c in keep], row.alias("__words"),
        bare_length(SPACE).cast("long").alias("word_chars"), (F.char_length(text) - bare_length(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
    )
    return counted.select("doc_id", *keep, F.col("__words.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__words.n_repeat_words").alias("n_repeat_words"))


#: Steps of one unit in a transformed statistic; sums of whole steps are exact, so reruns give the same estimates.
STEPS = 256
#: Transformed statistics and the least standard deviation each is given: most texts have no symbol and no repeated line,
#: so their raw spread is 0 and any single one would be infinitely far out.
FEATURES: dict[str, tuple[Callable[[], Column], float]] = {
    "log_words": (lambda: F.log(F.col("n_words") + 1.0), 0.3),
    "log_word_length": (lambda: F.log(F.col("word_chars") / F.col("n_words")), 0.1),
    "log_symbols": (lambda: F.log(1.0 + 100.0 * F.col("n_symbols") / F.col("word_chars")), 0.2),
    "log_dup_lines": (lambda: F.log(F.col("n_dup_lines") + 1.0), 0.7),
    "repeat_share": (lambda: F.col("n_repeat_words") / F.col("n_words"), 0.15),
}
#: Share of a cell's rows that the estimate is made of, and how much the covariance of the inner three quarters of a normal
#: sample in five dimensions falls short of the whole sample's.
CORE_SHARE = 0.75
CONSISTENCY = 1.4
#: Parts into which the rows of a cell fall by a hash of their id.
PARTS = 32


def robust_models(rows: DataFrame, rounds: int) -> DataFrame:
    """``cell``, means ``m_i`` and the inverse Cholesky factor ``w_i_k`` of the minimum covariance determinant per cell.

    The first core is the nearest three quarters around the medians in units of interquartile ranges; every round estimates
    mean and covariance of the core and takes the nearest three quarters again, which never raises the determinant.
    """
    names, floors = list(FEATURES), [floor for _, floor in FEATURES.values()]
    quartiles = rows.groupBy("cell").agg(*[F.percentile(n, F.lit([0.25, 0.5, 0.75])).alias(f"q_{n}") for n in names])
    start = quartiles.select("cell", *[(F.col(f"q_{n}")[1] / STEPS).alias(f"m_{i}") for i, n in enumerate(names)], *[
        (1.0 / F.sqrt(F.pow((F.col(f"q_{names[i]}")[2] - F.col(f"q_{names[i]}")[0]) / STEPS / 1.349, 2) + floors[i] ** 2) if i == k else F.lit(0.0)).alias(f"w_{i}_{k}")
        for i in range(len(names)) for k in range(i + 1)
    ])
    models = stored(start, "quality-model")
    for _ in range(rounds):
        measured = with_distance(rows, models).withColumn("near", F.round(F.log(1.0 + F.col("distance")) * STEPS).cast("int"))
        limit = measured.groupBy("cell").agg(F.percentile("near", F.lit(CORE_SHARE)).alias("limit"))
        core = beside(measured, limit, "inner").where("near <= limit")
        models = stored(cholesky(core, names, floors), "quality-model")
    return models


def cholesky(core: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    size = len(names)
    pairs = [(i, k) for i in range(size) for k in range(i + 1)]
    sums = core.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(n).alias(f"s_{i}") for i, n in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[k])).alias(f"p_{i}_{k}") for i, k in pairs])
    df = sums.select("cell", *[(F.col(f"s_{i}") / F.col("n") / STEPS).alias(f"m_{i}") for i in range(size)], *[
        (CONSISTENCY * (F.col(f"p_{i}_{k}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * (F.col(f"s_{k}") / F.col("n"))) / STEPS**2 + (floors[i] ** 2 if i == k else 0.0)).alias(f"c_{i}_{k}") for i, k in pairs
    ])
    for i, k in pairs:
        rest = F.col(f"c_{i}_{k}")
        for j in range(k):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"l_{k}_{j}")
        df = df.withColumn(f"l_{i}_{k}", F.sqrt(rest) if i == k else rest / F.col(f"l_{k}_{k}"))
    for i, k in sorted(pairs, key=lambda p: p[0] - p[1]):
        total = F.lit(0.0)
        for j in range(k, i):
            total = total + F.col(f"l_{i}_{j}") * F.col(f"w_{j}_{k}")
        df = df.withColumn(f"w_{i}_{k}", 1.0 / F.col(f"l_{i}_{i}") if i == k else -total / F.col(f"l_{i}_{i}"))
    return df.select("cell", *[f"m_{i}" for i in range(size)], *[f"w_{i}_{k}" for i, k in pairs])


def beside(rows: DataFrame, models: DataFrame, how: str) -> DataFrame:
    """Rows next to what is known of their cell, on ``(cell, part)``: a cell of most rows is met in ``PARTS`` parts."""
    spread = models.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumnRenamed("cell", "__cell")
    return rows.join(spread, (F.col("cell") == F.col("__cell")) & (F.col("part") == F.col("__part")), how).drop("__cell", "__part")


def with_distance(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance to the model of the row's cell; null where there is none."""
    names = list(FEATURES)
    joined = beside(rows, models, "left")
    distance = F.lit(0.0)
    for i in range(len(names)):
        part = F.lit(0.0)
        for k in range(i + 1):
            part = part + F.col(f"w_{i}_{k}") * (F.col(names[k]) / STEPS - F.col(f"m_{k}"))
        distance = distance + part * part
    return joined.select(*rows.columns, distance.alias("distance"))


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", min_words: int = 50, max_repeated: int = 50, min_cell: int = 64, limit: float = 64.0, rounds: int = 3) -> DataFrame:
    """``doc_id``, the five statistics, ``base_failed``, ``distance`` and ``kept`` per input row.

    A text fails the base rules with fewer than ``min_words`` words or with more than ``max_repeated`` per cent of its words
    in repeated windows. The others are compared with their cell: language and source, or all small sources of the language
    where that pair has fewer than ``min_cell`` rows, or all small languages together. A row is kept unless its squared
    robust distance exceeds ``limit``. Estimates use every row that passes the base rules.

    Null and empty texts have no words and fail. Null languages and sources are values of their own. A cell of fewer than
    ``min_cell`` rows in the end judges nobody: its rows are kept, with a null distance. Repeated rows get a row each.
    """
    rows, models = fit_quality(docs, (), id_column, text_column, lang_column, source_column, min_words, max_repeated, min_cell, rounds)
    return with_distance(rows, models).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(limit).alias("kept"), F.when(~F.col("base_failed"), F.round("distance", 6)).alias("distance"),
    )


def verdict(limit: float) -> Column:
    return ~F.col("base_failed") & ~F.coalesce(F.col("distance") > limit, F.lit(False))


def fit_quality(docs: DataFrame, keep: tuple[str, ...], id_column: str, text_column: str, lang_column: str, source_column: str, min_words: int, max_repeated: int, min_cell: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows with statistics, ``cell`` and the whole input row in ``original`` (only the columns in ``keep``), and the models of their cells."""
    ready = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.col(source_column).alias("source"),
        *([F.struct(*[F.col(c) for c in keep]).alias("original")] if keep else []),
    )
    carried = ("original",) if keep else ()
    counted = text_statistics(ready, keep=("lang", "source", *carried))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    marks = [F.col("lang").isNull(), F.col("lang"), F.col("source").isNull(), F.col("source")]
    rows = counted.withColumn("base_failed", failed).select(
        "doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.xxhash64(F.lit("source"), *marks).alias("by_source"), F.xxhash64(F.lit("lang"), *marks[:2]).alias("by_lang"),
        *[F.when(~F.col("base_failed"), F.round(make() * STEPS).cast("long")).alias(name) for name, (make, _) in FEATURES.items()],
    )
    rows = stored(rows, "quality-statistics")
    passed = rows.where("NOT base_failed")
    sizes = passed.groupBy("by_source", "by_lang").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_cell).groupBy("by_lang").agg(F.sum("n").alias("in_lang"))
    cells = sizes.join(small, "by_lang", "left").select(
        F.col("by_source").alias("__by_source"),
        F.when(F.col("n") >= min_cell, F.col("by_source")).when(F.col("in_lang") >= min_cell, F.col("by_lang")).otherwise(F.lit(0)).alias("cell"),
    )
    cells = stored(cells, "quality-cells")
    celled = rows.join(cells, F.col("by_source") == F.col("__by_source"), "left").drop("__by_source", "by_source", "by_lang")
    celled = celled.withColumn("part", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(PARTS)).cast("int"))
    judged = stored(celled.where("NOT base_failed").select("cell", "part", *FEATURES), "quality-judged")
    enough = judged.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= min_cell).select(F.col("cell").alias("__enough"))
    models = robust_models(judged.join(enough, F.col("cell") == F.col("__enough"), "left_semi"), rounds)
    return celled, models


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", min_words: int = 50, max_repeated: int = 50, min_cell: int = 64, limit: float = 64.0, rounds: int = 3) -> DataFrame:
    """The input rows that ``judge_quality`` keeps, with their own columns."""
    rows, models = fit_quality(docs, tuple(docs.columns), id_column, text_column, lang_column, source_column, min_words, max_repeated, min_cell, rounds)
    return with_distance(rows, models).where(verdict(limit)).select("original.*")
