"""Near copies by improved consistent weighted sampling over TF-IDF word shingles, banded and verified by weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import stored
from memloom.llm.shingles import chunks, mix, shingle_counts

#: Shingles are counted in this many classes by hash; the table of weights keeps this size on any corpus.
CLASSES = 1 << 18
WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: How much more than a shingle of all texts one of hardly any text weighs.
SPAN = 0.5
#: Nodes of a band that others are compared with, besides its most central and its least one.
DRAWN = 6
#: A band of more nodes is split into parts of about this size, each of which meets the band's leaders.
CROWD = 500
#: A band of at most this many nodes is compared in full.
SMALL = 9
#: Nodes outside a band's largest component that meet the whole band in an earlier round, so that the last round has fewer.
EARLY = 64
#: Nodes outside the largest component, and members, of a block; and the bytes of their texts.
PROBES, MEMBERS, BLOCK_BYTES = 4_000, 1_000, 4 << 20


def gamma_quantiles(n: int) -> np.ndarray:
    """Midpoint quantiles of the Gamma(2, 1) distribution, by Newton steps on 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 8)
    return x


_R = gamma_quantiles(1 << 12).astype(np.float32)
_R_INVERSE = (1 / _R).astype(np.float32)
_LOG_C = np.log(gamma_quantiles(1 << 16)).astype(np.float32)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(hashes & np.uint64(CLASSES - 1)).astype(int)]


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their signatures; two agree in a place with the probability of their weighted Jaccard.

    Per place and shingle: r, c from Gamma(2, 1) and b uniform, all drawn by the shingle's hash; t = floor(ln w / r + b),
    ln a = ln c - r (t - b + 1); the sample is the shingle of least a together with its t.
    """
    if not len(hashes):
        return np.zeros(0, int), np.zeros((0, BANDS * ROWS), np.int32)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[starts, len(owner)])
    log_w = np.log(weights).astype(np.float32)
    segment = np.repeat(np.arange(len(starts)), sizes)
    out = np.empty((len(starts), BANDS * ROWS), np.int32)
    for k, seed in enumerate(_SEEDS):
        draw = (hashes ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        draw ^= draw >> np.uint64(31)
        draw *= np.uint64(0x9FB21C651E98DF25)
        r_at = (draw >> np.uint64(52)).astype(np.int32)
        b = ((draw >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w * _R_INVERSE[r_at] + b)
        a = _LOG_C[((draw >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int32)] - _R[r_at] * (t - b + np.float32(1))
        least = np.flatnonzero(a == np.minimum.reduceat(a, starts)[segment])
        least = least[np.r_[True, segment[least][1:] != segment[least][:-1]]]
        sample = mix(hashes[least] * np.uint64(0x9E3779B97F4A7C15) + t[least].astype(np.int64).astype(np.uint64))
        out[:, k] = (sample & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return owner[starts], out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of rows."""
    rows = signature.astype(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key.view(np.int64)


def class_weights(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency per shingle class, from 1 (in every text) to ``1 + SPAN`` (no more often than the mean class).

    Every text counts once in the class of each of its shingles. The damped scale keeps what sets copies apart from weighing
    much more than what thousands of copies share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, rows = np.zeros(CLASSES, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, run in chunks(batch["text"].to_pylist()):
                _, hashes, _ = shingle_counts(run, WIDTH)
                tally += np.bincount((hashes & np.uint64(CLASSES - 1)).astype(int), minlength=CLASSES)
        used = np.flatnonzero(tally)
        yield pa.RecordBatch.from_pydict({"class": pa.array(np.r_[used, -1], pa.int32()), "n": pa.array(np.r_[tally[used], rows], pa.int64())})

    sums = texts.select("text").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    classes, n = found["class"].to_numpy(), found["n"].to_numpy()
    rows = max(1, int(n[classes < 0].sum()))
    frequency = np.ones(CLASSES)
    frequency[classes[classes >= 0]] = n[classes >= 0]
    floor = max(1.0, frequency.sum() / CLASSES)
    scale = np.log(max(rows / floor, 1 + 1e-9))
    return 1.0 + SPAN * np.clip(np.log(np.maximum(rows / frequency, 1.0)) / scale, 0.0, 1.0)


def weighted_jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights of two sorted weighted sets."""
    _, a, b = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    shared = np.minimum(left[1][a], right[1][b]).sum()
    return float(shared / (left[1].sum() + right[1].sum() - shared))


def block_links(probes: pa.Table, members: pa.Table, idf: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Pairs of components that a probe and a member of one band link: every pair of a probe and a member is compared unless
    it shares an earlier band, which compares it, or its components already meet in this block."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def side(rows: pa.Table) -> tuple:
        rows = rows.combine_chunks()
        bands, signature = (np.array(rows[c].combine_chunks().flatten()).reshape(rows.num_rows, -1) for c in ("bands", "signature"))
        return rows["node"].to_pylist(), rows["component"].to_pylist(), rows["probe"].to_pylist(), bands, signature, rows["text"].to_pylist()

    def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(first + owner, hashes, shingle_weights(hashes, counts, idf)) for first, run in chunks(texts) for owner, hashes, counts in [shingle_counts(run, WIDTH)]]
        owner, hashes, weights = (np.concatenate(c) for c in zip(*parts))
        return np.searchsorted(owner, np.arange(len(texts) + 1)), hashes, weights

    a_node, a_component, _, a_bands, a_signature, a_texts = side(probes)
    b_node, b_component, b_probe, b_bands, b_signature, b_texts = side(members)
    at = int(np.flatnonzero(a_bands[0] == probes["band"][0].as_py())[0])
    (a_ends, a_hashes, a_weights), (b_ends, b_hashes, b_weights) = vectors(a_texts), vectors(b_texts)
    sums = np.add.reduceat(b_weights, b_ends[:-1])
    met = []
    for i, node in enumerate(a_node):
        near = np.flatnonzero(((b_signature == a_signature[i]).sum(1) >= int(0.55 * BANDS * ROWS)) & ~(b_bands[:, :at] == a_bands[i, :at]).any(1))
        near = [j for j in near.tolist() if not (b_probe[j] and b_node[j] <= node) and root(b_component[j]) != root(a_component[i])]
        if not near:
            continue
        own = (a_hashes[a_ends[i] : a_ends[i + 1]], a_weights[a_ends[i] : a_ends[i + 1]])
        for low in range(0, len(near), 256):
            some = near[low : low + 256]
            spans = [slice(b_ends[j], b_ends[j + 1]) for j in some]
            hashes, weights = np.concatenate([b_hashes[x] for x in spans]), np.concatenate([b_weights[x] for x in spans])
            place = np.minimum(np.searchsorted(own[0], hashes), len(own[0]) - 1)
            least = np.where(own[0][place] == hashes, np.minimum(own[1][place], weights), 0.0)
            shared = np.add.reduceat(least, np.cumsum([0, *[x.stop - x.start for x in spans[:-1]]]))
            for k in np.flatnonzero(shared >= (SIMILARITY - 1e-9) * (own[1].sum() + sums[some] - shared)).tolist():
                x, y = root(a_component[i]), root(b_component[some[k]])
                if x != y and weighted_jaccard(own, (b_hashes[spans[k]], b_weights[spans[k]])) >= SIMILARITY:
                    parent[max(x, y)] = min(x, y)
                    met.append((a_component[i], b_component[some[k]]))
    return met


def uncompared(members: DataFrame, done: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored ``node, band, component, probe`` of the bands with pairs of two components that no round has compared. Probes are the nodes
    that no round has compared with the whole band, unless they are in the band's largest component: each other pair has
    one in it or is of one component."""
    labelled = members.select("node", "band").join(labels.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", "band", F.coalesce("component", "node").alias("component"))
    labelled = stored(labelled, "near-labelled")
    counts = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("components")).where("components > 1")
    open_ = labelled.join(largest, "band")
    finished = done.select(F.col("node").alias("__node"), F.col("band").alias("__band"), F.lit(True).alias("finished"))
    marked = open_.join(finished, (F.col("node") == F.col("__node")) & (F.col("band") == F.col("__band")), "left")
    return stored(marked.select("node", "band", "component", ((F.col("component") != F.col("largest")) & F.col("finished").isNull()).alias("probe")), "near-open")


def compare_rest(members: DataFrame, nodes: DataFrame, done: DataFrame, labels: DataFrame, known_texts: DataFrame, idf) -> DataFrame:
    """``labels`` after all pairs of a band's ``members (node, band)`` are compared whose ends are still in two components.

    ``done (node, band)`` are the nodes that were compared with their whole band; ``known_texts (node, text)`` has the texts. A first round draws about ``EARLY`` probes of
    each band, the last takes all that remain. A block is some probes and some members of a band, so a band of any size is
    compared in parts; a block gives each pair of components at most once.
    """
    for wanted in (EARLY, None):
        rows = uncompared(members, done, labels)
        probes = rows.where("probe")
        if probes.isEmpty():
            return labels
        if wanted:
            sizes = probes.groupBy("band").agg(F.count("*").alias("n"))
            probes = probes.join(sizes, "band").where(F.pmod(F.xxhash64("node", F.lit("early")), F.col("n")) < wanted).drop("n")
        probes = stored(probes, "near-probes")
        asked = rows.join(probes.select("band").distinct(), "band", "left_semi").select("node").distinct()
        texts = stored(asked.join(nodes.select("node", "bands", "signature", "bytes"), "node").join(known_texts, "node"), "near-open-texts")
        slim = texts.select("node", "bytes")
        parts_of = lambda most: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
        chunked = probes.join(slim, "node").groupBy("band").agg(parts_of(PROBES).alias("chunks"))
        parted = rows.join(slim, "node").groupBy("band").agg(parts_of(MEMBERS).alias("parts"))
        shape = chunked.join(parted, "band")
        spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        own = lambda of: F.pmod(F.xxhash64("node", F.lit(of)), F.col(of)).cast("int")
        asked = probes.join(shape, "band").select("node", "band", "component", F.lit(True).alias("probe"), F.lit(True).alias("asks"), own("chunks").alias("chunk"), spread("parts").alias("part"))
        again = probes.select(F.col("node").alias("__node"), F.col("band").alias("__band"), F.lit(True).alias("drawn"))
        met = rows.join(shape, "band").join(again, (F.col("node") == F.col("__node")) & (F.col("band") == F.col("__band")), "left")
        met = met.select("node", "band", "component", F.coalesce("drawn", F.lit(False)).alias("probe"), F.lit(False).alias("asks"), spread("chunks").alias("chunk"), own("parts").alias("part"))
        blocks = asked.unionByName(met).join(texts.drop("bytes"), "node")

        def link(block: pa.Table) -> pa.Table:
            asks = block["asks"]
            few, many = block.filter(asks), block.filter(pa.compute.invert(asks))
            found = block_links(few, many, idf.value) if few.num_rows and many.num_rows else []
            return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

        links = stored(blocks.groupBy("band", "chunk", "part").applyInArrow(link, "a binary, b binary").distinct(), "near-rest")
        if not links.isEmpty():
            joined = components(links).select(F.col("node").alias("__old"), F.col("component").alias("__new"))
            both = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
            labels = stored(both.join(joined, both["component"] == F.col("__old"), "left").select("node", F.coalesce("__new", "component").alias("component")), "near-labels")
        done = done.unionByName(probes.select("node", "band"))
    return labels


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for the ends of ``links (a, b)``: least labels spread to neighbours, and a
    label takes over the label of the node it names. Rounds end when nothing changes; each is a written table."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "near-labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("offer"))
        spread = labels.join(offered, labels["node"] == offered["a"]).select("node", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        spread = stored(spread, "near-labels")
        named = spread.select(F.col("node").alias("__node"), F.col("component").alias("__next"))
        jumped = stored(spread.join(named, spread["component"] == named["__node"]).select("node", "old", F.col("__next").alias("component")), "near-labels")
        changed = not jumped.where("component != old").isEmpty()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def near_copy_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` per input row: classes of exact and near copies, named by their least id.

    Equal texts are one node. The nodes of a band of at most ``SMALL`` are all compared. Those of a larger one are first
    compared with a few of them: the one that shares most bands with others, the least and ``DRAWN`` hashed ones; then all pairs
    that are still in two components (``compare_rest``). Pairs whose signatures are far below the threshold go; the others are linked if the weighted Jaccard similarity of their five-word shingles is at
    least 0.8. Classes are the connected components; ``kept`` marks the row or rows that bear the least id of their class.

    Null texts are in a class of their own each. Texts without words are equal if their characters are. Texts under five
    words are one shingle. Null ids: such a row never names a class; a class of null ids alone has a null name and keeps all.
    """
    rows = near_copy_rows(docs, id_column, text_column)
    classes = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    named = rows.join(classes.withColumnRenamed("component", "__component"), F.col("component") == F.col("__component"), "left")
    class_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return named.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of every class of ``near_copy_classes``: that of the least id, of equal ids the least text hash, once."""
    rows = near_copy_rows(docs, id_column, text_column).where("component IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("blank"), F.col("doc_id"), F.col("node"))).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__node"))
    hashed = docs.withColumns({"__row_id": F.col(id_column).cast("long"), "__text_node": F.unhex(F.md5(F.col(text_column).cast("binary")))})
    kept = hashed.join(first, (F.col("__text_node") == F.col("__node")) & F.col("__row_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["__text_node", "__row_id"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(text_column).isNull()))


def near_copy_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Stored ``doc_id, node, component`` per row; node and component are null for a null text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    shared = spark.sparkContext.broadcast(class_weights(texts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            size = batch.num_rows
            signed, has = np.zeros((size, BANDS * ROWS), np.int32), np.zeros(size, bool)
            for first, run in chunks(batch["text"].to_pylist()):
                owner, hashes, counts = shingle_counts(run, WIDTH)
                who, values = signatures(owner, hashes, shingle_weights(hashes, counts, idf))
                signed[first + who], has[first + who] = values, True
            keys = band_keys(signed)
            mask = ~has
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "node": batch["node"],
                "bands": pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())) if not mask.any() else pa.array([None if m else k.tolist() for k, m in zip(keys, mask)], pa.list_(pa.int64())),
                "bytes": pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).cast(pa.int64()),
                "signature": pa.FixedSizeListArray.from_arrays(pa.array(signed.ravel()), BANDS * ROWS).cast(pa.list_(pa.int32())),
            })

    signed = stored(texts.select("doc_id", "node", "text").mapInArrow(sign, "doc_id long, node binary, bands array<long>, bytes long, signature array<int>"), "near-signatures")
    nodes = signed.where("node IS NOT NULL AND bands IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"), F.first("signature").alias("signature"))
    nodes = stored(nodes, "near-nodes")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared_bands = stored(banded.join(sizes, "band"), "near-bands")
    few, crowded = shared_bands.where(F.col("size") <= SMALL).select("band", "node"), shared_bands.where(F.col("size") > SMALL)
    in_full = few.join(few.select("band", F.col("node").alias("other")), "band").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    degree = shared_bands.groupBy("node").agg(F.sum("size").alias("degree"))
    members = crowded.join(degree, "node")
    drawn = [F.max(F.struct(F.xxhash64("node", F.lit(i)).alias("mark"), F.col("node")))["node"] for i in range(DRAWN)]
    leaders = members.groupBy("band").agg(F.array_distinct(F.array(F.max(F.struct("degree", "node"))["node"], F.min("node"), *drawn)).alias("leaders"), F.max("size").alias("size"))
    parts = F.ceil(F.col("size") / CROWD).cast("int")
    leaders = stored(leaders, "near-leaders")
    done = leaders.select(F.explode("leaders").alias("node"), "band")
    leaders = leaders.select("band", "leaders", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    split = members.select("node", "band", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    pairs = split.join(leaders, ["band", "part"]).select("node", F.explode("leaders").alias("leader")).where("node != leader")
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).union(in_full).distinct()

    # Whole texts are shuffled here alone; what compares nodes reads the few that share a band.
    asked = shared_bands.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))
    wanted = texts.select("doc_id", "node", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("node") == F.col("__node")), "left_semi")
    wanted = stored(wanted.select("node", "text").dropDuplicates(["node"]), "near-texts")

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"{x}_signature"))
    agreeing = F.size(F.filter(F.zip_with("a_signature", "b_signature", lambda x, y: x == y), lambda same: same))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(agreeing >= int(0.55 * BANDS * ROWS)).select("a", "b")
    close = stored(close, "near-pairs")

    with_a = close.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = with_a.join(wanted.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value

        def vectors(texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
            out = {}
            for first, run in chunks(texts):
                owner, hashes, counts = shingle_counts(run, WIDTH)
                weights = shingle_weights(hashes, counts, idf)
                ends = np.searchsorted(owner, np.arange(len(run) + 1))
                out |= {texts[first + i]: (hashes[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]) for i in range(len(run))}
            return out

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                a, b = part["a_text"].to_pylist(), part["b_text"].to_pylist()
                known = vectors(list(dict.fromkeys(a + b)))
                yield part.select(["a", "b"]).filter(pa.array([weighted_jaccard(known[x], known[y]) >= SIMILARITY for x, y in zip(a, b)], pa.bool_()))

    links = stored(both.mapInArrow(verify, "a binary, b binary"), "near-verified")
    found = compare_rest(crowded.select("node", "band"), nodes, done, components(links), wanted, shared)
    rows = signed.select("doc_id", "node").join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    return stored(rows, "near-rows")
