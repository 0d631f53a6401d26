import collections
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.llm import mixing, near_copies, packing, quality, toxicity, vector_search
from memloom.llm.shingles import shingle_counts
from memloom.llm.tokens import document_encoder, encoder

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score string, size int, cell string, node string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, "s", 2, "c", "n") for i, t, lang, source in rows], DOCS)


def sentence(rng, n, words=tuple("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split())):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


# --- statistics and outliers ---------------------------------------------------------------------------------------------


def statistics(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x\x1cy z w", "é ñ ß " * 5, "a\n\na\n a\n", "<b>|#|</b>\r\n", "a a a a a", "  lead and trail \v"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)] + ["\n".join(rng.choice("pqr") for _ in range(20)), "w " * 3000]
    rows = quality.text_statistics(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_outliers(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(60, 400)), rng.choice(["en", None]), rng.choice(["a", "a", "a", "b"])) for i in range(800)]
    junk = [(1000 + i, " ".join(w + "###" for w in sentence(rng, 200).split()), "en", "a") for i in range(60)]
    edge = [(2000, None, "en", "a"), (2001, "", None, None), (2002, "few words", "en", "a"), (2003, "same three words " * 60, "en", "a"), (2004, sentence(rng, 100), "xx", "rare"), rows[0]]
    out = quality.judge_quality(docs_of(spark, rows + junk + edge)).collect()
    assert len(out) == len(rows) + len(junk) + len(edge)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i, *_ in rows) and not any(kept[i] for i, *_ in junk)
    assert [kept[i] for i in range(2000, 2005)] == [False, False, False, False, True]
    assert quality.judge_quality(docs_of(spark, [])).count() == 0
    assert sorted(r["doc_id"] for r in quality.keep_good(docs_of(spark, rows + junk)).collect()) == sorted(i for i, *_ in rows)


def test_covariance_model_matches_numpy(spark):
    rng = np.random.default_rng(3)
    points = np.rint(rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) * quality.STEPS).astype(int)
    names = list(quality.FEATURES)
    core = spark.createDataFrame([(7, i % quality.PARTS, *map(int, p)) for i, p in enumerate(points)], "cell long, part int, " + ", ".join(f"{n} long" for n in names))
    floors = [f for _, f in quality.FEATURES.values()]
    got = quality.with_distance(core, quality.cholesky(core, names, floors)).toArrow().to_pylist()
    x = points / quality.STEPS
    inverse = np.linalg.inv(quality.CONSISTENCY * np.cov(x.T, bias=True) + np.diag(np.square(floors)))
    by = {tuple(r[n] for n in names): r["distance"] for r in got}
    for p, d in zip(points, ((x - x.mean(0)) @ inverse * (x - x.mean(0))).sum(1)):
        assert by[tuple(map(int, p))] == pytest.approx(d, rel=1e-6)


# --- toxicity ------------------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        terms = np.array(sorted(rng.sample(range(40), rng.randrange(1, 6))))
        weights = np.array([rng.random() for _ in terms])
        vectors.append((terms, weights / np.sqrt((weights**2).sum())))
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    for i in range(0, 700, 7):
        found, cosine = index.search(*vectors[i], 15)
        exact = np.round(dense @ dense[i], 12)
        order = [j for j in np.lexsort((np.arange(700), -exact)) if exact[j] > 0][:15]
        assert np.allclose(cosine, exact[order]) and (exact[found] == exact[order]).all()
    assert len(toxicity.BlockMaxIndex([], 5, 16).search(np.array([1]), np.array([1.0]), 3)[0]) == 0


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["nastyword", "vileword", "grimword"]
    rows, labels = [], []
    for i in range(1200):
        words = sentence(rng, rng.randrange(20, 80)).split()
        toxic = i % 8 == 0
        if toxic:
            words[3:3] = rng.sample(bad, rng.randrange(1, 3))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, "NASTYWORD!", None, None), rows[0]]
    labels += [(0, 1), (7777, 1), (None, 1), (3, None)]
    documents, labelled = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_toxicity(documents, labelled).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["doc_id"] == 5002 or r["doc_id"] < 5000 and r["doc_id"] % 8 == 0)
    learned = {i for i, _ in labels if i is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    assert {e for r in out for e in r["evidence"]} <= learned
    swapped = spark.createDataFrame([(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels], "doc_id long, toxic int")
    again = toxicity.score_toxicity(documents, swapped).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    kept = toxicity.drop_toxic(documents, labelled)
    assert kept.columns == documents.columns and kept.count() == sum(r["predicted"] == 0 for r in out)
    assert toxicity.score_toxicity(docs_of(spark, []), labelled).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(documents.limit(5), labelled.limit(0)).collect()} <= {0, 1}


# --- near copies ---------------------------------------------------------------------------------------------------------


def test_shingles_brute_force():
    texts = ["", "a", "a b c d", "a b c d e", " a  b\tc\nd e f a b c d e f", "é ñ é ñ é ñ é ñ"]
    owner, hashes, counts = shingle_counts([t.encode() for t in texts], 5)
    wanted = []
    for t in texts:
        w = t.split()
        wanted.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {})
    for i, c in enumerate(wanted):
        assert sorted(counts[owner == i]) == sorted(c.values())
    assert len(set(hashes[owner == 3]) & set(hashes[owner == 4])) == 1


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(6)
    agree, wanted = [], []
    for _ in range(60):
        hashes = np.sort(rng.integers(0, 1 << 48, 200).astype(np.uint64))
        a, b = rng.gamma(2, size=200), rng.gamma(2, size=200)
        b = np.where(rng.random(200) < 0.7, a, b)
        both = np.r_[hashes, hashes]
        _, signed = near_copies.signatures(np.repeat([0, 1], 200), both, np.r_[a, b])
        agree.append((signed[0] == signed[1]).mean())
        wanted.append(near_copies.weighted_jaccard((hashes, a), (hashes, b)))
        assert wanted[-1] == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(wanted)) < 0.03


def test_components(spark):
    links = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(40)] + [(b"9001", b"9000"), (b"9002", b"9000"), (b"9000", b"9001")]
    got = {bytes(r["node"]): bytes(r["component"]) for r in near_copies.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary")).collect()}
    assert got == {f"{i:04d}".encode(): b"0000" for i in range(41)} | {n: b"9000" for n in (b"9000", b"9001", b"9002")}


def test_near_copies(spark):
    rng = random.Random(7)
    rows, groups = [], {}
    for g in range(60):
        words = sentence(rng, 300).split()
        for c in range(rng.randrange(1, 5)):
            changed = list(words)
            for _ in range(c * 2):
                changed[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
            i = 1000 - len(rows)
            rows.append((i, " ".join(changed), "en", "s"))
            groups.setdefault(g, []).append(i)
    blank = [(2000, None, "en", "s"), (2001, None, "en", "s"), (2002, "", "en", "s"), (2003, "", "en", "s"), (2004, "a b", "en", "s"), (2005, "a b", "en", "s"), (2006, "b a", "en", "s"), (2007, "x " * 400_000, "en", "s")]
    out = near_copies.near_copy_classes(docs_of(spark, rows + blank + [rows[0], (None, rows[0][1], None, None)])).collect()
    assert len(out) == len(rows) + len(blank) + 2
    name = {r["doc_id"]: r["class_id"] for r in out}
    for members in groups.values():
        assert {name[i] for i in members} == {min(members)}
    assert [name[i] for i in range(2000, 2008)] == [2000, 2001, 2002, 2002, 2004, 2004, 2006, 2007]
    assert name[None] == name[rows[0][0]]
    documents = docs_of(spark, rows + blank + [rows[0]])
    kept = near_copies.drop_near_copies(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([min(m) for m in groups.values()] + [2000, 2001, 2002, 2004, 2006, 2007])
    assert near_copies.near_copy_classes(docs_of(spark, [])).count() == 0


def test_near_copies_link_what_no_leader_reaches(spark):
    rng = random.Random(14)
    changed = lambda words, n: [f"new{rng.randrange(10**6)}" if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    base, rows = sentence(rng, 300).split(), []
    for _ in range(300):
        first = changed(base, 7)
        rows += [first, changed(first, 5)]
    texts = [" ".join(w) for w in rows]
    documents = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    idf = near_copies.class_weights(documents)
    owner, hashes, counts = shingle_counts([t.encode() for t in texts], near_copies.WIDTH)
    weights = near_copies.shingle_weights(hashes, counts, idf)
    signature = near_copies.signatures(owner, hashes, weights)[1]
    bands, ends = near_copies.band_keys(signature), np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [(hashes[a:b], weights[a:b]) for a, b in zip(ends, ends[1:])]
    name = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (bands[i] == bands[j]).any() and (signature[i] == signature[j]).sum() >= int(0.55 * signature.shape[1]) and near_copies.weighted_jaccard(sets[i], sets[j]) >= 0.8:
            low, high = sorted((name[i], name[j]))
            name = [low if n == high else n for n in name]
    assert 1 < len(set(name)) < len(texts) and max(collections.Counter(bands.ravel().tolist()).values()) > 50
    assert {r["doc_id"]: r["class_id"] for r in near_copies.near_copy_classes(documents).collect()} == dict(enumerate(name))


# --- mixing --------------------------------------------------------------------------------------------------------------


def test_sainte_lague_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        shares = [Fraction(rng.randrange(0, 50)) for _ in range(rng.randrange(1, 9))]
        limits = [rng.randrange(0, 40) for _ in shares]
        seats = rng.randrange(0, 80)
        held = [0] * len(shares)
        for _ in range(min(seats, sum(n for n, s in zip(limits, shares) if s))):
            best = max((i for i in range(len(shares)) if held[i] < limits[i] and shares[i]), key=lambda i: (shares[i] / (2 * held[i] + 1), -i))
            held[best] += 1
        assert mixing.sainte_lague(shares, seats, limits) == held


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [Fraction(375, 2), 75, Fraction(75, 2)]
    assert mixing.targets([10, 100, 1000], [5, 2, 1]) == [30, 300, 780]
    assert mixing.targets([0, 5], [5, 2]) == [0, 5] and mixing.targets([], []) == []


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randrange(0, 900)), "en", rng.choice(["b", "a", "a", "c", None, "é"])) for i in range(400)]
    rows += [(900, None, "en", "a"), (901, "", "en", "z"), rows[0], rows[0], (902, "lone words here", "en", "tiny")]
    documents = docs_of(spark, rows)
    out = mixing.mix_documents(documents, block=64).collect()
    assert len(out) == len(rows)
    source = {i: s for i, _, _, s in rows}
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = collections.Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(wanted[s]))
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - wanted[s]) <= 64 * 17, (s, taken[s], wanted[s])
        assert wanted[s] != 3 * sizes[s] or taken[s] == 3 * sizes[s]
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_documents(documents, block=64).collect()))
    mixed = mixing.take_documents(documents, block=64)
    assert mixed.columns == documents.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["source"]] += len(re.findall(WORD, r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == +taken
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0 and mixing.take_documents(docs_of(spark, [])).count() == 0


def test_cut_text():
    assert mixing.cut_text("a  b\nc d e f g", 3, [True, False, True], 4) == "a\nf g"
    assert mixing.cut_text("a  b\nc", 0, [True], 4) == "a  b\nc"


# --- packing -------------------------------------------------------------------------------------------------------------


def test_encoder_matches_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(10)
    pieces = [" ", "  ", "\n", "\t", "\r\n", " ", "a", "B", "don't", "'s", "é", "ß", "字", "😀", "1", "23", "###", ".", "…", "<|endoftext|>", "\x00", "word"]
    texts = ["", " ", "\n", " a", "a ", "a  b", "a \nb", "a\n b", "a\n \nb", "a\t b"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for text, wanted in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encoder()(text).tolist() == wanted.ids, repr(text)


def test_documents_encode_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(13)
    pieces = [" ", "  ", "\n", "a", "don't", "é", "字", "1", "<|endoftext|>", "<|endoftext", "|>", "word"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    wanted = [w.ids for w in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert wanted[0] == [31373, 220, 50256, 995]
    some = texts[:200]
    packed = packing.pack_documents(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(some)])).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == {i: len(w) + 1 for i, w in enumerate(wanted[: len(some)])}
    for r in packed:
        ids = np.append(wanted[r["doc_id"]], 0).astype("<u4")[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
    for text, ids in zip(texts, wanted):
        assert document_encoder()(text).tolist() == ids, repr(text)


def test_served_is_fair_and_exact():
    rng = np.random.default_rng(11)
    for lengths in ([1], [5, 1], [1000, 7, 300], rng.integers(1, 5000, 12).tolist(), [0, 10, 3], [10**12, 3, 10**11]):
        lengths = np.array(lengths, np.int64)
        total = int(lengths.sum())
        last = -(-total // 64)
        windows = np.arange(last + 1) if last < 5000 else np.r_[0, 1, last // 2, last // 2 + 1, last - 1, last]
        given = packing.served(windows, lengths, 64)
        assert (given.sum(1) == np.minimum(windows * 64, total)).all() and (np.diff(given, axis=0) >= 0).all()
        assert (np.abs(given - lengths[None, :] * (given.sum(1) / total)[:, None]) <= len(lengths)).all() and (given[-1] == lengths).all()


def test_packing(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(0, 200)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    rows += [(900, None, "en", "a"), (901, "", "en", "only"), (902, "long " * 20_000, "en", "b")]
    out = packing.pack_documents(docs_of(spark, rows)).toArrow().to_pylist()
    text = {i: t for i, t, *_ in rows}
    ids = {i: np.append(encoder()(t or ""), 0).astype("<u4") for i, t in text.items()}
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], r["length"]))
    total = sum(map(len, ids.values()))
    assert sorted(sequences) == list(range(-(-total // 1024)))
    for group, sizes in ((documents, {i: len(v) for i, v in ids.items()}), (sequences, {s: min(1024, total - 1024 * s) for s in sequences})):
        assert group.keys() == sizes.keys()
        for key, spans in group.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == sizes[key]
    source = {i: s for i, _, _, s in rows}
    share = sum(len(v) for i, v in ids.items() if source[i] == "a") / total
    for s in sequences:
        part = sum(r["length"] for r in out if r["sequence_id"] == s and source[r["doc_id"]] == "a")
        assert abs(part - share * sum(n for _, n in sequences[s])) <= 4
    assert packing.pack_documents(docs_of(spark, [])).count() == 0
    repeated = packing.pack_documents(docs_of(spark, [rows[0], rows[0]])).collect()
    assert sum(r["length"] for r in repeated) == 2 * len(ids[0])


# --- vectors -------------------------------------------------------------------------------------------------------------


def test_vector_search_brute_force(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(9, 8))
    points = np.rint((centres[rng.integers(0, 9, 900)] + 0.2 * rng.normal(size=(900, 8))) * 20).astype(int)
    points[300:620] = points[0]
    rows = [(i, points[i].tolist()) for i in range(900)]
    data = spark.createDataFrame(rows, "id long, vector array<int>")
    got = collections.defaultdict(list)
    for r in vector_search.top_inner_products(data, data.where("id % 3 = 0"), 20, pivots=16, query_block=32, data_block=64).sort("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 900, 3):
        score = points @ points[q]
        order = [j for j in np.lexsort((np.arange(900), -score)) if j != q][:20]
        assert got[q] == [(k + 1, j, score[j]) for k, j in enumerate(order)]
    few = data.where("id < 5")
    assert vector_search.top_inner_products(few, few, 20).count() == 20


def test_vectors_that_take_no_part(spark):
    rows = [(0, [0.5, -0.01]), (20, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [-1.0, 0.25]), (6, [])]
    out = vector_search.embedding_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).sort("query_id", "rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 20, 32 * 64 - 64), (0, 2, 5, -32 * 64 - 16), (20, 1, 0, 32 * 64 - 64), (20, 2, 5, -64 * 64 + 16 * 64)]
    assert vector_search.embedding_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components_and_ragged_vectors(spark):
    rng = random.Random(16)
    rows = [(i, [float(rng.randrange(-(10**7), 10**7)) for _ in range(6)]) for i in range(120)] + [(200, [1e6] * 5), (201, [1.0] * 7), (220, [3.0])]
    schema = "vec_id long, embedding array<double>"
    got = collections.defaultdict(list)
    for r in vector_search.embedding_neighbours(spark.createDataFrame(rows, schema)).sort("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [int(64 * x) for x in v] for i, v in rows if len(v) == 6}
    for q in range(0, 120, 20):
        score = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        assert got[q] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert set(got) == set(range(0, 120, 20))
    with pytest.raises(Exception, match="exceeds 64 bits"):
        vector_search.embedding_neighbours(spark.createDataFrame([(0, [1e12]), (20, [1e12])], schema)).collect()


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    rows = [(i, sentence(rng, rng.randrange(60, 300)), "en", rng.choice(["a", "b"])) for i in range(400)]
    for i in range(0, 80, 2):
        rows[i] = (i, rows[i][1] + " vileword nastyword", "en", rows[i][3])
    rows += [(1000 + i, rows[101 + 2 * i][1], "en", "a") for i in range(20)] + [(2000, " ".join(w + "***" for w in sentence(rng, 100).split()), "en", "a"), (2001, "too short", "en", "b"), (2002, None, "en", "b")]
    documents = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 80 and i % 2 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    wanted = {i for i, *_ in rows if i < 400 and not (i < 80 and i % 2 == 0)}
    docs = documents
    for (name, stage), left in zip(corpus_pipeline.STAGES[:3], (wanted | set(range(1000, 1020)) | {2000, 2001, 2002}, wanted | set(range(1000, 1020)), wanted)):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns and {r["doc_id"] for r in docs.collect()} == left, name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(full) > 50 and sum(r["n"] != 1024 for r in full) <= 1
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= wanted


def test_packing_does_not_shuffle_ids(spark):
    rows = [(i, "a few words " * 20, "en", f"source {i % 30}") for i in range(600)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
        plan = packing.pack_documents(docs_of(spark, rows).repartition(8))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_the_encoder_forgets_words_between_tasks():
    encode = document_encoder()
    encode("some plain words")
    encode.forget()
    assert not encode.ordinary.words and len(encode("some plain words")) > 0


def test_the_encoder_encodes_whole_texts_where_words_are_ever_new():
    encode, whole = document_encoder(), document_encoder().ordinary.encode
    repeated, new = ([" ".join(f"w{(n * 1000 + i) % most}x" for i in range(1000)) for n in range(130)] for most in (3000, 10**9))
    for texts, plain in ((repeated, False), (new, True)):
        encode.forget()
        assert all(encode(t).tolist() == whole(t) for t in texts)
        assert encode.ordinary.whole is plain and bool(encode.ordinary.words) is not plain
    encode.forget()
