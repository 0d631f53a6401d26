import hashlib
import random
import zlib

import numpy as np
import pytest

from memloom.llm import periodic_runs as runs

DOCS = "doc_id long, text string, node string, n int, period string, start string, pieces string"


def direct_runs(words):
    """Every maximal stretch of smallest period q with at least max(12, 2 q) words, by comparing each word with the one q on."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(12, 2 * q) and not any(p < q and q % p == 0 and s <= at and s + n >= end + q for s, n, p in found):
                found.add((at, end + q - at, q))
            at = end
    return sorted((s, n, q) for s, n, q in found)


def direct_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = direct_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda text: hashlib.sha256(text).hexdigest()
    return (
        doc_id, n, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        digest("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def texts_of(rng):
    letters = lambda n, k: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    out = [None, "", " \t\n\x0b\x0c\r", "a", "a " * 11, "a " * 12, "a " * 700, "a b " * 6, "x " + "a b " * 6 + "a y", "\x1c a b   c " * 5, "é ñ " * 20]
    for n in (30, 90, 200, 500):
        for k in (2, 3, 6):
            out.append(" ".join(letters(n, k)))
    for _ in range(30):
        period = letters(rng.randrange(1, 90), 8)
        body = letters(rng.randrange(40), 8) + (period * 9)[: rng.randrange(len(period), 9 * len(period))] + letters(rng.randrange(40), 8)
        out.append(rng.choice([" ", "\n", "\r\n"]).join(body))
    nested = (("p q " * 8).split() + ["r"]) * 5
    out += [" ".join(nested), " ".join(nested * 2 + ["s"] + nested), " ".join((letters(150, 8) * 3)[:420])]
    return out


def test_runs_of_any_tile_size_equal_direct_comparison(spark):
    rng = random.Random(5)
    rows = [(i, t, "c", 1, "p", "s", "x") for i, t in enumerate(texts_of(rng))]
    rows += [rows[-1], rows[8], (None, "b c " * 9, "c", 1, "p", "s", "x"), (None, None, "c", 1, "p", "s", "x"), (5, "other text of that id", "c", 1, "p", "s", "x")]
    wanted = sorted(map(repr, (direct_row(r[0], r[1]) for r in rows)))
    for tile in (16, 64, 8192):
        got = runs.periodic_runs(spark.createDataFrame(rows, DOCS), tails=True, tile=tile).collect()
        assert sorted(repr(tuple(r)) for r in got) == wanted, tile


def test_no_rows_and_a_very_long_text(spark):
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    rng = random.Random(6)
    head, body = [f"w{rng.randrange(5000)}" for _ in range(30_000)], [f"v{i}" for i in range(11_000)]
    long = head + body * 3 + ["end"] * 20_000
    row = runs.periodic_runs(spark.createDataFrame([(1, " ".join(long), "c", 1, "p", "s", "x")], DOCS)).first()
    assert (row["n_words"], row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (83_000, 2, 30_000, 33_000, 11_000, 3000)
    assert row["collapsed_sha256"] == hashlib.sha256(" ".join(head + body + ["end"]).encode()).hexdigest()


def test_pieces_of_the_solver():
    rng = np.random.default_rng(7)
    for _ in range(50):
        s = rng.integers(0, 2, rng.integers(1, 40)).tolist()
        direct = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert runs.z_function(s) == direct
    for n in (12, 100, 5000):
        for tile in (16, 512):
            for octave in runs.octaves(n):
                cores = [(a, b) for a, b, *_, group in runs.tiles(n, tile) if octave in group]
                assert cores[0][0] == 0 and cores[-1][1] == n and all(x[1] == y[0] for x, y in zip(cores, cores[1:]))
    assert [p for o in runs.octaves(100) for p in range(o.low, o.high)][:50] == list(range(1, 51))
    with pytest.raises(IndexError):
        runs.octaves(11)[0]
