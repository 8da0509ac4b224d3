"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from tidelog.llm.ngram_join import needed, ngram_components, parities, prefix_length, shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def set_of(text, n):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {" ".join(words)} if words else set()


def brute_force(rows, n, percent):
    sets = [set_of(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), names.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def rows_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t ", "one two", "One TWO", "one two three", "a b c d", "a b c d", "A B C D", "same\x85word x y z"]
    shared = [f"boiler{j}" for j in range(60)]
    for size in (12, 40, 150, 600):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base)] + [near(rng, base, c) for c in (1, 1, 2, 3, 4, 6, 9)] + [" ".join(base[: size * 9 // 10]), " ".join(base[size // 10 :])]
    # Alike, but for the most part not enough, and a passage that all share.
    base = [f"v{rng.randint(0, 300)}" for _ in range(200)]
    texts += [near(rng, base, 7) for _ in range(25)] + [" ".join(shared + [f"own{rng.randint(0, 10**6)}" for _ in range(k)]) for k in (0, 2, 5, 8, 12, 60, 60)]
    # One changed word in long texts: equal size, and often an equal prefix.
    base = [f"u{rng.randint(0, 10**6)}" for _ in range(300)]
    texts += [near(rng, base, 1) for _ in range(25)]
    rows = list(enumerate(texts))
    rows += [(None, "only null ids here now"), (None, "only null ids here now"), (3, "a b c d e"), (rows[12][0], rows[12][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 60)])
def test_equals_all_pairs(spark, n, percent):
    rows = rows_of(percent)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string").repartition(3)
    got = sorted((tuple(r) for r in ngram_components(frame, n, percent).collect()), key=str)
    assert got == brute_force(rows, n, percent)


def test_empty_table(spark):
    result = ngram_components(spark.createDataFrame([], "doc_id long, text string"))
    assert result.columns == ["doc_id", "n_shingles", "component_id"] and result.count() == 0


def test_parities_differ_in_no_more_bits_than_sets():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (set(rng.sample(range(1 << 40), rng.randint(0, 50))) for _ in range(2))
        b |= set(rng.sample(sorted(a), len(a) // 2))
        one, other = (parities(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(int(x).bit_count() for x in (one ^ other).view(np.uint64)) <= len(a ^ b)


def test_prefixes_meet():
    for a in range(1, 60):
        for b in range(a, 70):
            common = needed(a, b, 85, 100)
            assert common <= a or 100 * a < 85 * b
            if 100 * a >= 85 * b:
                assert 100 * common >= 85 * (a + b - common) and 100 * (common - 1) < 85 * (a + b - common + 1)
                assert a - common < prefix_length(a, 85, 100) and b - common < prefix_length(b, 85, 100)


def test_words_in_pieces():
    text = ("Ab\tc " * 400_000).encode()
    assert len(word_hashes(text)) == 800_000 and len(shingles(text, 4)) == 2
    assert len(word_hashes(b"x" * 3_000_000)) == 1
