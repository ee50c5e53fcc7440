"""Candidates for fuzzy ratios: every pair that scores, on words made to be hard."""

import itertools
import random

import numpy as np
import pytest

from tunelake.functions import fuzzy, names
from tunelake.functions.text import fuzz_process, weighted_ratio


def titles(n, seed, most=4):
    rnd = random.Random(seed)
    words = ["ab", "cd", "a", "b", "the", "of", "cold", "colt", "ring", "rings", "ba", "abc", "na", "na", "é", "go", "mountain", "mountains", "x"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, most + 1))) for _ in range(n)]
    return [*dict.fromkeys([*out, "", "$$", "ab cd", "cd ab", "a b", "b a", "na na na hey", "hey na", "la la la la", "la di do hey", "Ab-Cd", "ab cd ost", "abcdefghijklmnop", "abcdefghijklmnoq", "bcdefghijklmnop", "the winding mountain road", "winding mountain road the", "road winding the mountain"])]


@pytest.mark.parametrize("threshold", [90, 95, 100])
def test_no_pair_is_lost(threshold):
    """The keys alone, against all pairs, whatever the counts are."""
    texts = titles(500, threshold)
    for counts in (np.zeros(fuzzy.BUCKETS, np.int64), np.random.default_rng(1).integers(0, 50, fuzzy.BUCKETS)):
        left, right = ({t: fuzzy.index_keys(t, threshold, counts, side) for t in texts} for side in (True, False))
        near = [(a, b) for a, b in itertools.product(texts, texts) if weighted_ratio(a, b) >= threshold]
        assert len(near) > len(texts)
        assert not [(a, b) for a, b in near if not left[a].keys() & right[b].keys()]


def test_no_pair_of_long_or_edited_texts_is_lost():
    rnd = random.Random(7)
    zero = np.zeros(fuzzy.BUCKETS, np.int64)
    n = 0
    for _ in range(4000):
        words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(1, 9))]
        a = " ".join(words)
        b = list(a)
        for _ in range(rnd.randrange(1, 2 + len(a) // 7)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "", "z", " ", "a", rnd.choice("abcde")])
        b = "".join(b)
        if rnd.random() < 0.5:
            b = " ".join(rnd.sample(b.split(), len(b.split())))
        if weighted_ratio(a, b) >= 90:
            n += 1
            assert fuzzy.index_keys(a, 90, zero, True).keys() & fuzzy.index_keys(b, 90, zero, False).keys(), (a, b)
    assert n > 500


def test_candidates_are_all_pairs(spark):
    texts = titles(150, 5)
    rows = [(i % 3 if i % 17 else None, t) for i, t in enumerate(texts)] + [(1, None), (0, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "artist int, t string")
    left, right = df.withColumnRenamed("t", "left"), df.withColumnRenamed("t", "right")
    kept = {r for r in rows if r[0] is not None and r[1] is not None}
    want = {(a[0], a[1], b[1], s) for a, b in itertools.product(kept, kept) if a[0] == b[0] and (s := weighted_ratio(a[1], b[1])) >= 90}
    got = [tuple(r) for r in fuzzy.candidates(left, right, ("artist",)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    every = [tuple(r) for r in fuzzy.candidates(left.select("left"), right.select("right")).collect()]
    assert set(every) == {(a, b, s) for a, b in itertools.product({r[1] for r in rows if r[1] is not None}, repeat=2) if (s := weighted_ratio(a, b)) >= 90}
    with pytest.raises(ValueError):
        fuzzy.candidates(left, right, threshold=80)
    assert fuzzy.candidates(left.limit(0), right).count() == 0


def test_common_parts_are_not_joined():
    """Of texts that share a beginning only what tells them apart is indexed, so pairs don't grow with the square."""
    rnd = random.Random(3)
    texts = ["the song of " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2000)]
    counts = np.zeros(fuzzy.BUCKETS, np.int64)
    for t in texts:
        for p in fuzzy.parts(t):
            counts[fuzzy.bucket(p)] += 1
    left, right = ([fuzzy.index_keys(t, 90, counts, side) for t in texts] for side in (True, False))
    found = {}
    for side, keys in enumerate((left, right)):
        for own in keys:
            for k in own:
                found.setdefault(k, [0, 0])[side] += 1
    assert sum(a * b for a, b in found.values()) < 0.05 * len(texts) ** 2 and max(map(len, left)) < 120


def test_names_that_match_share_a_key():
    """Names as one word, with Hangul and its spellings."""
    rnd = random.Random(2)
    some = [*titles(160, 9), "sonyeo sidae", "Tae Yeon", "Taeyeon OST", "bak"]
    none = dict.fromkeys(names.FIELDS)
    own = [none | {"eng": t, "versions": ()} for t in some] + [none | {"non_eng": t, "versions": ()} for t in ("소녀시대", "태연", "박", "少女")] + [none | {"eng": rnd.choice(some), "non_eng": "태연", "romanized": "x y", "versions": ()}, none | {"eng": "xy", "versions": ()}]
    counts = np.zeros(fuzzy.BUCKETS, np.int64)
    keys = [names.match_keys(x, 90, counts) for x in own]
    for (a, x), (b, y) in itertools.combinations(list(zip(own, keys)), 2):
        if names.score(a, b) >= 90:
            assert {k for k, _ in x} & {k for k, _ in y}, (a, b)
    assert fuzz_process("Taeyeon OST") == "taeyeon"
