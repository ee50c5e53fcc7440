import collections
import re

import duckdb
import numpy as np
import pytest

from tunelake.llm import phrases


def plain(rows, top=2000, least=10, longest=3):
    """Brute force over (lang, text) rows: {lang: [(phrase, a, l, r, n, score), ..]}."""
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {g: f for g, f in counts.items() if f >= least}
    out = collections.defaultdict(list)
    for (lang, g), a in often.items():
        inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        if len(g) < 2 or any(la == lang and len(h) > len(g) and inside(h) and 100 * f >= 50 * a for (la, h), f in often.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (often[lang, g[:k]] * often[lang, g[k:]]), k, often[lang, g[:k]], often[lang, g[k:]]) for k in range(1, len(g)))  # noqa: E741
        out[lang].append((" ".join(g), a, l, r, n[lang], score))
    return {la: sorted(x, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top] for la, x in out.items()}


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta", "gam\x0bma", "délta", "你", "x", "y\x00z", "new york city", "new\tyork"]
    say = lambda n: "".join(words[rng.integers(len(words))] + [" ", " ", ". ", "\n", "  "][rng.integers(5)] for _ in range(n))
    rows = [("en", say(60)) for _ in range(30)] + [("fr", say(40)) for _ in range(8)] + [(None, say(30)), ("und", say(30)), ("en", None), ("fr", ""), ("de", " .,; \n"), (None, None)]
    rows += [("en", "in the middle of nowhere " * 12), ("en", "word " * 300), rows[0], rows[0]]
    return [(i % 7, t, la, "s", 1.0, "p") for i, (la, t) in enumerate(rows)]


def test_phrases_by_brute_force(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, phrase string, score double, w0 string").repartition(3)
    want = plain([(r[2], r[1]) for r in texts])
    assert want["en"] and want["fr"] and want["und"]
    # shards of a few words cut texts and pieces; small bitmaps let through what the sums then drop
    for how in ({}, {"shard_words": 7}, {"bits": 8}, {"top": 3}):
        got = collections.defaultdict(list)
        for r in sorted(phrases.collocations(df, **how).collect(), key=lambda r: (r.lang, r.rank)):
            got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
            assert r.rank == len(got[r.lang])
        assert got == {la: x[: how.get("top", 2000)] for la, x in want.items()}, how


def test_longer_phrases(spark, texts):
    df = spark.createDataFrame([r[1:3] for r in texts], "text string, lang string")
    want = plain([(r[2], r[1]) for r in texts], longest=5)
    got = collections.defaultdict(list)
    for r in sorted(phrases.collocations(df, max_words=5, shard_words=50).collect(), key=lambda r: (r.lang, r.rank)):
        got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == want


def test_sql_on_edges(spark, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in texts])
    rel = con.sql(phrases.ORACLE)
    got = phrases.collocations(spark.createDataFrame([r[:3] for r in texts], "doc_id long, text string, lang string"))
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_no_texts(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], empty.schema)).count() == 0


def test_extensions_in_both_directions():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 9, 500)
    text[[90, 200, 201, 499]] = 0
    left, right = phrases.index(text, 9, 4)
    found = phrases.Phrases(np.bincount(text, minlength=9), left, right)
    for side in (1, 0, 0):
        found.extend(side)
        k = found.words.shape[1]
        grams = collections.Counter(tuple(text[i : i + k].tolist()) for i in range(len(text) - k + 1))
        assert {tuple(map(int, w)): int(n) for w, n in zip(found.words, found.size)} == {g: n for g, n in grams.items() if all(g)}
    keys = [tuple(text[i : i + 4].tolist()) for i in phrases.order_by(np.r_[text, 0, 0, 0], 1 << 20, 4) if i + 4 <= len(text)]
    assert keys == sorted(keys)


def test_very_long_text(spark):
    df = spark.createDataFrame([("one two three " * 400_000, "en"), ("long-word" * 300_000, "en")], "text string, lang string")
    got = phrases.collocations(df, shard_words=300_000).collect()
    assert {(r.phrase, r.a, r.n) for r in got} == {("one two three", 400_000, 1_200_001), ("three one two", 399_999, 1_200_001), ("two three one", 399_999, 1_200_001)}
