import collections
import hashlib
import math
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunelake.llm import common, decontam, licenses, linear, lm, pieces, pii, quality, registry, rules, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def base_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(edge, empty):
    got = rows_of(pii.report(edge.select("doc_id", "text", "spans")).withColumnRenamed("doc_id", "i"))
    texts = collections.defaultdict(list)
    for r in edge.collect():
        texts[r.doc_id].append(hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest())
    assert len(got) == edge.count()
    assert all(r["base_sha256"] in texts[r["i"]] for r in got)
    spans = {r["i"]: r["spans"] for r in got}
    assert spans[10] == "iban:5:32" and spans[12] == "ssn:4:15" and spans[11] == "email:0:5,email:5:11"
    assert pii.report(empty).count() == 0
    texts = ["123-45-6789 is my SSN", "lessn 123-45-6789", "ip 1.2.3.4", "ship 1.2.3.4", "x" * 3000 + " ssn " + "y" * 36 + "123-45-6789", "x" * 3000 + " ssn " + "y " * 18 + "123-45-6789", "social security: \U0001f600 123-45-6789", "1.2.3.4" + " " * 40 + "host"]
    got = pii.report(edge.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.scores for r in got] == ["ssn:0:0.80", "", "ip:3:0.80", "ip:5:0.60", "", "ssn:3041:0.80", "ssn:19:0.80", "ip:0:0.60"]
    many = edge.sparkSession.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("a@b.cd "), 25_000).alias("text"))
    assert pii.report(many).first().n_email == 25_000
    clean = {r["doc_id"]: r for r in rows_of(pii.redacted(edge))}
    assert clean[9]["text"] == "card [CARD] not 4111 1111 1111 1112" and clean[9]["n_chars"] == len(clean[9]["text"])
    assert clean[0]["text"] is None and clean[16]["text"] == edge.filter("doc_id = 16").first().text
    assert pii.redacted(edge).columns == edge.columns


def test_contamination(edge, empty, benchmark_table):
    items = collections.defaultdict(set)
    for r in benchmark_table.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        for k in range(max(1, len(w) - 12) if w else 0):
            items[tuple(w[k : k + 13])].add(str(r.item_id))
    want = collections.Counter()
    for r in edge.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        hit, found = set(), set()
        for win, of in items.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= of
        want[r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for how in ({}, {"shard_words": 50}, {"phrase_bytes": 60}):
        got = collections.Counter(tuple(r) for r in decontam.contamination(edge, benchmark_table, **how).collect())
        assert got == want, how
    assert decontam.contamination(empty, benchmark_table).count() == 0
    none = decontam.contamination(edge, benchmark_table.filter("false"))
    assert none.filter("n_hit > 0 OR contaminated").count() == 0 and none.count() == edge.count()
    kept = decontam.decontaminated(edge, benchmark_table)
    assert kept.columns == edge.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    cut = {r.doc_id: r.text for r in decontam.excised(edge, benchmark_table).collect() if r.doc_id is not None}
    assert cut[3] == "" and cut[4] == " two" and cut[0] is None and cut[13] == edge.filter("doc_id = 13").first().text
    assert decontam.without_spans("A b, c d", [(1, 3)]) == "A  d"


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 600).astype(np.int32)
    text[[99, 250, 599]] = 0
    inside = np.arange(600) - np.repeat([0, 100, 251], [100, 151, 349])
    index = decontam.FMIndex(text, inside, 5)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 5, (30, n))
        live, low, high = index.search(phrases)
        found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(live, low, high)}
        for k, p in enumerate(phrases):
            assert found.get(k, []) == [i for i in range(600 - n + 1) if (text[i : i + n] == p).all()]


def test_quality(edge, empty, labels_table):
    got = rows_of(quality.classify(edge, labels_table))
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got)
    assert quality.classify(empty, labels_table).count() == 0
    assert {round(r["score"], 6) for r in rows_of(quality.classify(edge, labels_table.filter("false")))} == {0.5}
    kept = quality.good(edge, labels_table)
    assert kept.columns == edge.columns and kept.count() == sum(r["predicted"] for r in got)


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()


def test_dual_coordinate_descent_separates():
    sets = [np.array([0, 2 + i % 3]) if i % 2 else np.array([1, 2 + i % 3]) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    model, out_of_fold = linear.fit(sets, y, 8)
    assert all((model.margin(s) > 0) == (t > 0) for s, t in zip(sets, y)) and ((out_of_fold > 0.5) == y).all()


def test_simhash(edge, empty):
    rows = edge.select("doc_id", "text").collect()
    fps = []
    for r in rows:
        w = WORD.findall(lower(r.text))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        import xxhash

        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    least = {g: min((r.doc_id for r, k in zip(rows, group) if k == g and r.doc_id is not None), default=None) for g in set(group)}
    want = collections.Counter((r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group))
    for limit in (1, simhash.RUN_LIMIT):
        assert collections.Counter(tuple(r) for r in simhash.near_duplicates(edge, run_limit=limit).collect()) == want
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_of_crowded_keys(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    values = {centre ^ int(sum(1 << int(b) for b in rng.choice(64, int(k), replace=False))) for k in rng.integers(0, 5, 400)} | {int(x) for x in rng.integers(1 << 62, size=200)}
    values = sorted(v - (v >> 63 << 64) for v in values)
    mask = (1 << 64) - 1
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & mask).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                group[y] = x
    for limit in (8, 1024):
        edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), limit)
        got = dict(map(tuple, simhash.connected_components(edges).collect()))
        assert {v: got.get(v, v) for v in values} == {v: top(v) for v in values}


def library_spans(sp, text):
    """Each piece's span in original bytes by the library's own offsets; of a character in byte pieces, None but at its edges."""
    out = []
    for p in sp.encode(text, return_type="proto").pieces:
        one = re.fullmatch("<0x..>", p.piece) is not None
        out.append((None if one and (p.begin == p.end or (out and out[-1][1] is None)) else p.begin, None if one and p.begin == p.end else p.end))
    return out


def test_pieces(edge, empty):
    import sentencepiece

    model = pieces.read_model(None, registry.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for r in edge.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))] += 1
    got = pieces.encode_digest(edge, registry.model_path()).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == want
    assert pieces.encode_digest(empty, registry.model_path()).count() == 0
    full = pieces.encode(edge, model, keep=["doc_id", "text"])
    spans = collections.Counter()
    for r in full.collect():
        text = (r.text or "").encode()
        assert r.decoded == sp.decode(r.ids) and list(r.starts) == sorted(r.starts) and r.ends[-1] == len(text)
        assert b"".join(text[a:b] for a, b in zip(r.starts, r.ends)) == text
        theirs = library_spans(sp, r.text or "")
        assert len(theirs) == len(r.ids) - 1
        assert all((a is None or a == c) and (b is None or b == d) for (a, b), c, d in zip(theirs, r.starts, r.ends))
        spans[r.doc_id, hashlib.sha256(np.array([*zip(r.starts, r.ends)], "<i4").tobytes()).hexdigest()] += 1
    assert spans == collections.Counter((r.doc_id, r.spans_sha256) for r in got)
    assert {tuple(r) for r in pieces.decode(full, model, name="again").select("decoded", "again").collect()} == {(r.decoded, r.decoded) for r in full.collect()}


def charsmap(rules):
    """A compiled map of single-step tries, built for the test: rules map byte strings to byte strings."""
    trie = {}
    for k, v in rules.items():
        node = trie
        for b in k:
            node = node.setdefault(b, {})
        node["v"] = v
    units, texts = [0] * 65536, b""
    used, free = {0}, [256]

    def place(node, at):
        nonlocal texts
        base = free[0]
        free[0] += 256
        units[at] |= (at ^ base) << 10 if (at ^ base) < 1 << 21 else 0
        if "v" in node:
            units[at] |= 1 << 8
            units[base] = 1 << 31 | len(texts)
            texts += node["v"] + b"\0"
        for b, child in node.items():
            if b != "v":
                units[base ^ b] = b
                place(child, base ^ b)

    place(trie, 0)
    import struct

    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts


def test_normaliser_takes_the_longest_prefix_and_keeps_places():
    n = object.__new__(pieces.Normalizer)
    n.map = pieces.CharsMap(charsmap({b"a": b"A", b"ab": b"xyz", b"\xc3\xa9": b"e", b"\t": b" "}))
    n.dummy = n.squeeze = n.escape = True
    n.suffix = n.plain = False
    got, places = n("  aab\té  ".encode())
    assert got.decode() == "▁Axyz▁e"
    assert places.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 5, 5, 6, 8]


def test_language_model(edge, empty):
    rows = edge.collect()
    c = collections.Counter()
    for r in rows:
        if crc(r.doc_id, 7) != 2:
            c.update([*WORD.findall(lower(r.text)), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in rows:
        words = [*WORD.findall(lower(r.text)), None]
        want[r.doc_id, crc(r.doc_id, 7) == 2, len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)] += 1
    for hot in (10, 100_000):
        got = lm.score_all(edge, hot=hot).collect()
        assert collections.Counter((*r[:5], round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm.score_all(empty).count() == 0
    nothing = lm.score_all(edge.filter("doc_id = 0 OR doc_id = 1")).collect()
    assert all(r.n_tokens == 1 for r in nothing)


def vocabulary():
    return lm.Vocabulary({bytes([65 + i]): i for i in range(40)}, 7, np.arange(40) + 1.0, np.full(lm.SPELLINGS, 9.0), np.full(lm.SPELLINGS, 4.0))


def test_language_model_scores_equal_a_plain_walk(edge):
    """Each document's score, from the same counts and parameters, one token after the other in float64."""
    model = lm.train(edge, rates=(5e-3, 2e-3))
    words, v = model.words, model.words.vocabulary
    counts = {bytes(r.word): r.n for r in words.counts.collect()}
    p = {k: x.astype(np.float64) for k, x in lm.shaped(model.parameters, v).items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    want = {}
    for r in edge.collect():
        if r.doc_id is None:
            continue
        h, before, total, d = np.zeros(lm.WIDTH), v.symbols[b""], 0.0, lm.WIDTH
        for w in lm.tokens(None if r.text is None else r.text.encode()):
            x, a = p["inputs"][before], h @ p["recur"]
            reset, keep = sigmoid(x[:d] + a[:d]), sigmoid(x[d : 2 * d] + a[d : 2 * d])
            h = keep * h + (1 - keep) * np.tanh(x[2 * d :] + reset * (a[2 * d :] + p["bias_n"]))
            i = v.symbols.get(w)
            every = softmax(np.append(h, 1) @ p["to_class"])
            if i is None:
                s = lm.spelling(w)
                share = (counts.get(w, 0) + 1) / (v.rest[s] + v.kinds[s] + 1)
                total += math.log10(every[v.learned + s] * share)
                before = v.known + s
            else:
                total += math.log10(every[i // v.size] * softmax(np.append(h, 1) @ p["to_word"][i // v.size])[i % v.size])
                before = i
        want[r.doc_id] = total
    got = {r.doc_id: r.score for r in lm.score(edge, model).collect() if r.doc_id is not None}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-4) for i in want)


@pytest.mark.parametrize("partitions", [4, 64])
def test_language_model_beats_its_base_on_held_out_documents(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    held = lm.score_all(docs).filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert held.score > held.base + 0.1 * held.n


def test_language_model_is_a_distribution():
    v = vocabulary()
    p = {k: x.astype(np.float64) for k, x in lm.start(v).items()}
    rng = np.random.default_rng(0)
    for big in (1, 300):
        p["to_class"][: lm.WIDTH] *= big
        for h in rng.uniform(-1, 1, (4, lm.WIDTH)):
            assert abs(np.exp(lm.outputs(p, v, np.tile(h, (v.n, 1)), np.arange(v.n))[0]).sum() - 1) < 1e-6


def test_language_model_gradients_and_windows():
    rng, v = np.random.default_rng(1), vocabulary()
    p = {k: x.astype(np.float64) for k, x in lm.start(v, 5).items()}
    docs = [rng.integers(0, v.n, size=k).astype(np.int32) for k in (7, 5, 3)]
    _, own, given, target, mask = next(iter(lm.windows(docs, 3, 8)))

    def loss(q):
        states, _ = lm.forward(q, given, np.zeros((3, 5)))
        return -lm.outputs(q, v, states[mask], target[mask])[0].sum()

    grads = {k: np.zeros_like(x) for k, x in p.items()}
    states, kept = lm.forward(p, given, np.zeros((3, 5)))
    back = np.zeros_like(states)
    back[mask] = lm.outputs(p, v, states[mask], target[mask], grads)[1]
    lm.backward(p, given, kept, back, grads)
    for k in lm.NAMES:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        up, down = ({a: x.copy() for a, x in p.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - grads[k][at]) < 1e-4
    f = lm.start(v)
    docs = [rng.integers(0, v.n, size=k).astype(np.uint16) for k in (700, 5, 1, 90)]
    assert np.allclose(lm.score_documents(f, v, docs, window=2), lm.score_documents(f, v, docs, lanes=2, window=64), atol=1e-3)


def test_vectors_are_summed_in_a_tree(spark):
    rows = [(k, np.full(3, float(k)).tobytes()) for k in range(1, 400)]
    n, total = lm.summed(spark.createDataFrame(rows, "n long, p binary").repartition(300))
    assert n == sum(range(1, 400)) and total.tolist() == [n] * 3


def test_shards(edge, empty):
    got = rows_of(sharding.assign(edge))
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in edge.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert sharding.assign(empty).count() == 0


def test_shards_cut_one_hot_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("the same text again")).alias("text"))
    got = sharding.assign(docs, cell_rows=300).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    bytes_ = [r.bytes for r in got]
    assert len(got) == 16 and max(bytes_) - min(bytes_) <= 60 and all(r.last == r.n - 1 for r in got)


def signed(h):
    return h - (h >> 63 << 64)


def test_rules(spark, edge, empty, labels_table):
    import xxhash

    trusted = labels_table.filter("quality = 1")
    rows, n = edge.collect(), rules.BUCKETS
    extra = spark.createDataFrame([("same " * 30 + t,) for t in "ab"] + [(" ".join(f"new{k}" for k in range(80)),)], "text string").select(F.lit(5000).cast("long").alias("doc_id"), "text")
    rows = [*rows, *extra.collect()]
    docs = edge.select("doc_id", "text").union(extra)

    def buckets(w):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        return [signed(x) % n for x in h] + [signed(xxhash.xxh64_intdigest(b.encode(), a)) % n for a, b in zip(h, w[1:])]

    ids = {r.doc_id for r in trusted.collect()} - {None}
    raw, good = collections.Counter(), collections.Counter()
    for r in rows:
        found = buckets(WORD.findall(r.text or ""))
        raw.update(found)
        good.update(found if r.doc_id in ids else [])
    ratio = [math.log((good[b] + 1) / (sum(good.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in range(n)]
    got = collections.Counter((*tuple(r)[:7], None if r.llr is None else round(r.llr, 9), r.kept) for r in rules.judge(docs, trusted).collect())
    want = collections.Counter()
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        grams = list(zip(w, w[1:], w[2:]))
        times = collections.Counter(grams)
        again = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        llr = sum(ratio[b] for b in buckets(w)) / len(buckets(w)) if w else None
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed, None if llr is None else round(llr, 9), not failed and llr >= rules.THRESHOLD] += 1
    assert got == want
    assert {k[-1] for k in want if not k[6]} == {True, False}  # the verdict rejects some that the base rules let pass
    assert rules.judge(empty, trusted).count() == 0
    assert rules.judge(edge, trusted.filter("false")).filter("kept = base_failed").count() == 0


def test_bitmap_of_ids_lets_all_of_them_pass(spark):
    ids = spark.range(0, 100_000, 50).select(F.col("id").alias("doc_id"))
    passed = spark.range(100_000).filter(rules.maybe_in(F.col("id"), ids, 16))
    assert passed.filter("id % 50 = 0").count() == 2000 and passed.count() < 10_000


def license_texts():
    full = {name: text for name, text in licenses.TEMPLATES if name in ("MIT", "BSD-3-Clause", "ISC")}
    wrap = lambda text, width, mark="": "\n".join(mark + x for x in textwrap.wrap(text, width))
    grant = licenses.TEMPLATES[4][1]
    code = "\n".join(f"def f{k}(x): return x * {k}  # step {k}" for k in range(40))
    return {
        "file": ("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(full["MIT"], 78), "MIT"),
        "above code": (wrap(full["MIT"], 70, "# ") + "\n" + code, "MIT"),
        "below code": (code + "\n/*\n" + wrap(full["BSD-3-Clause"], 60, " * ") + "\n */", "BSD-3-Clause"),
        "forty": ("\n".join([wrap(grant, 60)] * 40), "MIT"),
        "within a line": ("This page was written by us. Released under the MIT License. Please share it.", "MIT"),
        "version 3": ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        "version 2": ("Note: this work is licensed under the GNU General Public License, version 2. Thanks", "GPL-2.0"),
        "two": (full["ISC"] + "\nand\n" + licenses.TEMPLATES[1][1], "Apache-2.0,ISC"),
        "changed": (full["ISC"].replace("THE AUTHOR", "ACME INC").replace("software", "program"), "ISC"),
        "talk": ("The license of the software may be of any version, without fee, and all rights and copies use the source.", ""),
        "half": (" ".join(grant.split()[:30]), ""),
        "marks": ("// \u00a9 2020 \u2014 All rights reserved.", "LicenseRef-Proprietary"),
    }


def test_licence_words_decide(spark):
    """A copyright line isn't a licence of its own, grants say whether later versions count, tags name one, and a chain keeps its ends."""
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause")
    grant = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    texts = {
        "Copyright (c) 2010, X. All rights reserved.\n\n" + bsd: "BSD-3-Clause",
        "a\n(c) 2020 X Corp. All rights reserved.\nb": "LicenseRef-Proprietary",
        "Those who say that all rights reserved by law are void.": "",
        grant + " It is given away in the hope": "GPL-2.0-only",
        "// SPDX-License-Identifier: MIT\nint x;": "MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "SPDX-License-Identifier: Unknown-1.0": "",
        "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://x.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": "LGPL-3.0",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licenses for r in licenses.report(docs).orderBy("doc_id").collect()] == list(texts.values())
    one, two, three = ("one", "alpha beta gamma delta"), ("two", "gamma delta epsilon zeta"), ("three", "epsilon zeta eta theta iota")
    chain = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta x")], "doc_id long, text string")
    assert licenses.report(chain, templates=(one, two, three)).first().licenses == "one,three"
    many = spark.createDataFrame([(1, "Released under the MIT License. And so on. " * 3000)], "doc_id long, text string")
    assert licenses.report(many).first().n_license_units == 3000


def test_licenses(spark, edge, empty):
    got = {r["doc_id"]: r for r in rows_of(licenses.report(edge))}
    assert got[16]["licenses"] == "MIT" and got[16]["best_dice"] == 1.0 and got[16]["n_license_units"] == 1
    assert got[0]["n_license_units"] == 0 and got[0]["best_license"] is None and licenses.report(empty).count() == 0
    texts = license_texts()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()] + [("word", "license")], "doc_id string, text string")
    found = {r["doc_id"]: r for r in rows_of(licenses.report(docs))}
    assert {k: r["licenses"] for k, r in found.items()} == {k: want for k, (_, want) in texts.items()} | {"word": ""}
    assert found["forty"]["n_license_units"] == 40 and found["file"]["best_dice"] == 1.0 and found["file"]["n_license_units"] == 1


def test_no_template_can_match_without_a_key(spark):
    words = set(licenses.key_words(licenses.TEMPLATES))
    for _, t in licenses.TEMPLATES:
        every = set(licenses.pairs(licenses.template_words(t)))
        left = {p for p in every if not words & set(p.split())}
        assert 2 * len(left) / (len(left) + len(every)) < licenses.DICE


def on_duckdb(sql, columns, **tables):
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.select(*[c for c in ("doc_id", "item_id", "text", "quality", "toxic") if c in df.columns]).toArrow())
    return sorted(map(repr, con.sql(sql).select(*[f'"{c}"' for c in columns]).fetchall()))


def test_sql_on_edge_rows(spark, edge, benchmark_table):
    texts = spark.createDataFrame([(1000 + i, t) for i, (t, _) in enumerate(license_texts().values())], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(texts)
    for got, sql in ((licenses.report(docs), licenses.ORACLE), (pii.report(docs), pii.ORACLE), (decontam.contamination(docs, benchmark_table), decontam.ORACLE)):
        assert sorted(map(repr, map(tuple, got.collect()))) == on_duckdb(sql, got.columns, documents=docs, benchmark=benchmark_table)


def test_toxicity(edge, empty, labels_table, spark):
    got = rows_of(toxicity.classify(edge, labels_table))
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got) and toxicity.classify(empty, labels_table).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    assert held.filter("predicted = toxic").count() >= 0.97 * held.count()
    assert held.filter("toxic = 1 AND predicted = 1").count() >= 0.9 * held.filter("toxic = 1").count()


def test_toxicity_equals_a_plain_version(edge, labels_table):
    """Features, the chain's order and every probability, one document and one weight at a time."""
    import xxhash

    models = toxicity.train(edge, labels_table)
    assert len(models) == len(toxicity.CHAIN) and [len(m.extra) for m in models] == [0, 1, 2, 3]
    want = collections.Counter()
    for r in edge.collect():
        words = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(r.text)))
        grams = {w.encode() for w in words} | {b"^" + w.encode()[:k] for w in words for k in (4, 5, 6) if len(w.encode()) > k}
        found = {xxhash.xxh64_intdigest(g) >> (64 - toxicity.BITS) for g in grams}
        got = []
        for m in models:
            margin = sum(float(m.weights[f]) for f in found) + sum(float(w) * p for w, p in zip(m.extra, got))
            got.append(1 / (1 + math.exp(-(m.a * margin + m.b))))
        want[r.doc_id, crc(r.doc_id, 5) == 0, *[round(p, 9) for p in got], int(got[-1] >= toxicity.THRESHOLD)] += 1
    got = collections.Counter((r.doc_id, r.held_out, *[round(r[f"p_{k}"], 9) for k in toxicity.CHAIN], r.predicted) for r in toxicity.classify(edge, labels_table).collect())
    assert got == want


def test_toxicity_kinds_are_found_and_the_chain_uses_them():
    rng = np.random.default_rng(4)
    sets, toxic, kind = [], [], []
    for k in range(600):
        own = set(rng.integers(40, 1000, 30).tolist())
        bad = int(k % 3 == 0)
        if bad:
            own |= set((rng.choice(15, 4, replace=False) + 20 * (k % 2)).tolist())
        sets.append(np.array(sorted(own)))
        toxic.append(bad)
        kind.append(k % 2)
    toxic = np.array(toxic)
    made = toxicity.categories(sets, toxic, 1024)
    own = np.flatnonzero(toxic)
    agree = (made[own, 1] == np.array(kind)[own]).mean()
    assert max(agree, 1 - agree) > 0.98 and (made[:, 0] + made[:, 1] == toxic).all() and (made[:, 2] <= toxic).all() and 0 < made[:, 2].sum() < toxic.sum()
    models = [*toxicity.fit_chain(sets, made, 10)]
    alone = linear.fit(sets, toxic, 1024)[0]
    chained = [toxicity.predict_chain(models, s) for s in sets]
    assert np.abs(models[-1].extra).max() > 0 and max(abs(c[-1] - alone.probability(alone.margin(s))) for c, s in zip(chained, sets)) > 1e-3
    assert toxicity.categories(sets[:2], np.array([1, 0]), 1024)[:, 3].tolist() == [1, 0]


def plain_fit(sets, y, size, folds=4):
    """Naive Bayes support vectors with dicts and loops: the weights, and out-of-fold margins."""

    def once(own):
        count = [collections.Counter(f for i in own if y[i] == c for f in sets[i]) for c in (0, 1)]
        total = [sum(c.values()) + size for c in count]
        ratio = {f: math.log((count[1][f] + 1) / total[1]) - math.log((count[0][f] + 1) / total[0]) for f in range(size) if count[0][f] + count[1][f] > 1}
        w, a, rng = collections.defaultdict(float), [0.0] * len(own), np.random.default_rng(0)
        share = sum(y[i] for i in own) / len(own)
        for _ in range(12):
            moved = 0.0
            for k in rng.permutation(len(own)):
                i, sign = own[k], 1 if y[own[k]] else -1
                norm = max(sum(ratio.get(f, 0) ** 2 for f in sets[i]), 1e-12)
                g = sign * sum(w[f] * ratio.get(f, 0) for f in sets[i]) - 1
                new = min(max(a[k] - g / norm, 0), 0.5 / (share if sign > 0 else 1 - share))
                for f in sets[i]:
                    w[f] += (new - a[k]) * sign * ratio.get(f, 0)
                moved, a[k] = max(moved, abs(new - a[k]) * norm**0.5), new
            if moved < 1e-3:
                break
        return {f: w[f] * ratio.get(f, 0) for f in w}

    margins = [0.0] * len(sets)
    for fold in range(folds):
        part = once([i for i in range(len(sets)) if i % folds != fold])
        for i in range(fold, len(sets), folds):
            margins[i] = sum(part.get(f, 0) for f in sets[i])
    return once(list(range(len(sets)))), margins


def test_quality_equals_a_plain_version(edge, labels_table):
    import xxhash

    mask = (1 << 64) - 1

    def features(text):
        words = [w.encode() for w in WORD.findall(lower(text))]
        shape = lambda w: re.sub(rb"(.)\1+", rb"\1", bytes(0x39 if 48 <= b <= 57 else 0x61 if chr(b).isalpha() and b < 128 or b >= 128 else b for b in w), flags=re.S)
        h = [xxhash.xxh64_intdigest(w) >> 16 for w in words]
        s = [xxhash.xxh64_intdigest(b"=") & 0xFFFF if k and h[k] == h[k - 1] else xxhash.xxh64_intdigest(shape(w)) & 0xFFFF for k, w in enumerate(words)]

        def mix(parts, seed):
            x = 0x9E3779B97F4A7C15 + seed
            for p in parts:
                x = (x ^ p) * 0xFF51AFD7ED558CCD & mask
                x ^= x >> 33
            return x >> (64 - quality.BITS)

        out = {mix([a], 1) for a in h} | {mix([a, b], 2) for a, b in zip(h, h[1:])}
        return out | {mix(s[k : k + n], 2 + n) for n in (1, 2, 3) for k in range(len(s) - n + 1)}

    features_of = quality.Featurizer()
    rows = edge.collect()
    assert all(set(features_of((r.text or "").encode()).tolist()) == features(r.text) for r in rows)
    sample = linear.labelled_sample(edge, labels_table, common.with_crc_bucket("doc_id", 5) != 0, ["quality"], quality.SAMPLE_ROWS, quality.SAMPLE_BYTES)
    sets, y = [features(t.decode()) for t, _ in sample], [int(q > 0) for _, q in sample]
    weights, margins = plain_fit(sets, y, 1 << quality.BITS)
    model = quality.train(edge, labels_table)
    assert np.allclose([linear.sigmoid(np.float64(model.a * m + model.b)) for m in margins], linear.fit([np.array(sorted(s), np.int64) for s in sets], np.array(y), 1 << quality.BITS)[1], atol=1e-6)
    scores = {r.doc_id: r.score for r in quality.classify(edge, labels_table).collect()}
    for r in rows:
        margin = sum(weights.get(f, 0) for f in features(r.text))
        assert r.doc_id is None or abs(scores[r.doc_id] - 1 / (1 + math.exp(-(model.a * margin + model.b)))) < 1e-4


def test_shards_have_near_equal_bytes(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', int(pmod(hash(id), 400)))").alias("text")).repartition(5)
    sizes = [r.bytes for r in sharding.assign(docs).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 401 + 2 * sharding.TOLERANCE * sum(sizes) / 16


def test_very_long_texts(spark, labels_table, benchmark_table):
    """A text of a million words, larger than an index shard, and what each operator makes of it."""
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("w"), i % 50_000)), " ").alias("text"))
    docs = long.union(spark.createDataFrame([(2, "short text")], "doc_id long, text string")).cache()
    n = {r.doc_id: r.n_words for r in decontam.contamination(docs, benchmark_table).collect()}
    assert n == {1: 1_000_000, 2: 2}
    assert {r.doc_id: r.n_words for r in rules.judge(docs, labels_table.filter("quality = 1")).collect()} == n
    part = docs.withColumn("text", F.substring("text", 1, 600_000))  # a network goes through a text step by step
    assert {r.doc_id: r.n_tokens > 80_000 for r in lm.score_all(part, rates=(5e-3,)).collect()} == {1: True, 2: False}
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == 2
    assert licenses.report(docs).filter("n_license_units = 0").count() == 2 and pii.report(docs).filter("spans = ''").count() == 2
    assert quality.classify(docs, labels_table).count() == 2 and toxicity.classify(docs, labels_table).count() == 2
    assert sharding.assign(docs).filter("size > 6000000").count() == 1


def test_pipeline_on_edges(spark, edge, benchmark_table, labels_table, tmp_path):
    import corpus_pipeline

    edge.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    benchmark_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels_table.write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = common.written(out)
    assert out.count() == docs.count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.collect()) == key(want.select(*[f'"{c}"' for c in got.columns]).fetchall())


def test_near_dedup_links_all_pairs_of_the_similarity(spark, edge, empty):
    import random

    import corpus_pipeline

    rnd = random.Random(3)
    texts = []
    for _ in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(40, 250))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randrange(1, max(2, len(base) // 35))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = [i for i in range(len(sets)) if root[i] == i]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert len(want) < len(simhash.keep_one(docs).collect())
    kept = corpus_pipeline.near_dedup(spark, edge, "")
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} & {0, 5, 6, 7} == {0, 5}
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


def test_near_dedup_links_fingerprints(spark, monkeypatch):
    """Without any band the pairs that the fingerprints propose are still linked, and only those that are similar."""
    from tunelake.llm import neardup

    base = [f"w{k}" for k in range(400)]
    rows = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(base + base[:40]), " ".join(reversed(base)), "", None]
    monkeypatch.setattr(neardup, "bands", lambda hashes: [])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    fps = [simhash.voted(neardup.shingles((t or "").encode())) for t in rows]
    near = [i for i in range(1, 4) if (fps[0] ^ fps[i]).bit_count() <= simhash.DISTANCE]
    assert 1 in near and 3 not in near
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [i for i in range(5) if i not in near]
    monkeypatch.setattr(neardup, "SIMILARITY", (999, 1000))
    assert len(neardup.keep_one(docs).collect()) == 5


def test_blocks_of_a_band_link_all_pairs(spark, monkeypatch):
    import random

    from tunelake.llm import neardup

    rnd, rows = random.Random(5), []
    base = [f"w{k}" for k in range(150)]
    for _ in range(160):
        copy = list(base)
        for _ in range(rnd.randrange(0, 9)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(30)}"
        rows.append(" ".join(copy))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = [i for i in range(len(rows)) if root[i] == i]
    assert len(want) > 5
    monkeypatch.setattr(neardup, "BLOCK", 20_000)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == want
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == want


def test_labelled_sample_passes_over_what_does_not_fit(spark):
    docs = spark.createDataFrame([(i, f"{i:010d}") for i in range(12)], "doc_id long, text string")
    first = docs.orderBy(F.xxhash64("doc_id")).first().doc_id
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 1000)).otherwise(F.col("text")))
    docs = docs.union(docs.filter("doc_id % 4 = 0"))
    labels = docs.select("doc_id").distinct().withColumn("quality", F.lit(1))
    sample = lambda most, rows=100: linear.labelled_sample(docs, labels, F.lit(True), ["quality"], rows, most)
    short = sorted(r.text.encode() for r in docs.filter(f"doc_id <> {first}").collect())
    assert sorted(t for t, _ in sample(999)) == short
    assert len(sample(75)) == 7 and set(t for t, _ in sample(75)) <= set(short)
    assert len(sample(5000)) == docs.count() and len(sample(5000, 5)) == 5
    with pytest.raises(ValueError):
        sample(9)


def test_near_dedup_takes_the_driver_few_jobs(spark, edge):
    """Each job leaves its plans and stages with the driver, so their number is what it needs memory for."""
    from tunelake.llm import neardup

    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    assert neardup.keep_one(edge).count() > 0
    assert jobs() - before < 100


def test_outputs_are_made_in_chunks(monkeypatch):
    """Not all positions' class outputs at once, which leave the cache; probabilities and gradients are those of one chunk."""
    import tracemalloc

    v = lm.Vocabulary({bytes(str(i), "ascii"): i for i in range(40_000)}, 200, np.full(40_000, 2.0), np.full(lm.SPELLINGS, 9.0), np.full(lm.SPELLINGS, 4.0))
    rng, p = np.random.default_rng(3), lm.start(v)
    states, last = rng.uniform(-1, 1, (8000, lm.WIDTH)).astype(np.float32), rng.integers(v.known, v.n, 8000)
    got = []
    for chunk in (lm.CHUNK, 10_000):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        for targets in (last, rng.permutation(8000)):
            grads = {k: np.zeros(x.shape) for k, x in p.items()}
            tracemalloc.start()
            logp, back = lm.outputs(p, v, states, np.sort(targets), grads)
            got.append((logp, back, grads["to_class"], grads["to_word"], tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()
    every = 8000 * (v.learned + lm.SPELLINGS) * 4
    assert got[2][4] - got[0][4] > every / 2  # bytes
    for a, b in ((got[0], got[2]), (got[1], got[3])):
        assert all(np.allclose(x, y, rtol=1e-3, atol=1e-3) for x, y in zip(a[:4], b[:4], strict=True))


def test_words_are_cut_by_the_batch(spark, monkeypatch):
    """Slices of texts give the words and ends that each text alone gives, whatever its bytes."""
    texts = [None, "", " \t", "A", "\x0b\x1c É\xa0X \x85 a", " a" * 5, "x\x00 \x00", "b", "ü", "\r\nlong" * 40_000, "Za"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    monkeypatch.setattr(lm, "SLICE", 50)
    parts = list(lm.slices(batch, 0))
    assert len(parts) > 1 and [t for p in parts for t in p.column(0).to_pylist()] == texts
    raw = pa.array([b"A\xff \xc3 \xfe\n", b"\xff"], pa.binary())
    odd = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())  # bytes that aren't UTF-8 may lie in a column of texts
    many = pa.array([f"  One Two{k} three é\n" * (k % 5) for k in range(3000)])
    for column in (batch.column(0), batch.column(0).slice(3, 5), odd, many.slice(1000, 1500), many.slice(2999)):
        words, n = lm.cut(column)
        made = iter(words.to_pylist())
        want = [lm.tokens(t) for t in column.cast(pa.large_binary()).to_pylist()]
        assert [[*(next(made) for _ in range(k)), lm.END] for k in n.tolist()] == want
        by_end = np.array([lm.spelling(w) for w in lm.ENDS])
        assert lm.spellings(words, by_end).tolist() == [lm.spelling(w) for w in words.to_pylist()]
    counts = {bytes(r.word): r.n for r in lm.token_counts(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)).collect()}
    assert counts == collections.Counter(w for t in texts for w in lm.tokens(None if t is None else t.encode()))


def test_windows_write_into_the_same_arrays():
    """After the first window training makes few new arrays, and what a window returns doesn't depend on those before."""
    import tracemalloc

    rng, v = np.random.default_rng(2), vocabulary()
    p, room = lm.start(v), lm.Room()
    grads = {k: np.zeros_like(x) for k, x in p.items()}
    peaks = []
    for lanes in (256, 256, 100):
        ids, h = rng.integers(0, v.n, (32, lanes)), rng.uniform(-1, 1, (lanes, lm.WIDTH)).astype(np.float32)
        got = {k: np.zeros_like(x) for k, x in p.items()}
        for own, g in ((room, got), (None, grads)):
            for x in g.values():
                x.fill(0)
            tracemalloc.start()
            states, kept = lm.forward(p, ids, h, room=own)
            lm.backward(p, ids, kept, lm.outputs(p, v, states.reshape(-1, lm.WIDTH), ids.ravel(), g, own)[1].reshape(states.shape), g, own)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert all(np.array_equal(got[k], grads[k]) for k in p)
    assert peaks[2] < peaks[3] / 3
