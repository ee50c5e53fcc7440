import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp long, n_words int, h string, `__text` string"


def passages():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta", "eta", "theta", "Iota", "kappa"]
    say = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(60)) for _ in range(n))
    base = say(80)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n\t ", "one", "One two", base, base, " ".join(near), say(60) + " mail a.b@c.de, call +1 (555) 123-4567.\nip 10.0.0.255 and 10.0.0.256"]
    texts += ["card 4111 1111 1111 1111 not 4111 1111 1111 1112", "IBAN DE89 3704 0044 0532 0130 00 ok", "x@y.z_w@v.u", "SSN 123-45-6789 and 000-12-3456"]
    texts += ["word " * 70, say(3000), "a" * 5000, "Intro\nReleased under the MIT License.\nend", "\n".join(["same line"] * 4), "x.x@" * 300 + "1.2.3.4.5.6", "\u4f60\U00012000 x\U0001f600\U0001f600 \u00a9  two"]
    texts += [say(rnd.randrange(20, 120)) for _ in range(20)]
    return texts


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, None if i % 3 else "en", None, None if t is None else len(t), 0.5, "x", 7, 1, "h", "t") for i, t in enumerate(passages())]
    rows += [rows[5], rows[8], (None, None, None, None, None, None, None, None, None, None, None), (None, "null id", None, None, 7, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark_table(spark):
    texts = passages()
    words = texts[5].split()
    rows = [(1, " ".join(words[10:30])), (2, "one"), (3, None), (4, "  "), (5, " ".join(words[50:58])), (1, "Theta9 nothing here"), (12, " ".join(words[12:26]))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="session")
def labels_table(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(5, 38)] + [(3, None, None), (None, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
