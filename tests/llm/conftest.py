import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, shard string, rate double, _m int"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: copies, near copies, shared passages, short, empty and long texts, odd characters."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 8))) for _ in range(600)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = "This passage of many words is shared by several documents, whatever else they may hold, and it is long enough to count."
    out, base = {}, make(120).split()
    for k in range(12):  # a family of near copies at several distances
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(999))
        out[10 + k] = " ".join(w)
    for k in range(6):
        out[40 + k] = out[10]
    for k in range(8):
        out[60 + k] = make(30) + "\n" + passage + "\n" + make(20)
    for k in range(20):
        out[100 + k] = make(60) + ".\n" + make(40)
    out |= {200: "", 201: None, 202: "   \n\t ", 203: "one", 204: "ONE", 205: "two words", 206: "a b c d", 207: "A B C D", 208: make(6000), 209: out[103] + " " + make(5), 210: "x " * 200, 211: "ü" * 70, 212: "line here\nline here\nline here\n", 213: "\x00nul\x1f byte " * 9}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""), "clash", "clash", 0.5, 1) for i, t in texts.items()]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a text without an id that is long enough to hold more than fifty bytes", "en", "src0", 9, "clash", "clash", 0.5, 1))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, 0 if i in (210, 212, 213) or i % 9 == 0 else 1, 0) for i in texts], "doc_id long, quality int, toxic int")
