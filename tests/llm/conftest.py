import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, h string, node string, key string"


def make_rows():
    """Small documents with copies, near copies, shared passages, nulls, an empty, a very long and repeated rows."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, lines = text(30), "\n".join(text(6) for _ in range(9))
    texts = [text(r.randint(1, 120)) for _ in range(40)]
    texts += [f"{text(20)} {passage} {text(9)}" for _ in range(6)]
    texts += [f"{text(12)}\n{lines}\n{text(7)}" for _ in range(4)]
    base = text(200).split()
    for k in range(8):
        changed = list(base)
        for _ in range(k):
            changed[r.randrange(len(changed))] = "edit"
        texts.append(" ".join(changed))
    texts += [texts[0], texts[45], "", None, "   \n\t ", "one", "two words", "Two WORDS", text(9000), "ΑΒΓ ñ x 🙂 <|im_end|>", "1234 !!"]
    rows = [[i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "é", None]), len(t) if t else None, "x", "y", "z", "n", None] for i, t in enumerate(texts)]
    rows.append(list(rows[3]))
    rows.append([None, texts[46], None, None, None] + [None] * 5)
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
