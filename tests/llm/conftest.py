"""Documents that hold the awkward cases: nulls, empty and long texts, copies, ties, clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, size string, bucket long"


def texts(seed=1, count=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    made = []
    for i in range(count):
        own = [rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 19, 20, 21, 80, 200]))]
        text = rng.choice([" ", "\n", "  \t"]).join(own)
        if i % 4 == 0:
            text += " " + passage
        if i % 7 == 0 and made:
            text = rng.choice(made)
        if i % 9 == 0 and made:
            old = (rng.choice(made) or "").split(" ")
            old[len(old) // 2:len(old) // 2 + 1] = ["Changed,"]
            text = " ".join(old)
        made.append(text)
    made += [None, None, "", " ", " \n\t", "one", "One", "a b c d", "a b c d e", "x" * 300, "ab" * 150,
             "ab" * 149 + "c", " ".join(["same"] * 100), " ".join(["same"] * 103), "a\x0bb\x0cc\x85d e f",
             "<|endoftext|> it's 3.14!!! don't <|ENDOFTEXT|>", " ".join(words * 12)]
    return made


@pytest.fixture(scope="session")
def odd_rows():
    made = texts()
    rows = [(i * 3 + 1, t) for i, t in enumerate(made)]
    random.Random(3).shuffle(rows)
    rows.append(rows[5])  # a repeated row
    rows.append((None, made[8]))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, "en" if i else None, None, len(t or ""), 7, "s", 1) for i, t in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
