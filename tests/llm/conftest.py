import random

import pytest

WORDS = [a + b for a in "bcdfgklmnprstv" for b in ("ano", "eri", "olu", "iste", "urra")]


@pytest.fixture(scope="session")
def documents(spark):
    """A few hundred texts with copies, near copies, blanks, nulls, repeated ids and a further column."""
    pick = random.Random(5)
    rows = []
    for i in range(240):
        text = " ".join(pick.choice(WORDS) for _ in range(pick.choice([3, 8, 30, 80, 200]))) + "."
        rows.append((i, text))
        if i % 6 == 0:
            rows.append((1000 + i, text))
        if i % 5 == 0:
            words = text.split(" ")
            words[pick.randrange(len(words))] = "changed"
            rows.append((2000 + i, " ".join(words)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (None, rows[0][1]), (None, None), (3, "another text of the same id"), rows[7], rows[7]]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", "x") for i, t in rows], "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
