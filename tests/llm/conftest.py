import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, line string, n long, label long, h long, text_hash long"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def lines(rng, n):
    w = words(rng, n)
    return "\n".join(" ".join(w[i : i + 9]) for i in range(0, n, 9))


def corpus(seed=7):
    """Plain, near, exact and repeated rows, nulls, empty, blank, short and very long texts."""
    rng = random.Random(seed)
    rows = [(i, lines(rng, rng.randint(60, 240))) for i in range(60)]
    for i in range(60, 90):  # near copies of document i % 5
        w = rows[i % 5][1].split(" ")
        w[rng.randrange(len(w))] = "zz%d" % i
        rows.append((i, " ".join(w)))
    rows += [(i, rows[3][1]) for i in range(90, 96)] + [rows[3], rows[3], rows[10]]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, "one"), (104, "one"), (105, "two words"), (None, "a b c d e f g"), (None, None), (None, lines(rng, 80))]
    rows += [(110, lines(rng, 6000)), (111, "x" * 200_000), (112, "ÉCOLE École école 日本語 😀 tab\there\r\nend")]
    boiler = "all of this page is under the license number 12 here"
    rows += [(i, lines(rng, 70) + "\n" + boiler.replace("12", str(i)) + "\n" + lines(rng, 20)) for i in range(120, 126)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en" if (i or 0) % 3 else None, "s", None if t is None else len(t), 1, "l", 2, 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
