import random

import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, id string, size double, "
          "node string, score string, `odd name` string")


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or ["ath", "bren", "colt", "dun", "erst", "fal", "gorm", "hesk", "inth", "jor", "kell", "lum"]
    out = []
    while len(out) < n:
        k = min(n - len(out), r.randint(5, 12))
        line = ["".join(r.choices(words, k=2)) for _ in range(k)]
        line[0], line[-1] = line[0].capitalize(), line[-1] + "."
        out += line
    return out


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with taken names."""
    body = prose(1, 120)
    near = list(body)
    near[60] = "changed"
    rows = [
        (1, " ".join(body), "en", "a", 5, "x", "y", 1.5, "n", "s", "o"),
        (2, "  ".join(body), "en", "a", 5, "x", "y", 1.5, "n", "s", "o"),      # equal but for white space
        (3, " ".join(near), "en", "b", None, None, None, None, None, None, None),  # near copy
        (4, None, None, None, None, None, None, None, None, None, None),
        (5, "", "de", None, 0, "", "", 0.0, "", "", ""),
        (6, " \n\t ", "de", "b", 0, "", "", 0.0, "", "", ""),
        (7, "Short.", "en", "c", 6, None, None, None, None, None, None),
        (8, "Short.", "en", "c", 6, None, None, None, None, None, None),       # tie on length
        (9, " ".join(prose(2, 60)) * 200, None, "c", None, None, None, None, None, None, None),
        (None, " ".join(prose(3, 80)), "fr", "d", 1, None, None, None, None, None, None),
        (10, "ÄÖÜ ß — 日本語 😀   end.", "de", "é", 1, None, None, None, None, None, None),
        (10, "ÄÖÜ ß — 日本語 😀   end.", "de", "é", 1, None, None, None, None, None, None),  # repeated row
    ]
    return rows + [(20 + i, " ".join(prose(50 + i, 70 + i)), "en", "abc"[i % 3], i, None, None, None, None, None, None)
                   for i in range(30)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
