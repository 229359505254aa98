import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use inside.
CLASHING = ("id_a", "id_b", "bucket", "s", "n", "at", "low", "rank", "item_id", "one", "batch", "a.b", "SD_SPANS", "ng_size", "LD_Removed", "own_key", "words", "SB_windows", "Ng_Class", "b`c", "PD_RUNS", "whole", "c0")


def passage(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def hostile(seed: int = 7) -> list[tuple]:
    """Null and empty texts, nulls in every column, copies, near copies, shared passages, ties, one very long text."""
    rng = random.Random(seed)
    shared, base = passage(rng, 120), [passage(rng, rng.randint(1, 160)) for _ in range(24)]
    texts = [None, "", " \n\t ", "é", "a " * 900, "x" * 1500, *base, base[3], base[3], base[4] + " tail", shared]
    texts += [f"{passage(rng, 5)} {shared} {passage(rng, 5)}" for _ in range(6)]
    for _ in range(6):
        words = base[5].split()
        words[rng.randrange(len(words))] = "EDIT"
        texts.append(" ".join(words))
    texts += ["\n".join([base[6], base[7], base[8], base[9]]), "\n".join([base[7], base[8], base[9], "end"]), "\n".join(["l"] * 9), passage(rng, 6000)]
    return [(i, t, rng.choice(["en", "fr", None]), None if i % 5 == 0 else "src", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return hostile()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The hostile rows from files, with extra columns whose names clash."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumns({c: df["source"]})
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("doc_id < -1")
