import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="session")
def model_file():
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def texts(n: int = 150, seed: int = 1) -> list[str]:
    """Invented prose with copies, near copies, shared lines and passages."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeéfghij", k=rnd.randrange(1, 8))) for _ in range(300)]
    shared = [" ".join(rnd.choices(words, k=14)) for _ in range(4)]
    line = "Subscribe  to our LETTER"
    out: list[str] = []
    for k in range(n):
        if out and rnd.random() < 0.15:
            t = rnd.choice(out)
            if rnd.random() < 0.6 and t:
                t = " ".join(rnd.choice(words) if rnd.random() < 0.02 else w for w in t.split(" "))
        else:
            t = "\n".join(" ".join(rnd.choices(words, k=rnd.randrange(3, 40))).capitalize() + "." for _ in range(rnd.randrange(1, 4)))
        if rnd.random() < 0.3:
            t += "\n" + rnd.choice([line, line.upper() + " ", "\t" + line.lower()])
        if rnd.random() < 0.2:
            t += " " + rnd.choice(shared)
        out.append(t)
    return out


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, one long text, repeated rows and ids."""
    return [
        (9001, None), (9002, ""), (9003, " \n\t "), (9004, "word " * 20_000 + "end"), (9005, "same text twice, with enough words to be shared by two documents"),
        (9005, "same text twice, with enough words to be shared by two documents"), (9006, "same id, one text"), (9006, "same id, another text"), (None, "a null id is an id too"), (None, None),
        (9007, "\U0001f600 ☃ ﬁ é́ ▁x a\x00b"), (9008, "x" * 60), (9009, "x" * 60), (9010, "one"),
    ]


@pytest.fixture(scope="session")
def rows():
    return [(k, t) for k, t in enumerate(texts())] + awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, ["en", "fr", None][k % 3], f"src{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
