import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words long, kept boolean, ids string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "of", "and", "Ünder", "straße", "river", "stone", "cloud", "paper", "green", "mount", "ran", "blue,", "tall.", "été"]
    return " ".join(r.choice(words) + r.choice(["", "", "", "s", "ing", str(r.randint(0, 400))]) for _ in range(n))


def passage(seed: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgk')}{r.choice('aeiou')}{r.randint(0, 9999)}" for _ in range(60))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and blank texts, a very long one, copies, near copies, repeated rows, shared passages."""
    out = [(i, prose(i, 60 + i % 90)) for i in range(60)]
    out += [(100 + i, out[3][1]) for i in range(5)] + [(110, out[4][1] + " end"), (111, out[5][1].replace("river", "River"))]
    words = prose(77, 200).split()
    out += [(120 + i, " ".join([*words[: 40 * i], f"other{i}", *words[40 * i + 1 :]])) for i in range(5)]
    out += [(130 + i, f"{prose(200 + i, 50)} {passage(1)} {prose(300 + i, 50)}") for i in range(4)]
    out += [(140, None), (141, ""), (142, " \n\t "), (143, "one"), (144, "one two"), (145, "one"), (146, "a b c d e f g h i\n" * 3)]
    out += [(150, prose(999, 9000)), (151, "x" * 50_000), (152, "\x00 odd\x0bblanks  here　and  there <|endoftext|> done\r\n\r\n"), (153, "<|startoftext|>É́ ΟΔΟΣ İ")]
    out += [(7, out[7][1]), (7, out[7][1]), (160, "WORD!! " * 80), (161, "### $$$ " * 60), (None, prose(5, 80)), (None, None)]
    out += [(-5, out[3][1]), (1 << 62, prose(3000, 100))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    langs = ["en", "de", None]
    data = [(i, t, langs[k % 3], f"s{k % 2}", len(t or ""), "r", 1, False, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
