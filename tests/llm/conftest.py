import pytest


#: Texts with the cases that every operator on texts must stand: null, empty, white space, one word, long, repeated, copies.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def base_texts() -> list[str | None]:
    passage = " ".join(f"{w}{i}" for i in range(2) for w in WORDS)
    return [
        None, "", " \n\t ", "word", "two words", passage, passage, passage.upper(), "Start here. " + passage + " and then the end", passage.replace("alpha0", "other"),
        " ".join(WORDS * 2000), "é ñ ß 文字 مرحبا " * 40, "a" * 50_000, "a  b\n \nc d e \r\n", "'s 'll it's 123 4567 !!?? <|endoftext|>", "x y " * 300,
    ]


@pytest.fixture
def documents(spark):
    rows = [(3 * i % 17 if i != 5 else None, t, "clash", i) for i, t in enumerate(base_texts())]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, row int")
