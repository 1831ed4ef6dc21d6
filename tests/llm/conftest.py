import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, size string, score string, comp string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Random prose with near and exact copies, shared passages, junk, nulls, empty and long texts, repeated rows and
    columns whose names clash with the operators' own."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéüß") for _ in range(r.randrange(1, 9))) for _ in range(400)]

    def prose(n):
        out = []
        for i in range(n):
            w = r.choice(words)
            out.append(w.capitalize() + "." if r.random() < 0.1 else w)
            out.append("\n" if r.random() < 0.04 else " ")
        return "".join(out[:-1])

    base, passage = prose(150), prose(60)
    texts = [prose(r.randrange(1, 220)) for _ in range(40)]
    texts += [base] * 4
    for _ in range(8):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(6)]
    texts += [None, "", " \t\n", "One", "Of " * 300, "x" * 3000, "tab\tand\r\nline\x0bfeeds\x0c end  ", "日本 ½ ª <|endoftext|> it's", "ABC abc " * 20, prose(6000), passage]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4] if i % 3 else "hot", len(t or ""), -1, "?", "?", "?") for i, t in enumerate(texts)]
    rows += [rows[3], rows[41], (None, base + " null id", "en", "a", 1, 0, "", "", ""), (5, "another text of document five", "en", "b", 1, 0, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(corpus):
    """(doc_id, text, source) of each row."""
    return [(r.doc_id, r.text, r.source) for r in corpus.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
