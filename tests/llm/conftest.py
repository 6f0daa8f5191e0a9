import hashlib
import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows of a small corpus: copies, shared passages, repeated lines, nulls, blanks, one long text, repeated rows."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "of", "an", "ré", "x") for b in ("", "ti", "on", "é", "ll", "st", "ou", "w")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(60), prose(15)
    rows = []
    for i in range(60):
        lines = [prose(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(1, passage)
        if i % 4 == 0:
            lines.append(line if i % 8 else line[:20] + "z" + line[21:])
        rows.append((i, "\n".join(lines), "en" if i % 3 else "de", f"s{i % 4}", 0))
    rows += [(100 + i, rows[7][1], "en", "s0", 0) for i in range(8)]
    rows += [(120, None, "en", "s1", 0), (121, "", None, None, 0), (122, " \n\t ", "en", None, 0), (123, prose(9000), "de", "s2", 0)]
    rows += [(124, "Short.", "en", "s0", None), (125, "a a a a a a a a a a a a", "en", "s3", 0), (None, passage, "en", "s0", 0)]
    rows += [rows[3], rows[3], (126, "one\x0bline\x0c two\rthree four " * 4, "en", "s1", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with common internal ones."""
    rows = [(*r, i, "t") for i, r in enumerate(corpus)]
    return spark.createDataFrame(rows, COLUMNS + ", key long, t string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words_of(text):
    return (text or "").encode().split()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
