import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, t string, rep string, label string, w string, pos int, items string, some string, uid string"


def build(seed=5, n=60):
    """Texts with copies, near copies, shared passages, junk, nulls, empties and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "nu", "ra", "éa", "ß", "st"]) for _ in range(r.randint(1, 4)))
    vocab = [word() for _ in range(150)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, item = say(40), say(30)
    out = []
    for i in range(n):
        lines = [say(r.randint(4, 30)).capitalize() + "." for _ in range(r.randint(1, 6))]
        out.append("\n".join(lines))
    base = out[3] + " " + say(80)
    for k in range(12):  # near copies: a word differs here and there
        w = base.split(" ")
        for _ in range(k % 3):
            w[r.randrange(len(w))] = "odd%d" % r.randrange(50)
        out.append(" ".join(w))
    out += [out[5], out[5].upper(), passage + " " + say(20), say(10) + " " + passage, passage, item + " " + say(5), say(9) + "\n" + item.replace(" ", ", ") + "!", "Released under the MIT License.\n" + say(30)]
    out += ["ab" * 300, "na " * 200, "", " \n ", None, "x", "one two", "Mail bob.smith@mail.example.com or +1 (743) 555-3824, 4111111111111111, 10.20.30.40; Mr. John Smith met Mary Jones.", "It's <|endoftext|> they'll 123 !!  \t  é中", "!!! ### " * 40]
    rows = [(i, t) for i, t in enumerate(out)]
    rows += [(2, out[2]), (None, out[4]), (None, None), (10**6, say(3000))]
    return rows, item


@pytest.fixture(scope="session")
def fixture_rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    rows = [(i, t, "en", "src0", None if t is None else len(t), 1, 2, "t", "r", "l", "w", 3, "i", "s", "u") for i, t in fixture_rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def bench(spark, fixture_rows):
    return spark.createDataFrame([(0, fixture_rows[1]), (1, "too short"), (2, None), (None, "a b c d e f g")], "item_id long, text string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
