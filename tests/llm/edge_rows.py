"""Rows with nulls, ties, copies, empty and very long texts, and helpers of the tests."""

import random

SF = "/root/testdata/sf0.001"
r = random.Random(5)
PASSAGE = " ".join(f"w{k}" for k in range(60))
LONG = " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(20_000))
EDGE = [
    (1, PASSAGE + " end of one."), (2, None), (3, ""), (4, " \t\n "), (5, "start of five: " + PASSAGE), (6, PASSAGE + " end of one."), (7, "one two"), (8, LONG), (9, LONG + " " + PASSAGE),
    (10, "One TWO"), (11, "a b c d e f g h i j k l m n o p " * 8), (12, "Écrit à bob.12@mail.example.com, +1 (555) 010-4477 ou 10.0.0.300 et 10.1.2.3.\nTel 4111 1111 1111 1111"),
    (13, "it's 5's x <|endoftext|> \U0001f600 \x1c y　z"), (14, LONG.replace("a1 ", "A1 ")),
]


def by_id(df, *columns, key="doc_id"):
    rows = df.select(key, *columns).collect()
    assert len({x[0] for x in rows}) == len(rows)
    return {x[0]: tuple(x)[1:] for x in rows}


def each(docs, plain, edge):
    return ((docs, plain), (edge, EDGE))
