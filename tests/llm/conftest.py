from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _key string, `a.b` int, N_Words int, TEXT string, Score string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def messy_rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and long texts, copies, near copies, shared passages and lines, repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ".", ".\n"]) for _ in range(n))
    passage, line = prose(60), "A line that many documents of this table share, long enough to count."
    texts = [None, "", " \t\n", "x", "one two three four", "a b c d e f g h i j k l", "#|&*%$<>"]
    texts += [prose(r.randint(5, 120)) for _ in range(20)]
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(4)]
    texts += [prose(10) + "\n  " + line.upper() + " \n" + prose(10) for _ in range(7)]
    base = prose(200)
    near = base.split(" ")
    texts += [base, base, base]
    for _ in range(5):
        v = list(near)
        v[r.randrange(len(v))] = "changed"
        texts.append(" ".join(v))
    texts += [prose(20000), "same words again. " * 50, "un e spaced \x1c\x85 text\x0bhere\x0cand", "emoji 😀 and 한국어 <|endoftext|> text"]
    rows = [(i if i != 5 else None, t, r.choice(["en", None]), r.choice(["s", None]), None if i % 7 == 0 else len(t or ""), "clash", None, i, i, "other text", "x") for i, t in enumerate(texts)]
    return rows + [rows[30], rows[30], rows[1]]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
