"""Base spans against plain expressions, and what the field's messages do."""

import hashlib
import json
import random
import re

import numpy as np
import pytest

from spanwarden.llm import pii


def luhn(digits):
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def plain(text):
    """The contract's expressions as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def random_texts(n):
    random.seed(17)
    parts = ["a.b", "@", "x-y", ".", "..", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "-", " ", " ", "é", "𝒳", "co.uk", "10.0.0.1", "007.1.2.3", "%", "_", "\n", "(", ")"]
    return ["".join(random.choices(parts, k=random.randrange(25))) for _ in range(n)]


def test_base_spans_equal_the_expressions():
    for text in random_texts(6000):
        assert pii.base_spans(text) == plain(text), text


def test_query_columns(spark):
    texts = [None, "", *random_texts(300), "mail a@b.c " * 3000, "x" * 100_000 + " 10.0.0.1"] * 2
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(texts) and got[0]["spans"] == "clash"
    for i, t in enumerate(texts):
        base = plain(t or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x == n for x, _, _ in base) for n in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        told = [x for x in got[i]["spans_"].split(",") if x]
        assert len(told) == got[i]["n_spans"] >= len(base) and {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base} <= set(told)
        assert got[i]["n_secret"] == sum(x.startswith("secret") for x in told)


def test_an_empty_or_unlabelled_table(spark):
    schema = "doc_id long, text string"
    assert pii.personal_data(spark.createDataFrame([], schema)).count() == 0
    assert {r["n_spans"] for r in pii.personal_data(spark.createDataFrame([(1, "none here"), (2, None)], schema)).collect()} == {0}


@pytest.mark.parametrize("a, b", [("jo.doe@mail1.example.com", "Jo.Doe+news@mail7.example.com"), ("4155-550-123", "(4155) 550 123".replace(" ", "")), ("AB-12-CD-34", "ab12cd34")])
def test_similar_tokens_are_linked_however_far(a, b):
    text = f"first {a} then " + "word 7 " * 200 + f"and {b} last"
    found = pii.tokens(text)
    _, _, skip = pii.edges(text, found)
    assert (0, len(found) - 1) in skip


def trained(n=400):
    """Keys stand behind 'key' in three of four places; equal tokens are of one kind."""
    random.seed(3)
    seen = []
    for i in range(n):
        secret = i % 2
        word = "".join(random.choices("0123456789abcdef", k=20))
        text = f"key={word} and {word} then {word}" if secret else f"order {word} and {word} then {word}"
        found = pii.tokens(text)
        labels = [5 * secret] * len(found)
        seen.append(json.dumps([[pii.token_features(text, s, e, b) for _, s, e, b in found], labels, *pii.edges(text, found)]))
    return pii.Field(json.dumps(pii.fit(seen)))


def test_messages_flip_a_label():
    field = trained()
    word = "0a1b2c3d4e5f60718293"
    text = f"key={word} " + "word and word " * 50 + f"then {word}"
    found = pii.tokens(text)
    unary = np.array([field.weight[pii.token_features(text, s, e, b)].sum(axis=0) for _, s, e, b in found])
    with_links, without = field.passed(unary, pii.edges(text, found)), field.passed(unary, ([], [], []))
    assert without[0].argmax() == 5 == with_links[0].argmax()
    assert with_links[-1].argmax() == 5 and with_links[-1][5] > without[-1][5]
    alone = f"order {word} " + "word and word " * 50 + f"then {word}"
    assert all(p.argmax() == 0 for p in field.marginals(alone, pii.tokens(alone)))
    # a label that the token alone would not get
    unary[-1] = 0.0
    unary[-1][0] = 1.0
    assert field.passed(unary, ([], [], []))[-1].argmax() == 0 and field.passed(unary, pii.edges(text, found))[-1].argmax() == 5
