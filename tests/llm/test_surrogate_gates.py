"""No entity is left in a text for want of other entities beside it."""

import random

import pytest

from sievework.llm import surrogates


@pytest.mark.parametrize("kind, value", [("secret", "abcdef1234" * 4), ("secret", "ab1cd2ef" * 8), ("iban", "GB82WESTABCDEFGHIJ"), ("phone", "+12345"), ("secret", "paſſwd=abcdefgh")])
def test_lone_entity_is_replaced_as_among_others(spark, docs_of, kind, value):
    texts = [(1, f"plain words {value} and more"), (2, f"plain words {value} and more on 555-123-4567")]
    alone, beside = (r["text"] for r in surrogates.pseudonymise(docs_of(texts), "key").orderBy("doc_id").collect())
    assert value not in alone and beside.startswith(alone)
    assert [e[2] for e in surrogates.entities(texts[0][1])] == [kind]


def test_gates_pass_all_that_the_patterns_match():
    rnd = random.Random(5)
    for n in (40, 64):
        for _ in range(2_000):
            token = "".join(rnd.choice("0123456789abcdef") for _ in range(n))
            assert [e[2:] for e in surrogates.entities(f"see {token} there")] == [("secret", token)]
    parts = ["GB82", "WEST", "+1", "23", "45", " ", "-", ".", "(", ")", "AKIA", "abcd" * 10, "key", "=", "ſecret", ":", "1.2.3.4", "@", "a.b"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        kinds = {k for k, pattern, _ in surrogates._KINDS if pattern.search(text)}
        assert not kinds or surrogates.entities(text)
