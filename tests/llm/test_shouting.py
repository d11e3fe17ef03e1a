"""Patterns are read over whole texts."""


def test_shouting():
    from papyrine.llm.toxicity import _counts, _Index

    texts = ["Ab", "a" * 10_000 + "B" * 30_000, "ABCDEFGabcdefg", ""]
    assert [round(float(p[0]), 6) for p in _counts(texts, _Index([]))[1]] == [0.5, 0.75, 0.5, 0.0]
