"""Neighbouring copies of a license notice are all found."""

import pytest

from tidemark.llm import licenses
from tidemark.llm.decontam import words


@pytest.mark.parametrize("n", [1, 2, 3, 7])
@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_of_adjacent_copies_is_a_match(name, n):
    copy = words(licenses.TEMPLATES[name])
    found = licenses.Index({name: licenses.TEMPLATES[name]}).search([b"before", *copy * n, b"after"])
    assert [(m[2], m[3]) for m in found] == [(1 + i * len(copy), 1 + (i + 1) * len(copy)) for i in range(n)]
