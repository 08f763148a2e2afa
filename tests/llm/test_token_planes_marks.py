"""Capitals with combining marks have the library's ids."""

import numpy as np
import pytest

from millrace.llm import token_planes
from tests.llm.test_token_planes import WORDS, library_ids

MARKED = ["H̱anukkah", "J̌A", "T̈b", "W̊X", "Y̊", "a Ḥ̱ B", "PLAIN H̱ É́T DÉJÀ Déjà, THE", "́A B C̱"]


@pytest.mark.parametrize("text", [*MARKED, " ".join(MARKED), "\n".join(MARKED) * 50])
def test_marked_capitals(text):
    own = token_planes.WordCacheEncoder(WORDS)
    for _ in range(2):
        assert np.frombuffer(own([text, "A", text])[2], "<u4").tolist() == library_ids(WORDS, text)


def test_lowered():
    assert token_planes.lowered("ABC É\tXY̱Z\nDEF".encode()) == "abc É\tXY̱Z\ndef".encode()
    assert token_planes.lowered(b"") == b"" and token_planes.lowered(b"@AZ[") == b"@az["
