"""Evidence of many weak segments, against the Poisson tail's bound."""

import math
from types import SimpleNamespace

import pytest

from verisheaf.llm.toxicity import Model


def test_evidence_counts_every_segment():
    model = SimpleNamespace(size=1.0, rate=1.0)  # a score of 0 is expected once a word
    want = math.lgamma(1201) - 1200 * math.log(1000) + 1000
    assert want > 20
    assert Model.evidence(model, 1000, [(0, 0, 0.0)] * 1200) == pytest.approx(want)
