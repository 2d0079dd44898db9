import numpy as np
import pytest

from gossamer.llm import lm_scoring as L
from gossamer.llm.common import crc_bucket
from tests.llm.test_lm_scoring import TEXTS, brute_model


@pytest.mark.parametrize("depth, max_grams, head_grams", [(0, 5, 3), (1, 60, 0), (2, 60, 1 << 20), (2, 60, 9), (4, 60, 0), (4, 150, 40), (4, 10**6, 0)])
def test_scores_do_not_depend_on_the_bounds(docs, monkeypatch, depth, max_grams, head_grams):
    """A model in many shards, of which tasks hold few strings, predicts as the whole one does, at the same depth."""
    monkeypatch.setattr(L, "CHUNK", 300)
    rows = {r.doc_id: r.score for r in L.scored(docs(TEXTS), depth=depth, max_grams=max_grams, head_grams=head_grams).collect()}
    brute = brute_model([t for i, t in enumerate(TEXTS) if crc_bucket(i, 10)], depth)
    assert np.allclose([rows[i] for i in range(len(TEXTS))], [brute(t) for t in TEXTS], rtol=1e-4, atol=1e-2)
