"""What Python workers hold on to: they outlive tasks and serve one operator after another."""

import random

import numpy as np

from tests.llm.common import prose
from tilegraph.llm import common, tokens
from tilegraph.llm.queries import TOKENIZER


def test_tasks_of_other_operators_let_the_encoder_go():
    first = tokens.encoder(TOKENIZER)
    list(common.task(iter, TOKENIZER)([]))
    assert tokens.encoder(TOKENIZER) is first
    list(common.task(iter)([]))
    assert tokens.encoder(TOKENIZER) is not first


def test_release_drops_tables_of_powers():
    common.prefix_codes(np.ones(200_000, dtype=np.uint64))
    common.release()
    assert not common._powers


def test_runs_met_once_are_not_remembered(monkeypatch):
    rng = random.Random(6)
    e = tokens.Encoder(TOKENIZER)
    texts = [prose(rng, 400) + " 12.5, x1y2" for _ in range(20)]
    for t, ids in zip(texts, e.ids_of(texts), strict=True):
        assert ids.tolist() == e.exact(t)
    assert len(e.known) < 100
    e.ids_of(texts)
    assert len(e.known) > 1000
    monkeypatch.setattr(tokens, "MOST_KEPT", 300)
    for k in range(0, 20, 2):
        for t, ids in zip(texts[k : k + 2], e.ids_of(texts[k : k + 2]), strict=True):
            assert ids.tolist() == e.exact(t)
