"""The query of op 11 trains on every window, and every id of a text is a target once."""

import numpy as np
from factorlake.llm import attention_lm as lm
from factorlake.llm import queries


def test_the_query_takes_every_window(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(lm, "score", lambda docs, **how: asked.update(how))
    queries.op11_lm_score(spark, "/root/testdata/sf0.001")
    assert asked == {"every": 1}


def test_every_id_is_a_target_once():
    shape, ids = lm.Shape(), np.arange(1, 1000, dtype="<u4")
    targets = lm.sampled_windows(ids, 5, shape, 5000, 1)[:, -shape.stride :].ravel()
    assert (targets[: len(ids)] == ids).all() and (targets[len(ids) :] == 5000).all()


def test_windows_of_every_text_are_not_stored(spark):
    vocabulary, docs = lm.tokens.default_vocabulary(), spark.createDataFrame([(1, "some words of a text " * 9)], "doc_id long, text string")
    texts = lm.common.text_rows(docs).selectExpr("*", "false as held_out")
    sent = spark.sparkContext.broadcast({})
    size = lambda every: lm.prepare(texts, sent, 1, 1, vocabulary, lm.Shape(), every).selectExpr("length(windows) n").first().n
    assert size(1) == 0 and size(2) > 0
