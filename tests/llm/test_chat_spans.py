"""The digests read the loss where the expansion puts it."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from recallspark.llm import chat


def test_loss_is_read_at_the_end_of_the_context(spark, monkeypatch):
    texts = ["a🙂" * 3000, "b<[" * 2000, "", "c\\漢" * 1500]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(texts * 2)], "conv_id long, turn long, role string, text string")
    loss = "".join(x for i, x in enumerate(texts * 2) if i % 2)
    row = chat.digests(turns).first()
    assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    expanded = chat.expanded
    monkeypatch.setattr(chat, "expanded", lambda f: expanded(f).withColumn("context_end", F.col("context_end") - 1))
    assert chat.digests(turns).first().loss_sha256 != row.loss_sha256
