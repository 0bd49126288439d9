from types import SimpleNamespace

import numpy as np

from skein.llm import recurrent_lm


def test_every_training_document_is_trained_on_once_in_a_large_corpus(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def copies(*_):
        def run(batches):
            for b in batches:
                seen.add(sum(b.column(0).to_pylist() and [int(x) for x in b.column(0).to_pylist()]))
            return iter(())

        return run

    monkeypatch.setattr(recurrent_lm, "_copies", copies)
    monkeypatch.setattr(recurrent_lm, "MOST_COPIES", 4)
    monkeypatch.setattr(recurrent_lm, "first_model", lambda *_: SimpleNamespace(flat=np.zeros(1, np.float32)))
    docs = spark.createDataFrame([(i if i else None, str(1 << (i % 20))) for i in range(2000)], "doc_id bigint, text string")
    recurrent_lm.train_model(docs, SimpleNamespace(total=10**9), None)
    assert seen.value == sum(1 << (i % 20) for i in range(2000))
