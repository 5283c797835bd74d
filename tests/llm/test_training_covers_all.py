"""The language model is fitted to every stride of every training text."""

import numpy as np

from logweave.llm import attention_lm


def test_every_stride_is_learned(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 300, n).astype(np.uint16) for n in (0, 5, 16, 700, 2500)]
    symbols = attention_lm.Symbols(np.ones(301))
    model = attention_lm.Model(symbols, attention_lm.Pairs(symbols, np.ones((attention_lm.SYMBOLS, attention_lm.GROUPS))))
    seen = 0
    real = attention_lm.gradients

    def noted(p, prior, x, first, y):
        nonlocal seen
        seen += int((y >= 0).sum())
        return real(p, prior, x, first, y)

    class Sent:
        def __init__(self, value):
            self.value = value

    class Here:
        """A table whose tasks run in this process."""

        def __init__(self, rows):
            self.rows, self.sparkSession = rows, spark

        def select(self, _):
            return self

        def repartition(self, _):
            return self

        def mapInArrow(self, run, _):
            return Here(list(run(iter(self.rows))))

        def collect(self):
            return [r for batch in self.rows for r in batch.to_pylist()]

    monkeypatch.setattr(attention_lm, "gradients", noted)
    ids = attention_lm.pa.array([t.tobytes() for t in texts], attention_lm.pa.binary())
    batches = [attention_lm.pa.RecordBatch.from_arrays([ids[:3]], ["ids"]), attention_lm.pa.RecordBatch.from_arrays([ids[3:]], ["ids"])]
    before = attention_lm.initial()
    after = attention_lm.averaged(Here(batches), before, Sent(model))
    assert seen == sum(len(t) + 1 for t in texts)
    assert all(after[k].shape == before[k].shape for k in before) and np.abs(after["out"] - before["out"]).max() > 0
