"""What a task has freed goes back to the system before the worker takes the next one."""

import pyarrow as pa

from lumenfold.functions import memory
from lumenfold.llm import common


def test_a_stage_gives_back_after_its_own_variables_are_gone(monkeypatch):
    class Held:
        alive = 0

        def __init__(self):
            Held.alive += 1

        def __del__(self):
            Held.alive -= 1

    def run(batches):
        held = [Held()]
        for b in batches:
            yield b
        assert held

    seen = []
    monkeypatch.setattr(memory, "give_back", lambda: seen.append(Held.alive))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert list(memory.tidied(run)(iter([batch, batch]))) == [batch, batch] and seen == [0]


def test_filter_stages_are_tidied(spark, monkeypatch):
    called = []
    monkeypatch.setattr(common, "tidied", lambda run: called.append(run) or run)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    kept = common.filter_rows(docs, lambda: lambda texts: [t == "" for t in texts])
    assert [r.doc_id for r in kept.collect()] == [2] and len(called) == 1
