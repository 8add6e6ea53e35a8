"""Memory that a finished step doesn't need goes: samples on the driver, slices of texts in a task."""

import weakref

import pyarrow as pa
from pyspark.core.broadcast import Broadcast

from postmill.llm import substring, toxicity


def test_training_leaves_no_sample_on_the_driver(spark, monkeypatch):
    gone, inner = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: gone.append(self) or inner(self, blocking))
    rows = [(i, ("rude " if i % 2 else "kind ") + f"word{i % 7} common") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(gone) == 1
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i, _ in rows)


def test_a_slice_is_freed_before_the_next(monkeypatch):
    """Of the texts that a task works through, one slice's arrays are held at a time."""
    alive, most = [], []

    class Text(substring._Text):
        def __init__(self, *args):
            alive[:] = [x for x in alive if x() is not None]
            super().__init__(*args)
            alive.append(weakref.ref(self))
            most.append(len(alive))

    monkeypatch.setattr(substring, "_Text", Text)
    monkeypatch.setattr(substring, "SLICE_BYTES", 300)
    texts = [" ".join(f"w{(i * j) % 41}" for j in range(60)) for i in range(12)]
    keys, hits = pa.array(range(12), pa.int64()), pa.array([[*range(-60, 60)]] * 12, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([keys, keys, pa.array(texts), hits], ["key", "doc_id", "text", "hits"])
    for of_slice in (substring._anchors_of, substring._windows_of):
        assert sum(b.num_rows for b in substring._rows_of(of_slice, 20, 4)(iter([batch]))) > 0
    assert len(most) > 4 and set(most) == {1}
