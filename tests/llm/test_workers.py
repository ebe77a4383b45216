from pathlib import Path

import numpy as np
import pyarrow as pa

from marketlens.llm import bpe, langid, minhash_dedup, workers


def resident() -> int:
    """MB of this process that are in memory."""
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20


def test_a_task_gives_freed_memory_back():
    """Many blocks too small for mappings of their own, with one in use above them: freed, but kept by the allocator."""
    above = []

    def run(batches):
        for batch in batches:
            blocks = [np.ones(8000) for _ in range(4000)]
            above.append(np.ones(8000))
            del blocks
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    before = resident()
    assert [b.to_pydict() for b in workers.tidied(run)(iter([batch, batch]))] == [batch.to_pydict()] * 2
    assert resident() - before < 100


def test_tasks_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """Language, near duplicates and encoding hand Spark task functions that tidy up."""
    frame = type(spark.range(1))
    seen, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, func, *a, **b: (seen.append(func), plain(self, func, *a, **b))[1])
    docs = spark.createDataFrame([(i, f"some words of text number {i // 2} in a row of words", "en") for i in range(8)], "doc_id long, text string, lang string")
    langid.identify(docs, langid.train(docs)).collect()
    minhash_dedup.near_duplicates(docs).collect()
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(seen) >= 7 and all(hasattr(f, "__wrapped__") for f in seen)


def test_words_are_forgotten_when_a_task_of_encoding_ends(spark, monkeypatch):
    import public_tokenizers
    path, tasks, frame = public_tokenizers.path("word_bpe_49k.json"), [], type(spark.range(1))
    docs, plain = spark.createDataFrame([("some words",)], "text string"), frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, func, *a, **b: (tasks.append(func), plain(self, func, *a, **b))[1])
    bpe.encode(docs, path)
    out = tasks[0](iter([pa.RecordBatch.from_arrays([pa.array(["some words"])], names=["text"])]))
    model = bpe.load(open(path, encoding="utf-8").read())
    assert next(out).num_rows == 1 and model.recent
    assert not list(out) and not model.recent and not model.older
