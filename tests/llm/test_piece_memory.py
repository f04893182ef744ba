"""What a worker of op 11 holds at a time is bounded, whatever a task reads."""

import collections

import numpy as np
import public_tokenizers
import pyarrow as pa

from tickloom.llm import piece_counts


def counted(found) -> collections.Counter:
    distinct, words, owners, times, _ = found
    out = collections.Counter()
    for w, o, t in zip(words.tolist(), owners.tolist(), times.tolist()):
        out[distinct[w].as_py(), o] += t
    return out


def test_slices_of_a_long_task_are_of_several_eras(monkeypatch):
    tokens = piece_counts.PreTokens.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"one two {'three ' * (i % 4)}it's {i} été\n" * 3 for i in range(40)] + ["", None, "   "]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    whole = tokens.split(batch.column("text"))
    monkeypatch.setattr(piece_counts, "CUT_TEXT", 100)
    parts = piece_counts._split(batch, tokens)
    assert counted(parts) == counted(whole) and np.array_equal(parts[4], whole[4]) and len(parts[0]) == len(whole[0])
    freed = []
    monkeypatch.setattr(piece_counts, "release", lambda: freed.append(1))
    monkeypatch.setattr(piece_counts, "SLICE_TEXT", 400)
    monkeypatch.setattr(piece_counts, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 5})())}))
    rows = pa.Table.from_batches(list(piece_counts._frequencies(iter([batch]), tokens)))
    eras, slices = set(rows.column("era").to_pylist()), set(rows.column("slice").to_pylist())
    assert len(slices) > 6 and len(eras) == -(-len(slices) // piece_counts.ERA_SLICES) and len(freed) == len(slices)
    assert not eras & {piece_counts._era(5 + piece_counts.ERA_TASKS, s) for s in range(99)}
