import pyarrow as pa

from clipmill.functions import chunking


def test_batches_of_chunks_are_bounded():
    """One batch of many long texts goes on in parts; rows without words give none."""
    texts = [" ".join(f"word{i}." for i in range(3000))] * 200 + ["", None, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = list(chunking.chunks_in_parts(iter([batch])))
    assert len(made) > 3 and max(b.nbytes for b in made) < 2 * chunking.PART
    rows = [r for b in made for r in b.to_pylist()]
    assert rows == [{"doc_id": i} | c for i, t in enumerate(texts) for c in chunking.chunks_of(t)]
