import numpy as np
import pyarrow as pa

from clipmill.operators import vector_index as v


def test_encoder_works_in_bounded_parts():
    """Rows times lists stay within the cells of a table; codes are those of all rows."""
    rng = np.random.default_rng(1)
    x, centroids = rng.normal(size=(3000, 8)).astype(np.float32), v.unit(rng.normal(size=(4096, 8)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(x), pa.list_(pa.float32()))], ["id", "embedding"])
    made = list(v.encoder(centroids)(iter([rows])))
    assert max(b.num_rows for b in made) * 4096 <= v.CELLS
    assert [i for b in made for i in b.column("id").to_pylist()] == list(range(3000))
    assert np.array_equal(np.concatenate([b.column("list").to_numpy() for b in made]), (v.unit(x) @ centroids.T).argmax(1))
