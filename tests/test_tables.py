import pyarrow as pa

from lumora.tables import sliced


def test_slices_are_bounded_in_rows_and_bytes():
    texts = ["x" * (1000 * (i % 7)) for i in range(2000)] + ["y" * 3_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"])
    got = list(sliced([batch, batch.slice(0, 0)], 100, 200_000))
    assert [i for x in got for i in x.column(1).to_pylist()] == list(range(len(texts)))
    assert max(x.num_rows for x in got) <= 100 and max(x.nbytes for x in got[:-1]) < 400_000
    assert {x.num_rows for x in sliced([batch], 64, 1 << 62)} == {64, len(texts) % 64}
