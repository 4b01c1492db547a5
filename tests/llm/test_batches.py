import pyarrow as pa

from lodestone.llm import batches as B


def test_slices_and_what_is_kept():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "bb", None, "c" * 9, "", "d"])], ["t"])
    table = B.kept("one", dict)
    parts = [x.column(0).to_pylist() for x in B.slices(batch, 0, rows=3, chars=4, keep="one")]
    assert parts == [["a", "bb", None], ["c" * 9], ["", "d"]] and B.kept("one", list) is table
    list(B.slices(batch, 0))
    assert B.kept("one", list) == []
