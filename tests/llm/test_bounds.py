"""What tasks hold does not grow with a batch, and a pair passes one join with those compared before."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vitrine.llm import classifier, minhash
from vitrine.llm.textkit import chunks


def test_pairs_pass_one_join(spark):
    """Pairs of four rounds before: each row is read by one join, not by one for each round."""
    frame = lambda rows: spark.createDataFrame(rows, "hub long, node long")
    left = minhash.unseen(frame([(i, i + 1) for i in range(40)]), [frame([(i, i + 1) for i in range(k, 36, 4)]) for k in range(4)])
    assert sorted(map(tuple, left.collect())) == [(i, i + 1) for i in range(36, 40)]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 1


@pytest.mark.parametrize("step", ["classifier", "minhash"])
def test_memory_of_a_batch(step):
    """A batch of 4 MB of text: arrays of 8 bytes for each word, shingle and n-gram of all of it would have some 100 MB."""
    draw = np.random.default_rng(7)
    texts = [" ".join(f"w{w}" for w in draw.integers(0, 5000, 400)) for _ in range(1800)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    idf = np.ones(1 << minhash.IDF_BITS, np.float32)
    tracemalloc.start()
    for chunk in chunks(iter([batch]), lower=True):
        if step == "minhash":
            minhash.counted(chunk, idf)
        else:
            assert all(len(found) for found in classifier.by_row(chunk))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6, peak
