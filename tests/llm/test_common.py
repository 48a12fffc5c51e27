import pickle

import numpy as np

from tallybrook.llm import common as C


def test_many_buckets_take_no_room_and_keep_their_places(spark):
    ids = np.r_[np.arange(-50, 5000), C.NULL_ID]
    for n in (7, C.Buckets.EVEN, C.Buckets.EVEN + 1, 10**8):
        b = C.Buckets(n)
        assert len(pickle.dumps(b)) < 40_000
        at = b.of_ids(ids)
        df = spark.createDataFrame([(int(x) if x != C.NULL_ID else None,) for x in ids], "doc_id long")
        assert sorted(r.b for r in df.select(b.column().alias("b")).collect()) == sorted(at.tolist())
        assert b.keys[np.array([-1, 0])].tolist() == [int(b.keys[n - 1]), int(b.keys[0])]
        assert len(set(b.of_hashes(np.arange(n if n < 10 else 10, dtype=np.uint64)).tolist())) == min(n, 10)
