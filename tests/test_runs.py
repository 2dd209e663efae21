import random

import pyarrow as pa

from sparkloom.operators.runs import runs


def test_runs_over_batches_and_nulls():
    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(rng.choices(range(12), k=rng.randint(0, 30)))
        batches, i = [], 0
        while i < len(keys):
            n = rng.randint(1, 6)
            batches.append(pa.RecordBatch.from_arrays([pa.array([None if k == 3 else k for k in keys[i : i + n]], pa.int64()), pa.array(range(i, min(len(keys), i + n)))], names=["k", "v"]))
            i += n
        want: dict[int, list[int]] = {}
        for v, k in enumerate(keys):
            want.setdefault(k, []).append(v)
        for least in (1, 2, 3):
            got = [t.column("v").to_pylist() for t in runs(iter(batches), ["k"], least)]
            assert [g for g in got if len(g) >= least] == [v for v in want.values() if len(v) >= least]
