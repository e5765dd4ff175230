import re

import pyarrow as pa

from cadenza.llm import common


def test_a_task_leaves_no_memory_behind(spark):
    """Workers live on between stages, so what the allocators keep of each stage would add up."""

    def run(batches):
        for batch in batches:
            held = [pa.array([bytes(700)] * 20_000) for _ in range(12)]  # 168 MB
            del held
            words = {str(k) * 3: str(k).encode() for k in range(400_000)}
            del words
            yield from ()

    def told(batches):
        list(batches)
        with open("/proc/self/smaps_rollup") as f:
            private = int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) >> 10
        yield pa.RecordBatch.from_arrays([pa.array([private])], names=["id"])

    def worker():  # one partition takes the worker that was used last
        return max(r.id for r in spark.range(0, 1, 1, 1).mapInArrow(told, "id long").collect())

    before = worker()
    spark.range(0, 8, 1, 1).mapInArrow(common.frugal(run), "id long").collect()
    after = worker()
    assert after < before + 60, (before, after)
