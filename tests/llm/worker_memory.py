"""python worker_memory.py FOLDER: MB that the only Python worker of a session holds after each of some stages, as JSON."""

import json
import os
import re
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from limnos.llm import packing, simhash, substrings  # noqa: E402
from limnos.session import build_session, ship  # noqa: E402


def own_mb(batches):
    for _ in batches:
        with open("/proc/self/smaps_rollup") as f:
            yield pa.RecordBatch.from_arrays([pa.array([int(re.search(r"\nPss_Anon: +(\d+)", f.read())[1]) // 1024])], ["mb"])


def main(folder):
    spark = build_session("worker-memory", "local[1]", 1, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{folder}/checkpoints",
        "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    ship(spark)
    rng = np.random.default_rng(3)
    words = np.array([f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in range(1500)])
    texts = [" ".join(rng.choice(words, 5000)) for _ in range(800)]
    spark.createDataFrame(pa.table({"doc_id": pa.array(range(800)), "text": texts})).write.parquet(f"{folder}/docs")
    docs, held = spark.read.parquet(f"{folder}/docs"), {}
    for name, stage in (("fingerprints", simhash.fingerprints), ("substrings", substrings.without_repeats), ("pieces", packing.pieces)):
        stage(docs).write.format("noop").mode("overwrite").save()
        held[name] = spark.range(0, 1, 1, 1).mapInArrow(own_mb, "mb long").first()["mb"]
    print("HELD", json.dumps(held))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
