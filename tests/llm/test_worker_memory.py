"""What Python workers of an executor hold: one worker a task in the pipeline's last stage, small arrays a chunk."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from helpweave.llm.minhash import shingle_sets
from helpweave.llm.textnum import chunks, powers


def test_token_stage_needs_one_python_worker_a_task(spark):
    texts = ["One two three.", "", None, "four  five é <|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.tokens(spark, docs, "")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {r["doc_id"]: r for r in done.collect()}
    assert len(rows) == 4 and all(r["decoded_matches"] for r in rows.values())
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0 and rows[0]["n_tokens"] == len(rows[0]["ids"]) > 0


def test_arrays_of_a_chunk_stay_small():
    words = np.random.default_rng(5).integers(0, 30_000, (400, 1500))
    texts = pa.array([" ".join(f"w{x}" for x in row) for row in words.tolist()])
    powers(0x9E3779B97F4A7C15 | 5, 1)
    whole = shingle_sets(*next((d, b) for _, _, d, b in chunks(texts, 1 << 30)), 5)
    tracemalloc.start()
    made = [shingle_sets(d, b, 5) for _, _, d, b in chunks(texts)]
    held = sum(h.nbytes + n.nbytes for h, n in made)
    most = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert most < 24 << 20
    assert np.array_equal(np.concatenate([h for h, _ in made]), whole[0]) and np.array_equal(np.concatenate([n for _, n in made]), whole[1])
