import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from mergeloom.llm import neardups, passages
from mergeloom.llm.oracles import SQL
from mergeloom.llm.queries import QUERIES
from tables import SF, duck, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert rows(df) == duck(SQL[name])
    else:
        assert df.count()


def test_stages_take_effect(spark, tmp_path):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = first, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    assert all(d.columns == first.columns for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in (first, *seen)]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[0]) > len(ids[1]) >= len(ids[2]) > len(ids[3])
    classes = {r.doc_id: r.class_id for r in neardups.near_groups(spark, seen[1]).collect()}
    left = [classes[r.doc_id] for r in seen[2].collect()]
    assert sorted(left) == sorted(set(classes.values()))
    assert not [r for r in passages.repeated_passages(spark, seen[3]).collect() if r.later and r.start_word == 0 and r.end_word > 400]
    got = rows(corpus_pipeline.run(spark, SF))
    assert got == rows(seen[-1])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, stage, odd_docs, no_docs):
    assert stage(spark, odd_docs, SF).count() > 0
    assert stage(spark, no_docs, SF).count() == 0


KEPT = """
import random, re, sys
import pyarrow as pa
from mergeloom.llm import neardups, passages

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(0)
texts = [" ".join("".join(rng.choices("etaoin", k=5)) for _ in range(60)) * 9 for _ in range(1000)]
before = held()
for _ in range(4):
    ids = pa.array(range(8000))
    for run, columns in ((passages._keys, [ids, pa.array(texts * 8)]), (neardups._signatures, [ids, ids, pa.array(texts * 8)])):
        for out in run(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "text"][-len(columns):] if len(columns) > 2 else ["doc_id", "text"])])):
            pass
        del out, columns
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_workers_give_memory_back():
    got = subprocess.run([sys.executable, "-c", KEPT], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert float(got.stdout) < 112, got.stderr
