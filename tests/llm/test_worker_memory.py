"""What a worker of Spark keeps between tasks: it waits with what it holds, and several wait beside those that work."""

import subprocess
import sys

import pytest

#: Run in a process of its own, as others' memory would count here. Prints MB kept, and rows.
START = """
import gc, random, re, sys
from types import SimpleNamespace
import numpy, pandas, pyarrow as pa, tokenizers
from gramloom.llm import jaccard, language, packing, queries, tokens

def own():
    gc.collect()
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", f.read()))) / 1024

def batches(columns):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(500)]
    for n in range(3):
        text = " ".join(r.choices(words, k=1200))
        text = [f"{i} {n} {text}" for i in range(3000)]
        values = {"doc_id": range(3000), "text": text, "lang": ["en"] * 3000, "th": range(3000)}
        # As a worker gets it: read from a stream, into memory of Arrow's pool.
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_pydict({c: values[c] for c in columns})
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        del batch
        batch = pa.ipc.open_stream(pa.BufferReader(sink.getvalue())).read_next_batch()
        del sink, stream, text, values
        yield batch
        batch = None

def function(columns):
    class Docs:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run
    return packing.token_pieces(Docs(), queries.public_tokenizer())

before = own()
"""
TASKS = {
    "the tokenizer": ("with open(queries.public_tokenizer()) as f: made = tokens.batch_tokenizer(f.read()); rows = 1", 30),
    "packing": ("rows = sum(b.num_rows for b in function(0)(batches(['doc_id', 'text'])))", 50),
    "language ID": ("rows = sum(b.num_rows for b in language._count_task(batches(['text', 'lang'])))", 12),
    "near duplicates": ("rows = sum(b.num_rows for b in jaccard._summaries(5)(batches(['doc_id', 'th', 'text'])))", 12),
}


@pytest.mark.parametrize("task", TASKS)
def test_memory_is_given_back(task):
    code, most = TASKS[task]
    run = subprocess.run([sys.executable, "-c", f"{START}{code}\nprint(own() - before, rows)"], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    kept, rows = map(float, run.stdout.split())
    assert rows > 0 and kept < most, kept
