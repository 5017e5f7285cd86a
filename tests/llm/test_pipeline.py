"""The pipeline's stages one after the other, and its queries against DuckDB."""

import glob
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def near_classes(texts):
    """Classes of five-word shingle sets linked at 0.8, pair by pair."""
    sets = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_run(spark, tmp_path):
    """Each stage by brute force over the rows of the stage before."""
    import corpus_pipeline as p
    from strophe.llm import decontaminate
    from strophe.llm.queries import ORACLE

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = p.quality_stage(spark, docs, SF)
    kept = {r[0] for r in duck().execute(f"SELECT doc_id FROM ({ORACLE['op4_quality_rules']}) WHERE kept").fetchall()}
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(kept) and good.columns == docs.columns

    once = sorted(p.dedup_stage(spark, good, SF).collect(), key=lambda r: r["doc_id"])
    assert once == [r for i, (r, c) in enumerate(zip(rows, near_classes([r["text"] for r in rows]), strict=True)) if i == c]

    once_df = spark.createDataFrame(once, docs.schema)
    clean = sorted(p.decontamination_stage(spark, once_df, SF).collect(), key=lambda r: r["doc_id"])
    items = decontaminate.Items([r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])

    def leaks(text):
        ids = np.array([items.number.get(w, -1) for w in decontaminate.words_of(text)], dtype=np.int32)
        return any(decontaminate.verdict(w, a, ids, 0, len(ids))[2] for w, a in zip(items.words, items.answers, strict=True))

    assert clean == [r for r in once if not leaks(r["text"])] and len(clean) < len(once)

    clean_df = spark.createDataFrame(clean, docs.schema)
    mixed = p.mixing_stage(spark, clean_df, SF).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the level at which targets of weight times level, at most twice the size, use the whole share
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(weight[s] * level, 2 * sizes[s]) for s in order) < 1.5 * sum(sizes.values()) else (lo, level)
    assert all(abs(taken[s] - min(weight[s] * lo, 2 * sizes[s])) <= largest[s] for s in order)
    copies = Counter(mixed)
    assert set(copies) <= set(clean) and max(copies.values()) <= 2

    mixed_df = spark.createDataFrame(mixed, docs.schema)
    out = p.sharding_stage(spark, mixed_df, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    placed = out.collect()
    assert Counter(tuple(r)[:-2] for r in placed) == Counter(map(tuple, mixed))
    by, slots = Counter(), defaultdict(list)
    for r in placed:
        by[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
    biggest = max(len((r["text"] or "").encode()) + 1 for r in mixed)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 3 * biggest and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_written_corpus(spark, tmp_path):
    """All stages in one go: the same rows as stage after stage, in files by shard and slot; nothing else stays behind."""
    import corpus_pipeline as p

    shared = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: set(glob.glob(f"{shared}/strophe/*"))
    before = tables()
    p.write(spark, SF, f"file://{tmp_path}/corpus")
    assert tables() == before
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    read = spark.read.parquet(f"file://{tmp_path}/corpus").select(docs.columns)
    assert Counter(map(tuple, read.collect())) == Counter(map(tuple, docs.collect()))
    for folder in glob.glob(f"{tmp_path}/corpus/shard=*"):
        files = sorted(glob.glob(f"{folder}/*.parquet"))
        slots = [s for f in files for s in duckdb.execute(f"SELECT slot FROM '{f}'").fetchnumpy()["slot"].tolist()]
        assert slots == list(range(len(slots)))


def test_entry_without_the_corpus_operators(tmp_path):
    """With the folders or a library of theirs gone the entry point has its other queries; a fault elsewhere still shows."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    count = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"
    absent = lambda name: f"import sys; sys.modules[{name!r}] = None; "
    for code in (absent("xxhash"), absent("zstandard"), absent("strophe.llm"), absent("corpus_pipeline")):
        told = subprocess.run([sys.executable, "-c", code + count], cwd=root, capture_output=True, text=True).stdout.split()
        assert int(told[0]) > 100 and told[1:] == ["False", "True"], code
    assert subprocess.run([sys.executable, "-c", absent("strophe.plans") + count], cwd=root, capture_output=True).returncode != 0


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_quality_rules"])
def test_same_rows_as_sql(spark, name):
    from strophe.llm.queries import ORACLE, QUERIES

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    result = duck().execute(ORACLE[name])
    named = [x[0] for x in result.description]
    assert sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(repr(r[named.index(c)]) for c in cols) for r in result.fetchall())
