"""The pipeline on a small corpus, each stage held against brute force on its own input; and the entry points."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import DOCS, brute_groups, edited, junk, odd, prose  # noqa: E402

KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(1)
    rows = [(i, prose(90, i) + ".") for i in range(260)]
    rows += [(300 + i, junk(30, i)) for i in range(90)]
    rows += [(400 + i, prose(90, i) + ".") for i in range(20)] + [(430 + i, edited(prose(90, 30 + i), 0.04, i) + ".") for i in range(15)]
    rows += [(500 + i, f"Shared line here.\n{prose(60, 900 + i)}.") for i in range(60)] + [(600, f'{prose(50, 77)} token = "{KEY}" {prose(30, 78)}.'), (601, None), (602, "")]
    r.shuffle(rows)
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 260, 2)] + [(300 + i, 0, 0) for i in range(0, 90, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage_on_its_own_input(spark, corpus, tmp_path):
    docs, before = spark.read.parquet(f"{corpus}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, corpus)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows} if k < 4 else {}
        if name == "quality_classifier":
            gone = set(before) - set(after)
            assert all(300 <= i < 390 for i in gone - {601, 602}) and len(gone) >= 85
        elif name == "line_dedup":
            hot = "shared line here."
            assert after == {i: "\n".join(x for x in t.split("\n") if " ".join(x.split()).lower() != hot) if t else t for i, t in before.items()}
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
        elif name == "minhash_near_dedup":
            ids = sorted(before)
            label = brute_groups([(i, before[i]) for i in ids], 0.85)
            assert len(after) == len(set(label)) and {label[ids.index(i)] for i in after} == set(label)
            assert all(before[i] == after[i] for i in after)
        elif name == "secret_scans":
            assert {i for i in before if before[i] != after[i]} == {600} and KEY not in after[600] and "<secret>" in after[600]
        else:
            want = {i: len((t or "").split()) for i, t in before.items()}
            held = {}
            for r in rows:
                held[r.doc_id] = held.get(r.doc_id, 0) + r.length
            assert held == {i: n for i, n in want.items() if n}
            assert max(np.bincount(np.unique([r.bin_id for r in rows], return_inverse=True)[1], [r.length for r in rows])) <= 2048


def test_run_gives_what_the_stages_give(spark, corpus):
    got = corpus_pipeline.run(spark, corpus)
    assert got.columns == ["bin_id", "slot", "doc_id", "start", "length"] and got.count() > 250


def test_stages_on_odd_documents(spark, corpus):
    docs = odd(spark).select(*DOCS.replace(",", "").split()[::2])
    extra = docs.select("*", *(F.lit(3).alias(c) for c in ("__key", "__lines", "N_LINES", "keep", "bin", "a.b")))
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, extra):
            out = stage(spark, some, corpus)
            rows = out.collect()
            assert stage(spark, some.limit(0), corpus).collect() == []
            if name == "best_fit_packing":
                assert sum(r.length for r in rows if r.doc_id == 5) == 30_000
            elif name == "line_dedup":
                assert len(rows) == 9 and sorted(r.text or "" for r in rows) == sorted(r.text or "" for r in some.collect())
            elif name == "minhash_near_dedup":
                assert len(rows) == 8 and out.dtypes == some.dtypes
            elif name == "secret_scans":
                assert len(rows) == 9 and out.dtypes == some.dtypes and all((r.text is None) == (r.n_chars is None) for r in rows)
            else:
                assert out.dtypes == some.dtypes and all(r in some.collect() for r in rows)


def test_common_lines_go_even_where_they_are_most_of_a_document(spark):
    common = "\n".join(f"common line number {k} of them" for k in range(4))
    texts = {i: f"{common}\nown {i}" for i in range(60)} | {100 + i: f"copied text\nof its own {common[:9]}" for i in range(60)} | {200: common}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_common_lines(spark, df, "").collect()}
    assert got == {i: f"own {i}" if i < 60 else "" if i == 200 else t for i, t in texts.items()}


def test_without_the_subpackage_the_rest_imports():
    root = Path(__file__).parents[2]
    code = "import sys; sys.modules['codeloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_every_operator_has_a_query():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
