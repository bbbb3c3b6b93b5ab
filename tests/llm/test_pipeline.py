"""The pipeline's stages against brute-force versions, each on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quire.llm.queries import vocabulary
from quire.llm.shared import run_folder, written
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder, given = docs.columns, run_folder(spark, "pipeline-test"), []
    for k, (_, stage) in enumerate(P.STAGES):
        given.append(docs)
        docs = written(stage(spark, docs, SF), f"{folder}/{k}")
        if k < 4:
            assert docs.columns == columns
    rows = [{r.doc_id: r for r in g.collect()} for g in given]
    assert all(len(r) == g.count() for r, g in zip(rows, given))
    assert all(set(b) <= set(a) and all(b[i] == a[i] for i in b) for a, b in zip(rows, rows[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert all(i in gone for i, q in labels.items() if q == 0 and i in rows[0])
    long = lambda i: len(H.words(rows[0][i].text)) >= 20
    assert np.mean([i in gone for i, q in labels.items() if q == 1 and i in rows[0] and long(i)]) < 0.05
    groups = H.near_groups([(i, r.text) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {i for i, c in groups.items() if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in rows[2].items() if any(t in r.text for t in items)}
    assert set(rows[2]) - set(rows[3]) == leaked
    assert 0 < len(rows[4]) < len(rows[3])
    tok = Tokenizer.from_file(vocabulary())
    want, start = [], 0
    for i in sorted(rows[4]):
        ids = np.array(tok.encode(rows[4][i].text, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in docs.collect()) == want


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_are_documents_like_others(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(9, "a b c d"), (9, "q r s t u v"), (11, "q r s t u v"), (4, "a b c d"), (20, "x y z one"), (20, "x y z two"), (None, long), (None, long), (30, long), (None, "alone")]
    docs = H.documents(spark, rows).withColumns({"_row": F.lit(1), "row": F.lit(2), "doc": F.lit("x")})
    got = P.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(4, "a b c d"), (9, "q r s t u v"), (20, "x y z one"), (20, "x y z two"), (30, long), (None, "alone")], key=str)
    spark.createDataFrame([(None, long), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = P.decontaminate(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([r for r in rows if r[1] != long], key=str)
