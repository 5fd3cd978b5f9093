"""The pipeline against its stages by brute force."""

import hashlib
import json
import os
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from marlstone.llm import bpe, mixing, toxicity
from tests.llm.test_operators import DOCS, classes_by_force, spans_by_force


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefgh") + rng.choice("rstuvw") * rng.randint(1, 4) for _ in range(40)]
        if i % 10 == 0:
            words[7:7] = ["you", "idiot"]
        if i % 7 == 0:
            words.append("password=geheim99")
        rows.append([i, " ".join(words), rng.choice(["en", "de"]), f"src{i % 3}", 0])
    rows += [[100 + i, rows[i][1], "en", "src1", 0] for i in range(1, 5)] + [[200, None, None, None, None], [201, "", "en", "src0", 0]]
    rows.append([202, " ".join(f"long{rng.randrange(10**6)}" for _ in range(20_000)), "en", "src2", 0])
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    grammar = toxicity.Grammar()
    clean = [r for r in rows if grammar.score(r[1] or "") < toxicity.THRESHOLD]
    classes = {i: c for i, c, _ in classes_by_force([(r[0], r[1]) for r in clean])}
    single = [r for r in clean if classes[r[0]] == r[0]]
    for r in single:
        for kind, start, end in reversed(spans_by_force(r[1] or "")):
            r[1] = f"{r[1][:start]}[{kind}]{r[1][end:]}"
    expected = {r.doc_id for r in mixing.kept(spark.createDataFrame([tuple(r) for r in single], DOCS), corpus_pipeline.MIXTURE).collect()}
    assert len(clean) < len(rows) and len(single) < len(clean) and set(found) == expected and len(expected) < len(single)
    with open(bpe.default_vocabulary(), "rb") as file:
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(file.read()).ranks, special_tokens={})
    for r in single:
        if r[0] in expected:
            assert found[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
            ids = np.array(other.encode_ordinary(r[1] or ""), "<u4")
            assert (found[r[0]].n_tokens, found[r[0]].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
