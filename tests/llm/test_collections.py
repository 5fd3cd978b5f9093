"""Conversation trie, token files and importance resampling against brute force and on odd rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest

from marlstone.llm import conversations, importance, queries, tokenfiles

SF = "/root/testdata/sf0.001"


# conversations


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    return out


def trie(rows):
    paths = rebuilt(rows)
    members, children, sums = defaultdict(list), defaultdict(set), {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[k] for k in children[p]]
        sums[p] = (len(members[p]) - 1) * words + sum(s for s, _ in below), sum(n for _, n in below) or 1
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sums[p][1], sums[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [conversations.BLOCK, 2])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    found = conversations.trie(spark.createDataFrame(rows, CONVERSATION))
    assert sorted(map(tuple, found.collect())) == trie(rows)


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(20, 32) for t in range(c % 7)]  # short ones may lose all their turns
    rows += [(40, t, "user", "again") for t in range(30)]  # many turns alike
    rows += [(c, t, "user", "the same") for c in range(100, 160) for t in range(3)]  # many conversations alike
    rows += [(61, None, None, None), (61, 3, None, "x\ty\n"), (61, 3, "user", None), (61, 3, "user", None), (None, 1, "user", "lost"), (81, 0, "", ""), (2**40, 1, "a", "long " * 5000)]
    found = conversations.trie(spark.createDataFrame([(*r, 1, 2, "z") for r in rows], CONVERSATION + ", depth long, a long, words string"))
    assert sorted(map(tuple, found.collect())) == trie(rows)


def test_roles_and_texts_are_kept_apart(spark):
    rows = [(200, 1, "a", "b c"), (201, 1, "ab", " c"), (202, 1, "", "ab c")]
    assert conversations.trie(spark.createDataFrame(rows, CONVERSATION)).where("depth = 1").count() == len({p[:1] for p in rebuilt(rows).values() if p})


def test_no_conversations(spark):
    assert conversations.trie(spark.createDataFrame([], CONVERSATION)).collect() == []


# token files


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 2] for e in found]


def stored_rows(rows):
    """(doc_id, start, n_tokens, crc) in the order of the files; rows: (doc_id, text)."""
    out, start = [], 0
    for (i, _), ids in zip(rows, encoded([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, queries.op12_token_files(spark, SF).collect())) == stored_rows(rows)


WORDS = ["It's", "we'll 'S", "a1b22", "Straße", "ÉCOLE é", "中文字", "x y", "\x1c\x0b", "<|endoftext|>", "a<|startoftext|>b", "İstanbul ΣΑΣ", "🙂", "--", "\t", "\r\n", "ﬁ", "\x00", "Ÿž'S", "çÀ1É", "«¿qué?»", "“Ŋ”–", "e\u0301", "ſŉ", "·…x€9", "\xa0", "ß'll"]


def test_words_are_encoded_as_in_whole_texts():
    import random

    draw = random.Random(1)
    texts = ["".join(draw.choice(WORDS) + draw.choice(["", " ", "  ", "\n"]) for _ in range(12)) for _ in range(300)] + ["", " ", "a" * 5000, "1" * 3000]
    encoder = tokenfiles.WordEncoder(tokenfiles.default_tokenizer())
    assert [np.frombuffer(encoder.text(t), "<u2").tolist() for t in texts] == [e[:-1] for e in encoded(texts)]


def test_odd_documents(spark, tmp_path, monkeypatch):
    rows = [(None, "no key"), (None, None), (-5, "below"), (3, None), (3, ""), (7, "seven " * 20000), (2**62, "far")]
    rows += [(5, f"copy {i % 3}") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, key long, file string")
    store = tokenfiles.write(docs, f"file://{tmp_path}/ids")
    found = [tuple(r) for r in tokenfiles.lookup(store, docs).collect()]
    assert Counter((k, np.frombuffer(x, "<u4").tobytes()) for k, _, _, x in found) == Counter((i, np.array(ids, "<u4").tobytes()) for (i, _), ids in zip(rows, encoded([t for _, t in rows])))
    found.sort(key=lambda r: r[1])
    starts = np.cumsum([0, *[r[2] for r in found]])[:-1].tolist()
    assert [r[1] for r in found] == starts  # they lie one after another, in the order of keys
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    absent = spark.createDataFrame([(4,), (6,), (2**63 - 1,), (-(2**63),)], "doc_id long")
    assert tokenfiles.lookup(store, absent).collect() == []


def test_a_key_that_goes_on_in_later_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    made = []
    for keys in ([None, None, 1, 4], [4, 4], [4, 9]):
        writer = tokenfiles.ShardWriter(files, path, "<u2")
        for k in keys:
            writer.add(k, np.array([len(made), k or 0], "<u2").tobytes())
        made.append(writer.close())
    rows = [(i, x["file"], x["least"], x["most"], x["nulls"], x["docs"], x["ids"], sum(y["ids"] for y in made[:i])) for i, x in enumerate(made)]
    shards = spark.createDataFrame(rows, "shard long, file string, least long, most long, nulls long, docs long, ids long, start long")
    asked = spark.createDataFrame([(4,), (None,), (9,), (5,)], "doc_id long")
    found = tokenfiles.lookup(tokenfiles.Store(folder, shards), asked).collect()
    assert sorted((r["start"], r["key"]) for r in found) == [(0, None), (2, None), (6, 4), (8, 4), (10, 4), (12, 4), (14, 9)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 40_000])
def test_the_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    hashes = tokenfiles.hashed(keys)
    seeds = tokenfiles.perfect(hashes)
    if n:
        assert sorted(tokenfiles.slots(hashes, seeds[tokenfiles.buckets(hashes, len(seeds))], n).tolist()) == list(range(n))


def test_one_key_is_read_by_a_fixed_number_of_reads(tmp_path):
    files = pyarrow.fs.LocalFileSystem()
    writer = tokenfiles.ShardWriter(files, str(tmp_path), "<u2")
    for k in range(5000):
        writer.add(k * 3, np.array([k % 1000, 2], "<u2").tobytes())
    shard = tokenfiles.Shard(files, os.path.join(tmp_path, writer.close()["file"]))
    reads, read = [], shard._read
    shard._read = lambda at, n: reads.append(n) or read(at, n)
    assert [(at, ids.tolist()) for at, ids in shard.get(300)] == [(200, [100, 2])]
    assert len(reads) == 4 and sum(reads) < 50
    assert shard.get(301) == []


def test_no_documents_for_files(spark):
    assert tokenfiles.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# importance


def runs(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(docs, target):
    found = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in runs(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able):
        r[4] = place + 1 if place < 5 * len(able) // 100 else None
    return Counter(tuple(r[:4]) + (r[4] if r in able else None,) for r in out)


DOCS = "doc_id long, text string"


@pytest.mark.parametrize("short, size", [(importance.SHORT, importance.CHUNK_WORDS), (200, 7)])
def test_importance_equals_brute_force(spark, monkeypatch, short, size):
    monkeypatch.setattr(importance, "SHORT", short)
    monkeypatch.setattr(importance.parts, "__defaults__", (size,))
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = Counter(tuple(r) for r in importance.report(docs, target).collect())
    assert found == resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])


def test_importance_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "SHORT", 100)
    monkeypatch.setattr(importance, "WINDOW", 64)
    monkeypatch.setattr(importance.parts, "__defaults__", (5,))
    rows = [(None, "a b"), (None, None), (1, ""), (2, "..."), (3, "Ünï CODE Ö x9"), (4, "w" * 500), (4, "q" * 130 + " " + "r" * 60 + " é"), (5, "one two three " * 400), (6, "\x00a\x7fb")]
    rows += [(7, "same words again " * 9)] * 50 + [(i, f"text {i} " * 12) for i in range(100, 160)]
    docs = spark.createDataFrame([(*r, 0, b"", 1) for r in rows], DOCS + ", row long, part binary, weight int")
    found = Counter(tuple(r) for r in importance.report(docs, spark.createDataFrame([("one two text",), (None,)], "text string")).collect())
    assert found == resampled(rows, ["one two text", None])


def test_parts_own_each_run_once(monkeypatch):
    for window in (16, 1 << 20):
        monkeypatch.setattr(importance, "WINDOW", window)
        for count in (1, 2, 6, 7, 8, 9, 10, 23):
            text = " ".join(f"w{i}é" for i in range(count))
            made = list(importance.parts(text, 3, 7))
            chunk = importance.Chunk([p for p, _ in made], [o for _, o in made])
            assert sorted(chunk.features(3, 10000)[0].tolist()) == sorted(runs(text)[1])
            assert sum(o for _, o in made) == count


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], DOCS)
    assert importance.report(none, none).collect() == []
    rows = [(i, f"word{i} " * 25) for i in range(40)]
    assert Counter(tuple(r) for r in importance.report(spark.createDataFrame(rows, DOCS), none).collect()) == resampled(rows, [])
