"""Slots for models: sentence encoders and entity recognisers.

A model is given as a function without arguments that loads it and returns a function over a list of texts. It is loaded once
in each Python worker and task, and called with the texts of a batch. A hashing encoder and a gazetteer stand in the slots
where no model is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone import config
from marlstone.operators.extract import ENTITY_TYPES

Encoder = Callable[[list[str]], np.ndarray]
Recogniser = Callable[[list[str]], list[list[dict]]]
#: Texts that a model gets at once.
BATCH = 64


def encoded(docs: DataFrame, key: str, text: str, load: Callable[[], Encoder]) -> DataFrame:
    """(key, vector): each text's vector of unit length; a null text counts as empty, a zero vector stays zero."""
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), BATCH):
                found = np.asarray(encoder(texts[at : at + BATCH]), np.float64)
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, BATCH), vectors], names=[key, "vector"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, vector array<double>")


def hashing_encoder(buckets: int = config.HASH_BUCKETS) -> Callable[[], Encoder]:
    """Counts of words of two characters and more by a bucket of their digest."""

    def load() -> Encoder:
        import hashlib

        import regex

        word = regex.compile(r"[\p{L}\p{M}\p{N}\p{Pc}]+(?:\.?[\p{L}\p{M}\p{N}\p{Pc}]+)*")

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), buckets))
            for i, text in enumerate(texts):
                for w in word.findall(text.lower()):
                    if len(w) > 1:
                        out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets] += 1
            return out

        return encode

    return load


def recognised(docs: DataFrame, load: Callable[[], Recogniser], most_errors: int = 0) -> DataFrame:
    """(doc_id, lang, text, type, score, start, end): the entities that a recogniser finds in content; its labels become entity types.

    Blank texts have none. A text at which the recogniser fails has none either, up to most_errors of them in a task; more
    are an error. start is the first place of the name in the text where the recogniser gives none, -1 if it isn't there."""
    rows = docs.select("doc_id", "lang", F.coalesce("content", F.lit("")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser, failed = load(), 0

        def found_in(texts: list[str]) -> list[list[dict]]:
            nonlocal failed
            try:
                return recogniser(texts)
            except Exception:
                if len(texts) > 1:
                    return [found_in([t])[0] for t in texts]
                failed += 1
                if failed > most_errors:
                    raise
                return [[]]

        for batch in batches:
            ids, langs, texts = (c.to_pylist() for c in batch.columns)
            out = []
            live = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(live), BATCH):
                part = live[at : at + BATCH]
                for i, entities in zip(part, found_in([texts[i] for i in part])):
                    for e in entities:
                        name = e.get("entity") or e.get("text") or ""
                        start = e["start"] if e.get("start") is not None else texts[i].find(name)
                        end = e["end"] if e.get("end") is not None else start + len(name) if start >= 0 else -1
                        out.append((ids[i], langs[i], name, ENTITY_TYPES.get(str(e.get("type", "")).upper(), "Concept"), float(e.get("score", 1.0)), start, end))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "lang", "text", "type", "score", "start", "end"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, lang string, text string, type string, score double, start int, end int")


def gazetteer_recogniser(names: dict[str, str]) -> Callable[[], Recogniser]:
    """A recogniser of given names (name -> type), whole words in any case; the list has to fit in a worker's memory."""

    def load() -> Recogniser:
        import re

        known = {k.lower(): v for k, v in names.items()}
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(k) for k in sorted(known, key=len, reverse=True)) + r")(?!\w)") if known else None

        def find(texts: list[str]) -> list[list[dict]]:
            return [[{"entity": t[m.start() : m.end()], "type": known[m[0]], "score": 1.0, "start": m.start(), "end": m.end()} for m in pattern.finditer(t.lower())] if pattern else [] for t in texts]

        return find

    return load
