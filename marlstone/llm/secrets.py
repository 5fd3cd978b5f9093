"""Secret scans: one Aho-Corasick pass finds keywords, expressions are tried only where one stands, checksums settle the rest.

Texts of a chunk are joined by line feeds, which no pattern matches, so that the automaton and the run search go over long
strings. Positions are bytes inside and code points outside.

Nulls: a null text counts as empty, a null id stays null. Empty texts have no spans. Repeated rows each give a row. A long
text is a chunk of its own. Overlapping spans of different kinds all stay; redaction merges them.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Kinds in their order: three base kinds, then those that only this method adds. Fixed values.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "stripe", "slack", "private_key")
#: By kind: its keywords in lower case, the expression tried at a keyword's place, the least length of a group. Fixed values.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RULES = {
    "assign": (ASSIGN_WORDS, rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (("akia",), rb"(AKIA[A-Z0-9]+)", 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", 36),
    "npm": (("npm_",), rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", 36),
    "stripe": (("sk_live_", "rk_live_"), rb"[sr]k_live_([A-Za-z0-9]{20,})", 20),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rb"xox[bpars]-([0-9A-Za-z-]{20,})", 20),
    "private_key": (("-----begin ",), rb"-----BEGIN (?:[A-Z]+ )*(PRIVATE KEY)-----", 11),
}
CHECKSUMMED = ("github", "npm")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LENGTH = 24
CHUNK = 1_000_000
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def checksum_holds(secret: bytes) -> bool:
    """The last six base-62 digits of such a token are the CRC-32 of what stands before them."""
    value, digits = zlib.crc32(secret[:-6]), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = DIGITS[digit] + digits
    return digits.encode() == secret[-6:]


@functools.cache
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, (words, _, _) in RULES.items():
        for word in words:
            out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


@functools.cache
def expression(kind: str) -> re.Pattern:
    return re.compile(RULES[kind][1])


def found(whole: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each span in bytes, in order."""
    spans, free = [], dict.fromkeys(RULES, 0)
    for last, (length, kind) in automaton().iter(whole.lower().decode("latin-1")):
        start = last - length + 1
        if start < free[kind] or not (match := expression(kind).match(whole, start)):
            continue
        free[kind] = match.end()
        if len(match[1]) >= RULES[kind][2] and (kind not in CHECKSUMMED or checksum_holds(match[1])):
            spans.append((start, KINDS.index(kind), match.end()))
    data = np.frombuffer(whole, np.uint8)
    digit = np.zeros(len(data) + 2, bool)
    digit[1:-1] = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    edges = np.flatnonzero(digit[1:] != digit[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= HEX_LENGTH
    spans += [(s, KINDS.index("hex"), e) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return sorted(spans)


def spans_of(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Each text's spans (kind, start, end), by start and then kind as listed; code points, end exclusive."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for a, b in common.text_chunks(texts, CHUNK):
        raws = [t.encode() for t in texts[a:b]]
        whole = b"\n".join(raws)
        spans = found(whole)
        if not spans:
            continue
        inner = np.concatenate([[0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) == 0x80)])  # continuation bytes so far
        places = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        at = np.array(spans)
        docs = np.searchsorted(places, at[:, 0], side="right") - 1
        base = places[docs] - inner[places[docs]]
        starts, ends = (at[:, c] - inner[at[:, c]] - base for c in (0, 2))
        for doc, kind, start, end in zip(docs.tolist(), at[:, 1].tolist(), starts.tolist(), ends.tolist()):
            out[a + doc].append((KINDS[kind], start, end))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of (kind, start, end), for each row."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), common.clean_text(text_col).alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in each] for each in spans_of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return rows.mapInArrow(common.frugal(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPANS}")


def covered(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the first one's kind in brackets."""
    parts, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the secrets of its texts replaced by their kinds; length_col, where it is there, follows. Null texts stay null."""
    common.small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = spans_of([t or "" for t in texts])
            fixed = [covered(t, s) if s else t for t, s in zip(texts, spans)]
            columns = batch.columns
            columns[at] = pa.array(fixed, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(common.frugal(run), rows.schema)
    if length_col in names:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, a digest of the base spans and all spans as text."""
    found_spans = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found_spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
