"""Byte-level BPE: encoding without a regex, and decoding by the offsets kept.

Text is cut into pieces by a finite-state machine over classes of code points. Each symbol is a function from state to
state, and such functions compose associatively: blocks of symbols are composed side by side, the blocks' functions are
scanned, and a second sweep reads off the piece starts. The look-ahead that the split pattern has (contractions, the last
space before a word) goes into the symbols. A piece's merges are done once and kept in a bounded cache.

The digests of a text's ids and of what they decode to are made where the text is encoded, in one pass, so that neither ids
nor decoded bytes cross back to the JVM for them.

Nulls: a null text counts as empty; a null id stays null. Empty texts have no tokens and decode to no bytes. Repeated rows
and ids each give a row. Very long texts are chunks of their own; a long piece merges by a heap. Ties don't arise but among
pairs of equal rank, of which the leftmost merges first. An empty table gives an empty one. Columns other than the id and
the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

#: States: at a fresh place, in a run of letters, of digits, of others, after a space that joins the next run, in white
#: space, one or two letters before the end of a contraction.
FRESH, LETTER, DIGIT, OTHER, SPACE, WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: Symbols: letter, digit, other, an apostrophe with one or two letters of a contraction behind it, the space before a
#: visible character, other white space there, white space before more of it or the end. Plus 8: a text's first one.
S_LETTER, S_DIGIT, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_EDGE, S_WHITE = range(8)
#: White space of the split pattern. Fixed values of the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Fixed values of the split pattern: what follows the apostrophe of a contraction.
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")
BLOCK = 128
#: Code points that are worked on at once, and pieces that a worker remembers (twice as many at most): both bound its memory.
CHUNK = 200_000
CACHE_PIECES = 100_000
CACHED_LENGTH = 40
NO_RANK = 1 << 40


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece?), both by state * 16 + symbol."""
    goes, starts = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    runs = {S_LETTER: LETTER, S_DIGIT: DIGIT, S_OTHER: OTHER}
    for state in range(8):
        for symbol, run in runs.items():
            goes[state, symbol], starts[state, symbol] = run, state not in (run, SPACE)
        for symbol, left in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
            inside = state in (OTHER, SPACE)
            goes[state, symbol], starts[state, symbol] = OTHER if inside else left, not inside
        goes[state, S_SPACE], starts[state, S_SPACE] = SPACE, True
        goes[state, S_EDGE], starts[state, S_EDGE] = FRESH, True
        goes[state, S_WHITE], starts[state, S_WHITE] = WHITE, state != WHITE
    goes[TWO_LEFT, S_LETTER], starts[TWO_LEFT, S_LETTER] = ONE_LEFT, False
    goes[ONE_LEFT, S_LETTER], starts[ONE_LEFT, S_LETTER] = FRESH, False
    goes[:, 8:], starts[:, 8:] = goes[FRESH, :8], True
    return goes.ravel(), starts.ravel()


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: S_LETTER, S_DIGIT, S_WHITE or S_OTHER, by the Unicode tables of the tokenizer library.

    It is worked out once on the driver; workers get the array."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out = np.full(0x110000, S_OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", S_LETTER), (r"\p{N}", S_DIGIT)):
        table = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(table.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = S_WHITE
    return out


def symbols(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The machine's symbols of joined texts; first: where the texts that aren't empty begin; kinds: the class of each code point."""
    out = kinds[points]
    n = len(points)
    ends = np.zeros(n + 3, bool)  # a text begins here, or all end
    ends[first] = True
    ends[n:] = True
    white = out == S_WHITE
    edge = np.flatnonzero(white[:-1] & ~white[1:] & ~ends[1:n]) if n > 1 else np.empty(0, int)
    out[edge] = np.where(points[edge] == 32, S_SPACE, S_EDGE)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        after = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = after[quotes + 1], after[quotes + 2]
        here = ~ends[quotes + 1]
        short = here & np.isin(one, [ord(x) for x in SHORT_CONTRACTIONS])
        long = here & ~ends[quotes + 2] & np.isin(one.astype(np.int64) << 21 | two, [ord(x[0]) << 21 | ord(x[1]) for x in LONG_CONTRACTIONS])
        out[quotes[short]] = S_SHORT
        out[quotes[long]] = S_LONG
    out[first] |= 8
    return out


def piece_starts(found: np.ndarray) -> np.ndarray:
    """Where pieces begin, by a scan of the symbols' composed functions."""
    goes, starts = machine()
    n = len(found)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, S_OTHER, np.uint8)
    grid[:n] = found
    columns = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.intp)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))  # each block's function
    for column in columns:
        maps = goes[(maps.astype(np.intp) << 4) | column[:, None]]
    step = 1
    while step < rows:  # inclusive scan of the blocks' functions by doubling
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.intp)
    out = np.empty((BLOCK, rows), bool)
    for i, column in enumerate(columns):
        at = (state << 4) | column
        out[i] = starts[at]
        state = goes[at].astype(np.intp)
    return np.flatnonzero(out.T.ravel()[:n])


class Vocabulary:
    """Ranks of a byte-level BPE, its merges, and the arrays that decode."""

    def __init__(self, lines: bytes, kinds: np.ndarray | None = None):
        self.kinds = classes() if kinds is None else kinds
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        size = max(self.ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
            self.lengths[rank] = len(word)
        self.pairs = [NO_RANK] * 65536  # the ranks of all pairs of bytes
        for word, rank in self.ranks.items():
            if len(word) == 2:
                self.pairs[word[0] << 8 | word[1]] = rank
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the cache before it last was full

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece: of adjacent parts the pair of lowest rank, leftmost first, becomes one, as long as there is one."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) <= CACHED_LENGTH:
            none, get = NO_RANK, ranks.get
            cuts = list(range(len(piece) + 1))
            pairs = [self.pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
            while pairs and (best := min(pairs)) != none:
                i = pairs.index(best)
                del cuts[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
                if i:
                    pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
            return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray([1]) * n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue
            alive[j] = 0
            end[i], after[i] = to, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def packed(self, piece: str) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        if (out := self.older.get(piece)) is None:
            ids = self.merged(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            self.cache[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed."""
        out = [b""] * len(texts)
        for a, b in common.text_chunks(texts, CHUNK):
            whole = "".join(texts[a:b])
            if not whole:
                continue
            lengths = np.array([len(t) for t in texts[a:b]])
            places = np.concatenate([[0], np.cumsum(lengths)])
            first = places[:-1][lengths > 0]
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            starts = piece_starts(symbols(points, first, self.kinds))
            cuts = [*starts.tolist(), len(whole)]
            if len(self.cache) >= CACHE_PIECES:
                self.cache, self.older = {}, self.cache
            get = self.cache.get
            ids = [get(p) or self.packed(p) for p in map(whole.__getitem__, map(slice, cuts, cuts[1:]))]
            bounds = np.searchsorted(starts, places).tolist()
            for i in range(a, b):
                out[i] = b"".join(ids[bounds[i - a] : bounds[i - a + 1]])
        return out

    def offsets(self, ids: bytes) -> bytes:
        """Where each token begins in the text's bytes, packed like ids."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        return (np.cumsum(lengths) - lengths).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        """Tokens put back at their offsets, all of a length at a time."""
        tokens, at = np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        if not len(tokens):
            return b""
        lengths = self.lengths[tokens]
        out = np.empty(int(at[-1] + lengths[-1]), np.uint8)
        for size in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == size)
            span = np.arange(size)
            out[at[of][:, None] + span] = self.blob[self.places[tokens[of]][:, None] + span]
        return out.tobytes()


_VOCABULARIES: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One per Python worker and broadcast."""
    if shared.id not in _VOCABULARIES:
        _VOCABULARIES.clear()
        lines, kinds = shared.value
        _VOCABULARIES[shared.id] = Vocabulary(lines, np.frombuffer(kinds, np.uint8))
    return _VOCABULARIES[shared.id]


class _Shared:
    """A vocabulary file's bytes and the classes of code points: under 1 MB and 1.1 MB whatever the corpus, so they may be broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            self.sent = spark.sparkContext.broadcast((file.read(), classes().tobytes()))
        self.id = hash(path)

    @property
    def value(self) -> tuple[bytes, bytes]:
        return self.sent.value


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: id_col, n_tokens long, ids and offsets binary (little-endian unsigned 32-bit integers, one for each token)."""
    common.small_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, vocabulary or default_vocabulary())
    rows = docs.select(F.col(id_col), common.clean_text(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(shared)
        for batch in batches:
            ids = words.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), common.packed(ids), common.packed(map(words.offsets, ids))],
                names=[id_col, "n_tokens", "ids", "offsets"],
            )

    return rows.mapInArrow(common.frugal(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of encode() and decoded binary; columns other than ids and offsets stay."""
    shared = _Shared(encoded.sparkSession, vocabulary or default_vocabulary())
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    i, o = encoded.columns.index("ids"), encoded.columns.index("offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(shared)
        for batch in batches:
            texts = map(words.decode, batch.column(i).to_pylist(), batch.column(o).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, common.packed(texts)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(common.frugal(run), ", ".join([*fields, "decoded binary"]))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded again."""
    common.small_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, vocabulary or default_vocabulary())
    rows = docs.select("doc_id", common.clean_text().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(shared)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in words.encode(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(words.decode(ids, words.offsets(ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(common.frugal(run), f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
