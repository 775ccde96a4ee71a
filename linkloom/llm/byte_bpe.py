"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, exact decoding.

Text is cut into pieces by the pattern of the public rank files,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regex. Each code point of a slice of documents gets a class from a table
(letter, number, space, other white space, other; letters of the contractions and
the apostrophe have classes of their own), and with the class of the next code
point it is a symbol of a small automaton whose state says what piece goes on. A
symbol is a function from state to state, and functions compose associatively:
the slice is laid out in rows, the functions of all rows are composed column by
column at once, the rows' functions are composed one after the other, and a second
pass from each row's known first state gives the state at every code point. A
piece starts where the automaton says so. The class table comes from the library
whose results are to be met, by asking it which code points ``\\p{L}``, ``\\p{N}``
and ``\\s`` match, so both hold to one version of Unicode.

Equal pieces of a slice are encoded once: first by the ranks as a whole, else by
merging the pair of least rank, leftmost first, from a heap. A task keeps the ids
of pieces it has seen in a cache of bounded size. Pieces are told apart by a
64-bit hash; each slice's ids are decoded and compared with its bytes, and a slice
that differed would be encoded again piece by piece.

Each token keeps the byte offset at which it starts, so that any span of tokens
can be decoded and placed in the text. Nothing is shuffled; ranks and class table
are of fixed size (a megabyte each) and are broadcast.

Defined cases: a null text is empty and an empty text has no tokens; null ids and
repeated rows are kept; an empty table gives an empty result; extra columns are
ignored; a text of any length is one row, held whole in one task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import documents_of
from linkloom.llm.words import bytes_hash, slices

#: Code points of a row of the blocked scan.
ROW = 512
#: Pieces whose ids a task keeps.
CACHE = 1 << 18

# classes of code points; END stands between documents
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, END = range(7)
#: Letters that can follow an apostrophe in a contraction; fixed by the pattern.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
S_T_M_D, R, V, L, E = range(7, 12)
N_CLASSES = 12
_LETTERS = (LETTER, S_T_M_D, R, V, L, E)

# states: the kind of piece that the code point belongs to, and what it needs to know of what is before it
AT_END, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, LONE_SPACE, QUOTE_1, QUOTE_2, HALF_2, CONTRACTED = range(10)
N_STATES = 10


def class_table() -> np.ndarray:
    """Class of every code point, by the patterns of the library itself."""
    import tiktoken

    points = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(points)).decode()  # what matches; the rest is left out
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")], table[ord("'")], table[0x110000] = SPACE, QUOTE, END
    for letters, kind in ((ONE_LETTER, S_T_M_D), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in letters]] = kind
    return table


def _step(state: int, c: int, after: int, after2: int) -> tuple[int, bool]:
    """State after code point class ``c`` before classes ``after``, ``after2``, and
    whether a piece starts at it."""
    if c == END:
        return AT_END, True
    if state in (QUOTE_1, HALF_2):  # the last letter of a contraction
        return CONTRACTED, False
    if state == QUOTE_2:
        return HALF_2, False
    if c in (SPACE, WHITE):
        before_more = after in (SPACE, WHITE, END)
        if c == SPACE and not before_more:  # the space goes with what follows
            return LONE_SPACE, True
        # white space before more of it is one piece, its last code point another unless the text ends
        return IN_WHITE, state != IN_WHITE or not before_more
    same = IN_LETTERS if c in _LETTERS else IN_NUMBERS if c == NUMBER else IN_OTHERS
    if state in (same, LONE_SPACE):
        return same, False
    if c == QUOTE and after == S_T_M_D:
        return QUOTE_1, True
    if c == QUOTE and (after, after2) in ((R, E), (V, E), (L, L)):
        return QUOTE_2, True
    return same, True


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag by [symbol, state]; a symbol is the classes of a
    code point and of the two after it."""
    kinds, states = range(N_CLASSES), range(N_STATES)
    rows = [[_step(s, c, a, b) for s in states] for c in kinds for a in kinds for b in kinds]
    both = np.array(rows)
    return both[:, :, 0].astype(np.uint8), both[:, :, 1].astype(bool)


_TO, _STARTS = automaton()


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Places in an array of classes where a piece starts; documents end with END."""
    n = len(classes)
    rows = -(-n // ROW)
    padded = np.full(rows * ROW + 2, END, np.int16)
    padded[:n] = classes
    symbols = ((padded[:-2] * N_CLASSES + padded[1:-1]) * N_CLASSES + padded[2:]).reshape(rows, ROW).T.copy()
    # each row's function, composed from its end: once it sends all states to one, what is before doesn't matter
    whole = _TO[symbols[-1]]
    open_, t = np.arange(rows), ROW - 2
    while t >= 0 and len(open_ := open_[(whole[open_] != whole[open_, :1]).any(axis=1)]):
        whole[open_] = np.take_along_axis(whole[open_], _TO[symbols[t, open_]], axis=1)
        t -= 1
    first = np.empty(rows, np.uint8)
    state = AT_END
    for r in range(rows):
        first[r] = state
        state = whole[r, state]
    before = np.empty((ROW, rows), np.uint8)
    flat, state = _TO.ravel(), first
    for t in range(ROW):
        before[t] = state
        state = flat[symbols[t].astype(np.int32) * N_STATES + state]
    return np.flatnonzero(_STARTS.ravel()[symbols.astype(np.int32) * N_STATES + before].T.ravel()[:n])


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.uint32)
    tail = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
    for least, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        long = np.flatnonzero((point >= least) & (point < 0x100) & (data[at] >= least))
        if not len(long):
            break
        own = at[long]
        made = data[own].astype(np.uint32) & (0x7F >> size)
        for k in range(1, size):
            made = made << np.uint32(6) | tail[own + k]
        # those of more bytes are made again by the next round
        point[long] = np.where(data[own] >= (0xE0, 0xF0, 0xF8)[size - 2], data[own], made)
    return np.minimum(point, 0x10FFFF), at


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the whole piece if it has a rank, else pairs merged by
    least rank, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or ranks.get(piece[i : after[j]]) != r:
            continue
        end = after[i] = after[j]
        alive[j] = False
        if end < n:
            before[end] = i
            if (x := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (x, i))
        if (p := before[i]) >= 0 and (x := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (x, p))
    return [ranks[piece[i : after[i]]] for i in range(n) if alive[i]]


class Vocabulary(NamedTuple):
    """What tasks need of a rank file, of fixed size."""

    ranks: dict[bytes, int]
    classes: np.ndarray
    pairs: np.ndarray  # left * tokens + right of every pair of tokens that has a rank, sorted
    joined: np.ndarray  # the rank of each of these
    body: np.ndarray  # bytes of the tokens by rank
    first: np.ndarray  # where each token's bytes start; one more than tokens


def vocabulary(path: str) -> Vocabulary:
    """Read a rank file (a line a token: base64 of its bytes, rank)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    first = np.append(0, np.cumsum([len(t) for t in tokens]))
    splits = [(a * len(tokens) + b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
    pairs = np.array(sorted(splits), np.int64).reshape(-1, 2)
    return Vocabulary(ranks, class_table(), pairs[:, 0].copy(), pairs[:, 1].copy(), np.frombuffer(b"".join(tokens), np.uint8), first)


#: Pieces up to the last of these sizes are merged side by side, each among those
#: of about its size; longer ones have a heap each.
WIDTHS = [4, 6, 8, 10, 12, 16, 24, 64]
_NONE = np.iinfo(np.int64).max


def _pair_ranks(left: np.ndarray, right: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    key = np.where((left >= 0) & (right >= 0), left * (len(vocab.first) - 1) + right, -1)
    at = np.searchsorted(vocab.pairs, key)
    at[at == len(vocab.pairs)] = 0
    return np.where(vocab.pairs[at] == key, vocab.joined[at], _NONE) if len(vocab.pairs) else np.full(key.shape, _NONE)


def _merged_rows(pieces: list[bytes], width: int, vocab: Vocabulary) -> list[bytes]:
    """As ``merged``, as bytes of 32-bit ids, for pieces of up to ``width`` bytes that are no tokens: in each
    round every piece merges its leftmost pair of least rank."""
    size = np.array([len(p) for p in pieces])
    bytes_at = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    single = np.array([vocab.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
    tokens = np.where(np.arange(width) < size[:, None], single[bytes_at], -1)
    byte_pairs = _pair_ranks(single.repeat(256), np.tile(single, 256), vocab)
    rank = np.where(np.arange(1, width) < size[:, None], byte_pairs[bytes_at[:, :-1].astype(np.int32) * 256 + bytes_at[:, 1:]], _NONE)
    done = np.full((len(pieces), width), -1, np.int64)
    rows, columns = np.arange(len(pieces)), np.arange(width)
    while len(rows):
        own = np.arange(len(rows))
        j = np.argmin(rank, axis=1)
        r = rank[own, j]
        ready = r == _NONE
        if ready.any():
            done[rows[ready]] = tokens[ready]
            rows, tokens, rank, j, r = (x[~ready] for x in (rows, tokens, rank, j, r))
            own = np.arange(len(rows))
            if not len(rows):
                break
        tokens[own, j] = r
        shifted = np.minimum(columns + (columns > j[:, None]), width - 1)
        tail = tokens[:, -1].copy()
        tokens = np.take_along_axis(tokens, shifted, axis=1)
        tokens[:, -1] = np.where(j == width - 1, tail, -1)
        rank = np.take_along_axis(rank, np.minimum(shifted[:, :-1], width - 2), axis=1)
        rank[:, -1] = _NONE
        rank[own, j] = _pair_ranks(r, tokens[own, np.minimum(j + 1, width - 1)], vocab)
        left = np.flatnonzero(j > 0)
        rank[left, j[left] - 1] = _pair_ranks(tokens[left, j[left] - 1], r[left], vocab)
    held = done >= 0
    cuts = np.append(0, np.cumsum(held.sum(axis=1) * 4)).tolist()
    flat = done[held].astype(np.int32).tobytes()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def merged_all(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of each piece, as the bytes of 32-bit numbers."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    widths = np.searchsorted(WIDTHS, np.arange(WIDTHS[-1] + 1)).tolist()
    for i, p in enumerate(pieces):
        if (whole := vocab.ranks.get(p)) is not None:
            out[i] = whole.to_bytes(4, "little")
        elif len(p) <= WIDTHS[-1]:
            by_width.setdefault(widths[len(p)], []).append(i)
        else:
            out[i] = np.array(merged(p, vocab.ranks), np.int32).tobytes()
    for w, own in by_width.items():
        for lo in range(0, len(own), 20_000):
            part = own[lo : lo + 20_000]
            for i, ids in zip(part, _merged_rows([pieces[i] for i in part], WIDTHS[w], vocab), strict=True):
                out[i] = ids
    return out


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (size[0] of them), lo[1], ..."""
    begin = np.cumsum(size) - size
    return np.repeat(lo - begin, size) + np.arange(int(size.sum()))


def decoded(ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens, and where each starts; one more than tokens."""
    size = vocab.first[ids + 1] - vocab.first[ids]
    return vocab.body[_ranges(vocab.first[ids], size)], np.append(0, np.cumsum(size))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each row starts in them."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def encoded(column: pa.Array, vocab: Vocabulary, cache: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens of a slice of a string column without nulls; the byte of its
    text at which each starts; and each row's first token, one more than rows."""
    data, off = _bytes_of(column)
    points, at = code_points(data)
    ends = np.searchsorted(at, off[1:])
    classes = np.insert(vocab.classes[points], ends, END)
    place = np.insert(at, ends, off[1:])
    found = piece_starts(classes)
    found = found[classes[found] != END]
    lo = place[found]
    hi = place[np.append(found[1:], 0)]
    rows = np.searchsorted(lo, off)
    last = rows[1:][np.diff(rows) > 0] - 1  # a document's last piece ends with it
    hi[last] = off[1:][np.diff(rows) > 0]
    body = data.tobytes()

    def ids_of(pieces: list[bytes]) -> list[bytes]:
        out = list(map(cache.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        fresh = [pieces[i] for i in new]
        for i, ids in zip(new, merged_all(fresh, vocab), strict=True):
            out[i] = ids
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
        cache.update((pieces[i], out[i]) for i in new if len(pieces[i]) <= WIDTHS[-1])
        return out

    _, one, which = np.unique(bytes_hash(data, lo, hi), return_index=True, return_inverse=True)
    for again in (False, True):
        if again:  # two pieces shared a hash
            one = which = np.arange(len(lo))
        each = ids_of([body[a:b] for a, b in zip(lo[one].tolist(), hi[one].tolist(), strict=True)])
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32).astype(np.int64)
        begin = np.cumsum(size) - size
        ids = flat[_ranges(begin[which], size[which])] if len(lo) else np.empty(0, np.int64)
        text, starts = decoded(ids, vocab)
        if np.array_equal(text, data):
            break
    first = np.append(0, np.cumsum(size[which]))[rows] if len(lo) else np.zeros(len(off), np.int64)
    return ids, starts[:-1] - np.repeat(off[:-1], np.diff(first)), first


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and offsets (the byte of the text at which each token starts) of
    each document. ``path``: a rank file that the driver can read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = shared.value, {}
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for lo, hi in slices(texts):
                ids, starts, first = encoded(texts.slice(lo, hi - lo), vocab, cache)
                rows = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(rows, pa.array(x.astype(np.int32))) for x in (ids, starts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *lists], ["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(work, f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode(ids: Column, path: str) -> Column:
    """Bytes that an array of ids stands for; null for null."""
    shared = SparkSession.active().sparkContext.broadcast(vocabulary(path))

    def work(column: pa.Array) -> pa.Array:
        vocab = shared.value
        out = []
        for lo in range(0, len(column), 256):
            part = column.slice(lo, 256)
            n = np.append(0, np.cumsum(part.value_lengths().fill_null(0).to_numpy()))
            body, starts = decoded(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vocab)
            text = body.tobytes()
            cuts = starts[n].tolist()
            out += [text[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], part.is_valid().to_pylist(), strict=False)]
        return pa.array(out, pa.binary())

    work.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(work, "binary")(ids)


def op12_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of all documents by the ranks of many languages, and what they decode to,
    as digests."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(documents_of(spark, sf_dir), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
