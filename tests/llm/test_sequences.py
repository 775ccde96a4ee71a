"""Periodic runs, byte-level BPE and hard negatives against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import byte_bpe, hard_negatives, periodic_runs, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def stored(spark, tmp_path, name, df):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# periodic runs


def brute_runs(w):
    """Every lag, word by word; smallest periods by trying their divisors."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            smaller = any(q % d == 0 and all(w[t] == w[t + d] for t in range(s, s + length - d)) for d in range(1, q))
            if i > s and length >= max(6, 4 * q) and not smaller:
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def changed(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected_runs(text, doc_id):
    w = changed(words(text), doc_id) if doc_id is not None else words(text)
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repetitive(rng):
    letters = "abcde"[: rng.choice([1, 2, 3, 5])]
    w = [rng.choice(letters) for _ in range(rng.randrange(90))]
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(w) + 1)
        w[at:at] = [rng.choice(letters) for _ in range(rng.randrange(1, 20))] * rng.randrange(2, 7)
    return rng.choice([" ", "  ", "\n", " \t"]).join(w)


def runs_query(spark, tmp_path, docs):
    got = registry.QUERIES["op11_periodic_runs"](spark, stored(spark, tmp_path, "documents", docs))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [repetitive(rng) for _ in range(600)]
    assert runs_query(spark, tmp_path, docs_of(spark, texts)) == sorted((expected_runs(t, i) for i, t in enumerate(texts)), key=str)


def test_runs_of_edge_cases(spark, tmp_path):
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x" * 50_000, "a b " * 2_000, "a b " * 2_000, "é " * 9, "ab c d" * 3]
    ids = [1, 2, 3, None, 5, 5, 7, 8, 8, None, -3]
    got = runs_query(spark, tmp_path, docs_of(spark, texts, ids))
    quick = [(t, i) for t, i in zip(texts, ids) if len(t or "") < 100]
    want = [expected_runs(t, i) for t, i in quick]
    assert sorted((r for r in got if r[0] not in (7, 8)), key=str) == sorted(want, key=str)
    assert sorted(r[1:6] for r in got if r[0] == 8) == [(1, 0, 4000, 2, 2_000_000)] * 2


def test_runs_of_an_empty_table_and_extra_columns(spark, tmp_path):
    assert periodic_runs.periodic_runs(docs_of(spark, [])).count() == 0
    extra = docs_of(spark, ["a b a b a b a b"]).withColumn("runs", F.lit(1)).withColumn("g", F.lit("x")).withColumn("collapsed", F.lit(2))
    (row,) = periodic_runs.periodic_runs(extra).collect()
    assert row["n_words"] == 8 and [tuple(r) for r in row["runs"]] == [(0, 8, 2)] and row["collapsed"] == "a b"


def test_a_recurring_phrase_seeds_a_pair_an_occurrence():
    n = 4000
    h = np.arange(n, dtype=np.uint64) * np.uint64(2654435761)
    h[: n // 2] = np.tile(h[:8], n // 16)  # one phrase 250 times
    doc = np.zeros(n, np.int64)
    pairs = sum(len(at) for _, at, _ in periodic_runs.seeds(h, doc, np.full(n, n)))
    assert 0 < pairs <= n


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    vocab = byte_bpe.vocabulary(path)
    return path, vocab, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


SYMBOLS = "abstmdrevlRS'' \n\t 12½٣é中Ω!?.  　\U0001f600\U00010400ǅİ"


def token_texts():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(SYMBOLS) for _ in range(rng.randrange(60))) for _ in range(3000)]
    long = ["x" * 5000, "ab" * 3000, " " * 4000, "'" * 3000, "\n" * 1000 + "a", "中文" * 2000, "it's we'll they've I'm you're he'd 'tis 'S", "<|endoftext|>", "a" * 70 + "b" * 70]
    points = "".join(chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000)
    return [*mixed, *long, points, ""]


def test_tokens_equal_the_library(tokenizer):
    _, vocab, library = tokenizer
    texts = token_texts()
    column, cache, done = pa.array(texts), {}, 0
    for lo, hi in byte_bpe.slices(column):
        ids, starts, first = byte_bpe.encoded(column.slice(lo, hi - lo), vocab, cache)
        for text, a, b in zip(texts[lo:hi], first, first[1:]):
            want = library.encode_ordinary(text)
            assert ids[a:b].tolist() == want
            sizes = [len(library.decode_single_token_bytes(i)) for i in want]
            assert starts[a:b].tolist() == (np.cumsum(sizes) - sizes).astype(int).tolist()
            done += 1
    assert done == len(texts)


def test_side_by_side_merging_equals_the_heap(tokenizer):
    _, vocab, _ = tokenizer
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aaabcdest \xc3\xa9\xe4") for _ in range(rng.randrange(1, 66))) for _ in range(3000)]
    got = [np.frombuffer(x, np.int32).tolist() for x in byte_bpe.merged_all(pieces, vocab)]
    assert got == [byte_bpe.merged(p, vocab.ranks) for p in pieces]


def test_scan_in_rows_equals_one_step_after_the_other():
    rng = np.random.default_rng(1)
    classes = rng.choice(byte_bpe.N_CLASSES, 5000, p=[0.1, 0.1, 0.15, 0.1, 0.1, 0.15, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
    classes[1000:2500] = byte_bpe.SPACE  # longer than two rows
    classes[-1] = byte_bpe.END
    to, starts = byte_bpe.automaton()
    padded = [*classes.tolist(), byte_bpe.END, byte_bpe.END]
    state, want = byte_bpe.AT_END, []
    for i in range(len(classes)):
        symbol = (padded[i] * byte_bpe.N_CLASSES + padded[i + 1]) * byte_bpe.N_CLASSES + padded[i + 2]
        want += [i] if starts[symbol, state] else []
        state = to[symbol, state]
    assert byte_bpe.piece_starts(classes).tolist() == want


def test_tokens_of_the_query(spark, tmp_path, tokenizer):
    _, _, library = tokenizer
    texts = [None, "", *token_texts()[:200], "one text", "one text"]
    ids = [None, 4, *range(10, 210), 7, 7]
    sf = stored(spark, tmp_path, "documents", docs_of(spark, texts, ids).withColumn("ids", F.lit(1)).withColumn("offsets", F.lit("x")))
    got = registry.QUERIES["op12_byte_bpe"](spark, sf).collect()
    want = []
    for i, t in zip(ids, texts):
        tokens = library.encode_ordinary(t or "")
        want.append((i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_spans_of_tokens_decode_to_their_place(spark, tokenizer):
    path, _, _ = tokenizer
    text = "naïve 中文 text's  end\n"
    row = byte_bpe.encode(docs_of(spark, [text]), path).withColumn("part", byte_bpe.decode(F.slice("ids", 3, 4), path)).first()
    a = row["offsets"][2]
    assert text.encode()[a : a + len(row["part"])] == bytes(row["part"]) and len(row["ids"]) == len(row["offsets"])
    assert byte_bpe.encode(docs_of(spark, []), path).count() == 0


# hard negatives


def brute_negatives(rows):
    """rows: (vec_id, vector, label)."""
    good = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(256 * float(x))) for x in v], int(np.fmod(label + 1, 10)) if i % 7 == 0 else label))
    out = []
    for at, (i, a, label) in enumerate(good):
        if i % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), j, other) for k, (j, b, other) in enumerate(good) if k != at and len(b) == len(a)]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[:5]:
            fit = sorted(x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def near_rows(n=400, labels=4, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(6)] + 0.1 * rng.normal(size=dim)], int(rng.integers(labels))) for i in rng.permutation(n)]


@pytest.mark.parametrize("blocks", [(512, 4096), (2, 30)])
def test_negatives_equal_brute_force(spark, blocks):
    rows = near_rows()
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(vectors_of(spark, rows).withColumn("label", moved), F.col("vec_id") % 50 == 0, anchors_a_block=blocks[0], candidates_a_block=blocks[1])
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_negatives_of_edge_cases(spark, tmp_path):
    rows = near_rows(120, 3, 4) + [
        (None, [1.0] * 4, 1), (50, None, 1), (100, [1.0] * 4, None), (150, [1.0, None, 1.0, 1.0], 1), (200, [float("nan")] * 4, 2), (250, [float("inf")] * 4, 2), (300, [], 0),
        (350, [1.0, 2.0], 1), (351, [1.0, 2.0], 1), (352, [1.0, 1.0], 2), (400, [1.0, 1.0, 1.0], 1), (450, [0.0] * 4, 1), (0, [0.5] * 4, 1), (50, [0.5] * 4, 1),
    ]
    sf = stored(spark, tmp_path, "embeddings", vectors_of(spark, rows).withColumn("row", F.lit("x")).withColumn("score", F.lit(1)))
    got = registry.QUERIES["op13_anchor_tree_negatives"](spark, sf)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(vectors_of(spark, []), F.lit(True)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**30, 3.0], 1), (1, [2.0**30, 5.0], 1), (2, [2.0**29 + 64, 1.0], 2), (3, [2.0**29 + 64, 2.0], 2)]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") == 0, scale=1, n_positives=1)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 3, 2**60 + 15, 2**59 + 2**36 + 6), (0, 1, 2, 2, 2**60 + 15, 2**59 + 2**36 + 3)]


def test_bounds_leave_most_candidates_of_near_anchors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    anchors = np.floor(x[0] + rng.normal(size=(40, 16)) * 2)
    scores = hard_negatives._Scores(anchors, x)
    for a in scores.order.tolist():
        lo, hi = scores.bound(a)
        true = x @ anchors[a]
        assert ((lo <= true) & (true <= hi)).all()
        own = np.flatnonzero((hi >= hard_negatives._kth(lo, 5)) | ~np.isfinite(lo))
        assert set(np.argsort(-true)[:5]) <= set(own)
        scores.score(a, own, lo, hi)
    assert scores.rescored < 0.2 * 40 * 2000
