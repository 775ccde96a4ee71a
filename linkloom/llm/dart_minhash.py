"""MinHash near-dedup with DartMinHash (Christiani, 2020).

A document is the set of its shingles of five words, each of weight 1 however
often it occurs, so that sketches estimate the plain Jaccard similarity that
makes a link. For every element, darts are thrown at the
plane of weight and rank: the plane is cut into areas (2**v wide in weight,
rank halving as weight doubles) that each hold a Poisson number of darts, all
drawn from hashes of element and area. A dart below the element's weight hits
the document. Each dart has a coordinate among ``k``; per coordinate the dart
of least rank is kept, so that two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Darts of rank above a first
bound are thrown only if coordinates are left empty. Every element costs a few
darts, not ``k`` hashes.

Bands of ``rows`` coordinates are joined; candidate links are verified on the
whole texts by the Jaccard similarity of their sets of shingles.

Documents of equal text are one node, by a hash of 128 bits, numbered once in a
written table, and are compared once. The nodes of a band's bucket are compared with the bucket's least node;
where verified links do not connect a bucket, its other parts are compared with
its largest part through one node each. What is still apart is compared whole:
small buckets pair by pair, large ones in clusters of buckets that share nodes,
dealt into blocks of which two meet in a task, which returns connecting links
and no pairs. So no candidate link between different texts is lost, and a large
group of near copies costs about one row a node.

Defined cases: a text of one to four words is one shingle; null and empty texts
have no shingle, link with nothing and are each their own class. Repeated rows
are separate rows of one class; of rows equal in id and text ``keep_first`` keeps
the least by all columns. Extra columns are ignored by ``near_classes`` and kept
by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import components, cut, discard, documents_of
from linkloom.llm.words import Words, mix, rolled, slices, spans_hash, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 22, 5
#: The first layer of ranks is [0, 2**FIRST).
FIRST = -3
#: An id that orders and joins like any other: null ids come after all others.
ID = "struct<none:boolean,id:bigint>"


def shingles(w: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of a slice; a shorter text is one shingle."""
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < width))
    lone = spans_hash(w.hash, w.first[short], w.first[short + 1], 3)
    if len(w.hash) < width:
        return lone, short
    inside = w.doc[: len(w.hash) - width + 1] == w.doc[width - 1 :]
    return np.concatenate([rolled(w.hash, width)[inside], lone]), np.concatenate([w.doc[: len(inside)][inside], short])


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) with their counts, by doc."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


@cache
def _chances(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts in an area of that mean."""
    return np.cumsum([exp(-mean) * mean**i / factorial(i) for i in range(16)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k array of dart identities; rows without elements are zero.

    Ranks are cut into layers: the first below 2**FIRST, each next one up to
    twice the last. A document throws as many layers as k (ln k + 3) darts take,
    and further ones while it has an empty coordinate. As layers rise, a dart
    only ever fills a coordinate that lower layers left empty."""
    out = np.zeros((n_docs, k), np.uint64)
    full = np.zeros((n_docs, k), bool)
    total = np.bincount(doc, weight, n_docs)
    some = total > 0
    stop = np.where(some, np.ceil(np.log2(k * (np.log(k) + 3.0) / np.where(some, total, 1.0))), FIRST - 1).astype(int)
    layer = FIRST
    while some.any():
        live = some & ((stop >= layer) | ((layer > FIRST) & ~full.all(axis=1)) | (layer == FIRST))
        if not live.any():
            break
        pick = np.flatnonzero(live[doc])
        low, high = (0.0, 2.0**FIRST) if layer == FIRST else (2.0 ** (layer - 1), 2.0**layer)
        darts = _throw(h[pick], weight[pick], layer, low, high)
        flat = doc[pick[darts[0]]] * k + (mix(darts[1], 41) % np.uint64(k)).astype(np.int64)
        free = ~full.ravel()[flat]
        flat, one, rank = flat[free], darts[1][free], darts[2][free]
        order = np.argsort(-rank, kind="stable")  # of repeated places, the last written stays
        out.ravel()[flat[order]] = one[order]
        full.ravel()[flat] = True
        layer += 1
    return out


def _throw(h: np.ndarray, weight: np.ndarray, layer: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of one layer of ranks below each element's weight: element,
    identity, rank. Weight is cut at 1, 2, 4, ...; areas have a mean of at most
    one dart."""
    found = []
    step, rest = 0, np.arange(len(h))
    while len(rest):
        left, right = (0.0, 1.0) if step == 0 else (2.0 ** (step - 1), 2.0**step)
        mean = (right - left) * (high - low)
        parts = max(1, int(np.ceil(mean)))
        area = np.repeat(rest, parts)
        part = np.tile(np.arange(parts, dtype=np.uint64), len(rest))
        seed = mix(h[area] ^ (part + np.uint64((layer + 4096) * 1_000_003 + step * 50_021)) * np.uint64(0xD6E8FEB86659FD93), 11)
        n = np.searchsorted(_chances(mean / parts), _uniform(seed))
        of = np.repeat(np.arange(len(area)), n)
        number = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        one = mix(seed[of] + number * np.uint64(0xA24BAED4963EE407), 20)
        hit = left + (right - left) * _uniform(one) < weight[area[of]]
        of, one = of[hit], one[hit]
        found.append((area[of], one, low + (high - low) * (part[of] + _uniform(mix(one, 40))) / parts))
        step += 1
        rest = rest[weight[rest] > right]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0))


def _identified(docs: DataFrame) -> DataFrame:
    """id (never null), hash (128 bits of the exact text), text."""
    both = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    own = F.col("doc_id").cast("long")
    return docs.select(F.struct(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id")).alias("id"), both.alias("hash"), "text")


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """id, hash, keys (one a band; null without words) of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b["text"]):
                w = words_of(b["text"].slice(i, j - i))
                h, doc, _ = counted(*shingles(w, width))
                sig = signatures(h, doc, np.ones(len(h)), j - i, bands * rows).reshape(j - i, bands, rows)
                keys = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ sig[:, :, r], 50 + r)
                keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :], 60)
                none = np.diff(w.first) == 0
                lists = pa.array([None if e else k for e, k in zip(none, keys.view(np.int64), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i), b["hash"].slice(i, j - i), lists], ["id", "hash", "keys"])

    return _identified(docs).mapInArrow(sketch, f"id {ID}, hash struct<a:bigint,b:bigint>, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """The pairs (src, dst) whose sets of shingles have a Jaccard similarity of
    ``threshold`` or more. ``texts``: (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("node").alias("dst"), F.col("text").alias("b")), "dst")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                sets = []
                for c in ("a", "b"):
                    h, doc = shingles(words_of(part[c]), width)
                    h, doc, _ = counted(h, doc)
                    sets.append((h, np.searchsorted(doc, np.arange(len(part) + 1))))
                (ha, fa), (hb, fb) = sets
                for d in range(len(part)):
                    x, y = ha[fa[d] : fa[d + 1]], hb[fb[d] : fb[d + 1]]
                    if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                        same = len(np.intersect1d(x, y, assume_unique=True))
                        keep[i + d] = same >= threshold * (len(x) + len(y) - same) - 1e-9
            yield b.filter(pa.array(keep)).select(["src", "dst"])

    return both.select("src", "dst", "a", "b").mapInArrow(compare, "src long, dst long")


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, part: the component of each node, itself where it has no link."""
    return nodes.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("part"))


def linked_in_block(a: pa.Table, b: pa.Table, threshold: float = THRESHOLD, width: int = SHINGLE) -> np.ndarray:
    """Boolean matrix of the pairs of rows (node, part, text) of different parts
    that are similar. Shared shingles are counted by matrix products over slices
    of the vocabulary, so memory is bounded by rows times slice."""
    sets = []
    for t in (a, b):
        h, doc, _ = counted(*shingles(words_of(t["text"].combine_chunks()), width))
        sets.append((h, doc, np.bincount(doc, minlength=len(t))))
    (ha, da, na), (hb, db, nb) = sets
    both = np.intersect1d(ha, hb)
    shared = np.zeros((len(a), len(b)), np.float64)
    for i in range(0, len(both), 20_000):
        names = both[i : i + 20_000]
        m = []
        for h, doc, n in sets:
            at = np.searchsorted(names, h)
            hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == h)
            dense = np.zeros((len(n), len(names)), np.float32)
            dense[doc[hit], at[hit]] = 1
            m.append(dense)
        shared += m[0] @ m[1].T
    apart = a["part"].to_numpy()[:, None] != b["part"].to_numpy()[None, :]
    return apart & (shared >= threshold * (na[:, None] + nb[None, :] - shared) - 1e-9) & (shared > 0)


def block_links(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, block: int = 200) -> DataFrame:
    """Links (src, dst) that connect what is similar within a cluster. ``nodes``:
    (cluster, node, part, asks), where ``asks`` marks the nodes that are compared
    with all nodes of other parts. A cluster is dealt into blocks, blocks of
    askers meet blocks of nodes in one task each, and a task returns one link a
    node at most: to the least node of its connected part of the two blocks."""
    size = cut(nodes.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("mb"), F.ceil(F.count_if("asks") / block).cast("int").alias("qb")), "cluster_sizes")
    own = F.xxhash64(F.lit(7), F.col("node"))
    dealt = nodes.join(size, "cluster").join(texts, "node")
    member = dealt.select("cluster", "node", "part", "text", F.lit(False).alias("q"), F.pmod(own, F.col("mb")).cast("int").alias("mi"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qi"))
    asker = dealt.where("asks").select("cluster", "node", "part", "text", F.lit(True).alias("q"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mi"), F.pmod(own, F.col("qb")).cast("int").alias("qi"))

    def compare(t: pa.Table) -> pa.Table:
        q, m = t.filter(t["q"]), t.filter(pc.invert(t["q"]))
        out = {"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64)}
        if len(q) and len(m):
            links = linked_in_block(q, m, threshold, width)
            qn, mn = q["node"].to_numpy(), m["node"].to_numpy()
            top = np.iinfo(np.int64).max
            root, back = qn.copy(), mn.copy()
            while True:
                new = np.minimum(root, np.where(links, back[None, :], top).min(axis=1))
                new_back = np.minimum(back, np.where(links, new[:, None], top).min(axis=0))
                if (new == root).all() and (new_back == back).all():
                    break
                root, back = new, new_back
            out = {"src": np.concatenate([qn, mn]), "dst": np.concatenate([root, back])}
        return pa.table(out, schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return member.union(asker.select(member.columns)).groupBy("cluster", "mi", "qi").applyInArrow(compare, "src long, dst long").where("src <> dst")


def _part_sizes(parted: DataFrame, group: str) -> DataFrame:
    """group, part, n, rep: the nodes of each part of a group, and one of them."""
    return parted.groupBy(group, "part").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64(F.lit(1), F.col("node"))).alias("rep"))


def _main_parts(sizes: DataFrame, group: str) -> DataFrame:
    """group, main, to, size: the largest part of each group with its node, and
    the nodes of the whole group."""
    best = sizes.groupBy(group).agg(F.max(F.struct("n", "part", "rep")).alias("b"), F.sum("n").alias("size"))
    return best.select(group, F.col("b.part").alias("main"), F.col("b.rep").alias("to"), "size")


def linked_nodes(buckets: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, small: int = 32) -> DataFrame:
    """node, part of the nodes that share a bucket (key, node) with another."""
    lead = cut(buckets.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead"), "leads")
    held = cut(buckets.join(lead, "key"), "buckets")
    discard(lead)
    nodes = cut(held.select("node").distinct(), "nodes")
    near = cut(texts.join(nodes, "node").dropDuplicates(["node"]), "texts")
    # every node with the least node of each of its buckets
    asked = cut(held.where("node <> lead").select(F.col("lead").alias("src"), F.col("node").alias("dst")).distinct(), "asked")
    links = cut(similar(asked, near, threshold, width), "linked")

    def unsettled() -> tuple[DataFrame, DataFrame]:
        """Parts so far, and the rows of buckets that hold more than one."""
        part = cut(_parts(nodes, links), "parts")
        now = held.select("key", "node").join(part, "node")
        split = cut(now.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key"), "split")
        rows = cut(now.join(split, "key"), "open")
        discard(split)
        return part, rows

    # every other part of a bucket with its largest part, through one node of each
    part, rows = unsettled()
    if rows.isEmpty():
        return part
    sizes = cut(_part_sizes(rows, "key"), "sizes")
    main = cut(_main_parts(sizes, "key"), "main")
    pairs = sizes.join(main, "key").where("part <> main").select(F.least("rep", "to").alias("src"), F.greatest("rep", "to").alias("dst")).distinct()
    fresh = cut(pairs.join(asked, ["src", "dst"], "left_anti"), "fresh")
    asked, links = asked.union(fresh), links.union(cut(similar(fresh, near, threshold, width), "found"))
    # what is still apart, whole: small buckets pair by pair, large ones in blocks
    discard(part, rows, sizes, main)
    part, rows = unsettled()
    if rows.isEmpty():
        return part
    main = cut(_main_parts(_part_sizes(rows, "key"), "key").select("key", "main", "size"), "mains")
    rows = cut(rows.join(main, "key"), "rows")
    few = rows.where(F.col("size") <= small)
    pairs = few.where("part <> main").select("key", F.col("node").alias("x"), F.col("part").alias("of_x")).join(few, "key").where("of_x <> part").select(F.least("x", "node").alias("src"), F.greatest("x", "node").alias("dst")).distinct()
    fresh = cut(pairs.join(asked, ["src", "dst"], "left_anti"), "fresh")
    links = links.union(cut(similar(fresh, near, threshold, width), "found"))
    many = rows.where(F.col("size") > small)
    if not many.isEmpty():
        hub = cut(many.groupBy("key").agg(F.min("node").alias("hub")), "hubs")
        cluster = cut(components(many.join(hub, "key").select(F.col("node").alias("src"), F.col("hub").alias("dst"))).join(part, "node").select(F.col("component").alias("cluster"), "node", "part"), "clusters")
        largest = cut(_main_parts(_part_sizes(cluster, "cluster"), "cluster").select("cluster", "main"), "largest")
        links = links.union(cut(block_links(cluster.join(largest, "cluster").select("cluster", "node", "part", (F.col("part") != F.col("main")).alias("asks")), near, threshold, width), "blocks"))
    return _parts(nodes, links)


def near_classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, width: int = SHINGLE, small: int = 32) -> DataFrame:
    """doc_id, copy_of (least id of its exact copies) and class_id (least id of
    its near-duplicate class) of every row of (doc_id, text)."""
    sketch = cut(sketches(docs, bands, rows, width), "sketches")
    worded = sketch.where("keys is not null")
    kinds = worded.groupBy("hash").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    classes = cut(kinds.select(F.monotonically_increasing_id().alias("node"), "hash", "rep", "keys"), "classes")
    first = classes.select("node", "hash", "rep")
    texts = _identified(docs).withColumnRenamed("id", "rep").join(first, ["hash", "rep"]).select("node", "text")
    linked = linked_nodes(classes.select("node", F.explode("keys").alias("key")), texts, threshold, width, small)
    part = cut(first.join(linked, "node", "left").select("hash", "rep", F.coalesce("part", "node").alias("part")), "part")
    least = cut(part.groupBy("part").agg(F.min("rep").alias("class_id")), "least")
    named = cut(part.join(least, "part").select("hash", F.col("rep").alias("copy_of"), "class_id"), "named")
    discard(classes, part, least)
    found = worded.select("id", "hash").join(named, "hash").select("id", "copy_of", "class_id")
    alone = sketch.where("keys is null").select("id", F.col("id").alias("copy_of"), F.col("id").alias("class_id"))
    return found.union(alone).select(*[F.when(~F.col(c)["none"], F.col(c)["id"]).alias(n) for c, n in (("id", "doc_id"), ("copy_of", "copy_of"), ("class_id", "class_id"))])


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, with all columns: of each near-duplicate class only the
    document of least id, and of rows equal in id and text only one, the least by
    all columns. Rows without words, and those with a null id, stay."""
    classes = cut(near_classes(docs, **options), "near")
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    if not classes.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), row.alias("_row"))
        one = named.groupBy("_id", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
        docs = docs.where(F.col("doc_id").isNull()).union(one)
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents_of(spark, sf_dir)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
t AS (SELECT text, min(doc_id) rep, any_value(w) w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT DISTINCT rep, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END s
  FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM t)),
z AS (SELECT rep, count(*) n FROM s GROUP BY rep),
p AS (SELECT a.rep a, b.rep b, count(*) k FROM s a JOIN s b ON a.s = b.s AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
r(rep, reach) AS (SELECT rep, rep FROM t UNION SELECT r.rep, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT rep, min(reach) class_id FROM r GROUP BY rep)
SELECT d.doc_id AS doc_id, coalesce(t.rep, d.doc_id) AS copy_of, coalesce(class_id, d.doc_id) AS class_id, d.doc_id = coalesce(class_id, d.doc_id) AS kept
FROM d LEFT JOIN t ON d.text = t.text LEFT JOIN c ON c.rep = t.rep"""
