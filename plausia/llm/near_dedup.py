"""Near-duplicate groups: minima of many universal hashes, banding, signature and full-set checks, and components.

Documents are linked if 100 * intersection >= 75 * union of their sets of five-word shingles. The steps:

1. One pass over the texts: the size of each set, a 128-bit digest of it, and the minimum of each of 128 universal
   hashes over it. Rows with the same digest are one class, represented by its least doc_id.
2. Banding: 32 bands of 4 minima. A pair at the threshold shares a bucket with all but 5 in a million odds. In each bucket
   every member is paired with the bucket's least member only, so pairs grow with the rows and not with their square.
3. Pairs whose sizes allow a link, and whose signatures agree in at least 56 % of places (five standard deviations
   below the threshold), are confirmed on the full sets, which are computed again for the documents concerned.
4. Components by alternating large-star and small-star over edge tables.
5. What stars can't settle: in a cluster of documents that share buckets but ended in several components, every pair from
   different components is compared on the full sets, in blocks of about 2 * CHUNK documents and CHUNK_SHINGLES shingles, whatever
   the size of the cluster; only links leave a block. Members of the cluster's largest component are never compared with each
   other. A cluster of over LARGE documents is parted before by a second banding, FINE bands of FINE_ROWS minima, which
   documents of little likeness rarely share (a pair at the threshold misses all with odds of two in a million); what a band
   leaves together is dealt to blocks in the same way. Links found there join the components.

Hot groups: exact copies collapse by a partially aggregated minimum; buckets and stars are joined from written tables, so
that Spark can split a skewed key; clusters are dealt out as many small blocks. Nothing is collected but counts.

Defined results: null and empty texts and texts without words have no shingles, no links and are their own component; with
fewer than five words the whole sequence is the one shingle; rows with one doc_id and the same set count as one document, rows with
one doc_id and other sets are judged each by its own; a null doc_id has no component and stays. Columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import Scratch, cached_for, ready, table, turn_to, unused

WORDS, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
#: A link: LINK_OF * intersection >= LINK * union.
LINK, LINK_OF = 75, 100
LEAST_AGREEMENT = 0.56
#: Documents and shingles of a chunk of step 5 (a block holds two chunks), and columns of its incidence matrix at a time.
CHUNK, CHUNK_SHINGLES, SLICE = 64, 1_000_000, 65_536
#: Documents of a cluster beyond which it is banded again, and the second banding: minima that are drawn for each band.
LARGE, FINE, FINE_ROWS = 8_192, 128, 8
MAX_WORDS = 200_000

_SEED = np.random.default_rng(20240607)
_A = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)
_PLACES = _SEED.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE = np.stack([_SEED.choice(HASHES, FINE_ROWS, replace=False) for _ in range(FINE)])


class _WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h
        return h


_WORDS = _WordHashes()
cached_for("near", _WORDS.clear)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []  # bytes: only A-Z change, and only the six blanks part words
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], np.uint64)
    m = n - WORDS + 1
    x = h[:m] * _PLACES[0]
    for k in range(1, WORDS):
        x = (x ^ (x >> np.uint64(31))) * _PLACES[k] + h[k : k + m]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a set."""
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("near")
    for b in batches:
        size, digest, mark = [], [], []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            x = shingles(t)
            size.append(len(x))
            digest.append(xxhash.xxh128_digest(x.tobytes()) if len(x) else None)
            mark.append(signature(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(mark, pa.binary())], ["doc_id", "mark", "n_shingles", "digest", "signature"])


def _keys(batches: Iterator[pa.RecordBatch], rows: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """A row for each document and band: the batch's columns but the signature, and a 64-bit key of the band's number and minima."""
    for b in batches:
        marks = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        keys = [xxhash.xxh64_intdigest(m[r].tobytes(), seed=i) for m in marks for i, r in enumerate(rows)]
        names = [c for c in b.schema.names if c != "signature"]
        at = pa.array(np.repeat(np.arange(len(marks)), len(rows)))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names), pa.array(np.array(keys, np.uint64).view(np.int64))], [*names, name])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keys(batches, np.arange(HASHES).reshape(BANDS, ROWS), "bucket")


def _fine_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keys(batches, _FINE, "cluster")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("near")
    for b in batches:
        x = [shingles(t).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary()), pa.array([xxhash.xxh128_digest(y) for y in x], pa.binary())], ["doc_id", "shingles", "digest"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are linked."""
    if LINK_OF * min(len(a), len(b)) < LINK * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return LINK_OF * common >= LINK * (len(a) + len(b) - common)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((a == z).mean(1) >= LEAST_AGREEMENT))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def block_links(sets: list[np.ndarray], roots: np.ndarray) -> list[tuple[int, int]]:
    """The linked pairs, as positions, among sets whose roots differ."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order, at = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.zeros((n, n), np.float64)
    seen = np.argsort(at, kind="stable")
    at, owner = at[seen], owner[seen]
    for low in range(0, len(order), SLICE):
        i, j = np.searchsorted(at, (low, low + SLICE))
        m = np.zeros((n, min(SLICE, len(order) - low)), np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        common += m @ m.T
    size = np.array([len(x) for x in sets], float)
    link = LINK_OF * common >= LINK * (size[:, None] + size[None, :] - common)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(link, 1) & (roots[:, None] != roots[None, :])), strict=True)]


def _blocks(rows: pa.Table) -> pa.Table:
    ids, roots = rows.column("doc_id").to_numpy(), rows.column("root").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    got = block_links(sets, roots) if len(sets) > 1 else []
    return pa.table({"a": pa.array([min(ids[i], ids[j]) for i, j in got], pa.int64()), "b": pa.array([max(ids[i], ids[j]) for i, j in got], pa.int64())})


def components(scratch: Scratch, edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """node and root, the least node of its component, for every node of the edges (a, b).

    Alternates large-star and small-star until no edge changes. The least neighbour of each node is a partially aggregated
    minimum; it is written before it is joined with the edges, so that a node with very many edges can be split.
    """

    def least(pairs: DataFrame, at: str) -> DataFrame:
        return scratch.save(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), at)

    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    for step in range(1, most + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both, f"{name}-m{step}")
        large = scratch.save(both.join(m, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), f"{name}-l{step}")
        m = least(large, f"{name}-n{step}")
        small = scratch.save(large.join(m, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, small)]
        for old in (f"{name}-m{step}", f"{name}-n{step}", f"{name}-l{step}", f"{name}-{step - 1}"):
            scratch.drop(old)
        now = small
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _opened(members: DataFrame) -> DataFrame:
    """Members (cluster, doc_id, root, n_shingles) of the clusters that hold several roots, with the cluster's n, n_main, main and weight."""
    by_root = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("w"))
    by = by_root.groupBy("cluster").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("w").alias("weight"))
    shares = by.filter("roots > 1").select("cluster", "n", F.col("most.k").alias("n_main"), F.col("most.root").alias("main"), "weight")
    return members.join(shares, "cluster")


def _cross_blocks(members: DataFrame) -> DataFrame:
    """Deals rows of _opened to blocks (cluster, x, y) that cover each pair of different components: chunks of the largest
    component against chunks of the rest, and the rest against itself. A cluster of two chunks' size is one block."""
    is_main = F.col("root") == F.col("main")
    share = F.greatest(F.lit(1.0 / CHUNK), F.col("weight") / F.col("n") / CHUNK_SHINGLES)  # chunks a document
    chunks = lambda n: F.ceil(n * share).cast("int")
    rest_chunks, main_chunks = chunks(F.col("n") - F.col("n_main")), chunks(F.col("n_main"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(is_main, main_chunks).otherwise(rest_chunks)).cast("int")
    rest = F.transform(F.sequence(F.lit(0), rest_chunks - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("x"), F.greatest(i, F.col("own")).alias("y")))
    over = F.transform(F.sequence(F.lit(0), main_chunks - 1), lambda j: F.struct(F.col("own").alias("x"), (-1 - j).alias("y")))
    mains = F.transform(F.sequence(F.lit(0), rest_chunks - 1), lambda i: F.struct(i.alias("x"), (-1 - F.col("own")).alias("y")))
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    blocks = F.when(F.col("n") * share <= 2, whole).when(is_main, mains).otherwise(F.concat(rest, over))
    return members.withColumn("own", own).withColumn("block", F.explode(blocks)).select("cluster", F.col("block.x").alias("x"), F.col("block.y").alias("y"), "doc_id", "root")


def _grouped(spark: SparkSession, docs: DataFrame, large: int = LARGE) -> tuple[DataFrame, Scratch]:
    """doc_id, mark (a hash of the text), n_shingles, digest (of the set) and component for every row of docs."""
    ready(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_signed, "doc_id long, mark long, n_shingles long, digest binary, signature binary")
    signed = scratch.save(signed, "signed")
    known = signed.filter("digest is not null and doc_id is not null")
    # one row for each distinct set; its node is its least doc_id, or a number of its own where that one has several sets
    reps = scratch.save(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "reps")
    twice = scratch.save(reps.groupBy("rep").count().filter("count > 1").select("rep"), "twice")
    several = not twice.isEmpty()
    if several:
        other = F.shiftrightunsigned(F.xxhash64("digest"), 2) + F.lit(-(2**63)).cast("long")
        node = F.when(F.col("several"), other).otherwise(F.col("rep"))
        reps = scratch.save(reps.join(twice.withColumn("several", F.lit(True)), "rep", "left").select("digest", "rep", "n", "signature", node.alias("node")), "nodes")
    else:
        reps = reps.withColumn("node", F.col("rep"))
    marks = reps.select(F.col("node").alias("doc_id"), "n", "signature")

    buckets = scratch.save(marks.select("doc_id", "signature").mapInArrow(_bands, "doc_id long, bucket long"), "buckets")
    centres = scratch.save(buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("bucket", "a"), "centres")
    near = scratch.save(buckets.join(centres, "bucket").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "near")
    scratch.drop("buckets", "centres")

    left, right = (marks.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}")) for k in "ab")
    with_b = scratch.save(near.join(right, "b"), "near-b")
    alike = scratch.save(with_b.join(left, "a").filter(F.expr(f"{LINK_OF} * least(na, nb) >= {LINK} * greatest(na, nb)")).select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long").distinct(), "alike")
    scratch.drop("near-b")

    wanted = scratch.save(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    if several:
        ids = wanted.join(reps.select("node", "rep", "digest"), "node")
        sets = texts.join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_with_sets, "doc_id long, shingles binary, digest binary")
        sets = sets.join(ids.select("digest", "node"), "digest").select(F.col("node").alias("doc_id"), "shingles")
    else:
        sets = texts.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(_with_sets, "doc_id long, shingles binary, digest binary").select("doc_id", "shingles")
    sets = scratch.save(sets.groupBy("doc_id").agg(F.first("shingles").alias("shingles")), "sets")
    with_a = scratch.save(alike.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a"), "alike-a")
    links = scratch.save(with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b").select("a", "b", "xa", "xb").mapInArrow(_confirm, "a long, b long").distinct(), "links")
    scratch.drop("alike", "alike-a", "wanted")

    found = scratch.save(components(scratch, links, "found"), "found")
    cluster = scratch.save(components(scratch, near, "cluster"), "cluster")
    scratch.drop("near")
    members = cluster.select(F.col("root").alias("cluster"), F.col("node").alias("doc_id")).unionByName(cluster.select(F.col("root").alias("cluster"), F.col("root").alias("doc_id")).distinct())
    members = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(marks.select("doc_id", F.col("n").alias("n_shingles")), "doc_id")
    members = scratch.save(members.select("cluster", "doc_id", F.coalesce("root", "doc_id").alias("root"), "n_shingles"), "members")
    opened = scratch.save(_opened(members), "open")
    far = opened.filter(F.col("n") > large)
    if not far.isEmpty():
        again = far.select("doc_id", "root", "n_shingles").join(marks.select("doc_id", "signature"), "doc_id").mapInArrow(_fine_bands, "doc_id long, root long, n_shingles long, cluster long")
        again = scratch.save(again, "again").select(*members.columns)
        opened = opened.filter(F.col("n") <= large).unionByName(scratch.save(_opened(again), "open-again"))
    dealt = _cross_blocks(opened).join(sets, "doc_id")
    late = scratch.save(dealt.groupBy("cluster", "x", "y").applyInArrow(_blocks, "a long, b long").distinct(), "late")
    scratch.drop("sets", "members", "cluster", "open", "open-again", "again")

    if not late.isEmpty():
        found = scratch.save(components(scratch, links.unionByName(late), "joined"), "joined")
    scratch.drop("links", "late")
    component = reps.join(found, "node", "left").select("digest", "rep", F.coalesce("root", "node").alias("root"))
    if several:  # roots may be numbers of sets: the component's least doc_id is sought
        component = component.join(component.groupBy("root").agg(F.min("rep").alias("least")), "root").select("digest", F.col("least").alias("component"))
    else:
        component = component.select("digest", F.col("root").alias("component"))
    component = scratch.save(component, "component")
    scratch.drop("reps", "nodes", "found", "joined")
    rows = signed.select("doc_id", "mark", "n_shingles", "digest").join(component, "digest", "left")
    return rows.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))), scratch


def groups(spark: SparkSession, docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    rows, _ = _grouped(spark, docs, large)
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least doc_id, and all that are in none, with docs' own columns. Of rows with
    one doc_id and one set one stays; rows with one doc_id and other sets stay as their own sets say; rows without a doc_id stay."""
    rows, scratch = _grouped(spark, docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    own_id, own_mark = unused(docs.columns, "id", "mark")
    kept = rows.filter("doc_id = component").groupBy("doc_id", "digest").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("n"))
    kept = scratch.save(kept.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), "n"), "kept")
    keyed = docs.filter("doc_id is not null").withColumns({own_id: F.col("doc_id").cast("long"), own_mark: F.xxhash64(F.col("text").cast("string"))})
    first = keyed.join(kept.select(own_id, own_mark), [own_id, own_mark], "left_semi")
    if not kept.filter("n > 1").isEmpty():  # rows may be there twice
        (row,) = unused(docs.columns, "row")
        first = first.groupBy(own_id, own_mark).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(row)).select(f"{row}.*")
    return first.select(*own).unionByName(docs.filter("doc_id is null").select(*own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {LINK_OF} * c >= {LINK} * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
