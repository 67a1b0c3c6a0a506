"""Substring dedup: words covered by a window of 20 words that also starts earlier are removed.

Windows are counted exactly by super-k-mer partitioning. Within a text, consecutive windows share their minimiser, the
least hash among the short runs of words inside a window; such a stretch travels as one packed string, with the place of
its first window, to the bucket of that minimiser, so each word is sent about three times and not twenty times. A map
task packs the stretches of a block of texts that go to one bucket into one compressed row. In the bucket all windows
are sorted by hash and compared byte for byte; every occurrence but the earliest is reported, as spans of words. The
spans come back to the texts by doc_id.

Hashes are differences of one running polynomial sum over the bytes, so the hash of every run of words costs a few array
operations and no word is handled on its own. Nothing rests on hashes alone: equal hashes are compared as strings.

Hot groups: before anything is sent, a map task works out which windows of a block of texts already occurred in the same
block, reports those at once, and cuts the stretches down to windows that are new in the block. So a passage that a third
of all texts share reaches its bucket once for each block, and not once for each text. Windows that reach over such a
passage's edge differ from text to text; so that they don't all follow a short run of the passage to one bucket, short runs
that are frequent in the whole corpus come last in the order of minimisers. They are counted in a pass of its own; there
are at most MAX_FREQUENT of them, which bounds what is sent to the tasks. Where a window has frequent runs only, its bucket is
dealt over SALTS parts by the block's ids; each part is cut down to its own new windows, and only these meet in
a second round. Other buckets are worked through in one round. In either, a bucket that holds many rows is folded as its
rows come in: what is held is its distinct windows and one share of rows, not all rows. The number of buckets follows the bytes of the
texts; a task works through many buckets, one after the other, and there are at most MOST_TASKS tasks.

Order: a document is told by its doc_id and a 64-bit hash of its text. A window starts earlier if its doc_id is smaller (null is
the smallest), or the doc_id is the same and the hash of the text is, or both are the same and its place is smaller. So rows with
one doc_id, or without one, are documents of their own as far as their texts differ; rows that are alike in both lose the
same words, and neither is earlier than the other.

Defined results: null and empty texts have no words, nothing is removed, and the digest is that of the empty string. Columns of the
input may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plausia.llm.common import NULL_ID, Scratch, ready, table, turn_to, unused

WINDOW = 20
#: Words of a minimiser.
SHORT = 4
#: Bytes of a block of texts, of what a bucket should hold, and of the strings hashed at a time.
BLOCK_BYTES, BUCKET_BYTES, SLICE_BYTES = 4_000_000, 4_000_000, 1_000_000
#: A short run is frequent from so many occurrences on, and there are at most so many frequent ones (8 bytes each): beyond it the
#: limit rises with the corpus. Occurrences are counted from BLOCK_LEAST in a block on.
FREQUENT, MAX_FREQUENT, BLOCK_LEAST = 20_000, 4_000_000, 4
#: Parts of a bucket of frequent runs. Bytes of strings that are sent to a task, as aimed at, and tasks at most. Bytes of a bucket's
#: strings that are gathered before they are folded.
SALTS, TASK_BYTES, MOST_TASKS, FOLD_BYTES = 64, 64_000_000, 50_000, 24_000_000

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            out = np.full(max(n, SLICE_BYTES + 65_536), base, np.uint64)
            out[0] = 1
            _POWERS[i] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Strings:
    """Strings of words joined by one space, laid end to end, each followed by one byte that is no letter of a word."""

    def __init__(self, whole: bytes, lengths: np.ndarray):
        """lengths: bytes of each string, its closing byte included."""
        raw = np.frombuffer(whole, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))  # ends of words
        self.whole = whole
        self.end = gaps
        self.start = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else gaps
        last = np.cumsum(lengths) - 1  # the closing byte of each string
        self.words = np.diff(np.concatenate([[0], np.searchsorted(gaps, last) + 1]))
        self.first = np.cumsum(self.words) - self.words

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For every run of so many words within a string: the string's number and the run's first word."""
        many = np.maximum(self.words - size + 1, 0)
        owner = np.repeat(np.arange(len(many)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.first[owner]
        return owner, at

    def hashes(self, *sizes: int) -> list[np.ndarray]:
        """For each size the hash of the run of so many words that begins at each word (of any use only within a string)."""
        raw = np.frombuffer(self.whole, np.uint8)
        out = [np.zeros(len(self.start), np.uint64) for _ in sizes]
        low = 0
        while low < len(self.start):  # slices of words; the runs of a slice reach over its end
            base = int(self.start[low])
            high = max(low + 1, int(np.searchsorted(self.start, base + SLICE_BYTES)))
            reach = min(high + max(sizes), len(self.start)) - 1
            n = int(self.end[reach]) - base
            up, back = _powers(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(raw[base : base + n] * up[:n], out=sums[1:])
            begin = self.start[low:high] - base
            for h, size in zip(out, sizes, strict=True):
                stop = self.end[np.minimum(np.arange(low, high) + size - 1, reach)] - base
                h[low:high] = _mixed((sums[stop] - sums[begin]) * back[begin])
            low = high
        return out

    def text(self, first: int, last: int) -> bytes:
        """The words from first to last."""
        return self.whole[self.start[first] : self.end[last]]


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive entries, as far as there are any."""
    out, size = x, 1
    while 2 * size <= k:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = k - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _earliest(strings: _Strings, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For windows in order of occurrence the position (in at) of the earliest equal one; its own for the first.

    Windows that follow one another, and repeat windows that follow one another, are compared as one string.
    """
    n = len(at)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(n, np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if n else order
    again = np.flatnonzero(out != np.arange(n))
    if not len(again):
        return out
    cut = np.ones(len(again), bool)
    cut[1:] = (at[again[1:]] != at[again[:-1]] + 1) | (at[out[again[1:]]] != at[out[again[:-1]]] + 1)
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(again)) - 1
    same = all(
        strings.text(a, b + WINDOW - 1) == strings.text(c, d + WINDOW - 1)
        for a, b, c, d in zip(at[again[begin]].tolist(), at[again[stop]].tolist(), at[out[again[begin]]].tolist(), at[out[again[stop]]].tolist(), strict=True)
    )
    if not same:  # two different windows with one hash: settle the groups concerned string by string
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(hashes, hashes[again])).tolist():
            out[i] = seen.setdefault(strings.text(int(at[i]), int(at[i]) + WINDOW - 1), i)
    return out


#: A document: its doc_id, and the hash of its text.
DOC = np.dtype([("id", np.int64), ("mark", np.int64)])


def _spans(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans (document, first word, end) of windows given in order of doc and pos."""
    if not len(doc):
        return doc, pos, pos
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + WINDOW)
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(doc)) - 1
    return doc[start], pos[start], pos[end] + WINDOW


#: A row is one bucket's share of a block: documents and places of its stretches and their strings, compressed; salt is a part
#: of a bucket of frequent runs, else null. Or, with no bucket, spans that are known to repeat.
SENT = "bucket long, salt int, docs binary, places binary, packed binary"
_SENT = pa.schema([("bucket", pa.int64()), ("salt", pa.int32()), ("docs", pa.binary()), ("places", pa.binary()), ("packed", pa.binary())])
Row = tuple[int | None, int | None, bytes, bytes, bytes]


def _row(bucket: int | None, salt: int | None, docs: np.ndarray, places: np.ndarray, packed: bytes) -> Row:
    return bucket, salt, docs.tobytes(), places.astype(np.int32).tobytes(), packed


def _span_row(docs: np.ndarray, pos: np.ndarray, end: np.ndarray) -> Row:
    return _row(None, None, docs, pos, end.astype(np.int32).tobytes())


def _rows(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else ((),) * 5, _SENT, strict=True)], schema=_SENT)


def _packed(strings: _Strings, first: np.ndarray, last: np.ndarray) -> bytes:
    """Stretches from word to word, compressed together."""
    whole = strings.whole
    joined = b"\n".join([whole[x:y] for x, y in zip(strings.start[first].tolist(), strings.end[last].tolist(), strict=True)])
    return zstandard.ZstdCompressor(level=3).compress(joined)


def _ordered(short: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes of short runs as they are ordered for minimisers: the frequent ones after all others."""
    if not len(frequent):
        return short
    at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
    return (short >> np.uint64(1)) | ((frequent[at] == short).astype(np.uint64) << np.uint64(63))


def _stretches(at: np.ndarray, owner: np.ndarray, fresh: np.ndarray, parted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of each run of fresh windows that follow one another in one string (and agree in parted)."""
    cut = np.ones(len(fresh), bool)
    cut[1:] = (at[fresh[1:]] != at[fresh[:-1]] + 1) | (owner[fresh[1:]] != owner[fresh[:-1]])
    if parted is not None:
        cut[1:] |= parted[1:] != parted[:-1]
    begin = np.flatnonzero(cut)
    return begin, np.append(begin[1:], len(fresh)) - 1


def _send_block(ids: list[int], marks: list[int], texts: list[bytes], buckets: int, frequent: np.ndarray) -> list[Row]:
    """What a block of texts sends: its new stretches by bucket, and spans already known to repeat."""
    known = np.array([*zip(ids, marks, strict=True)], DOC)
    known, order = np.unique(known, return_index=True)  # rows that are alike in both are one document
    joined = [b" ".join(texts[i].split()) for i in order.tolist()]
    kept = [k for k, j in enumerate(joined) if j]
    if not kept:
        return []
    joined, known = [joined[k] for k in kept], known[kept]
    strings = _Strings(b"\n".join(joined) + b"\n", np.array([len(j) + 1 for j in joined]))
    owner, at = strings.runs(WINDOW)
    if not len(at):
        return []
    short, long = strings.hashes(SHORT, WINDOW)
    first = _earliest(strings, at, long[at])
    place = at - strings.first[owner]
    again = first != np.arange(len(at))
    which = np.flatnonzero(again)
    rows = [_span_row(*_spans(known[owner[which]], place[which]))] if len(which) else []
    fresh = np.flatnonzero(~again)
    least = _least(_ordered(short, frequent), WINDOW - SHORT + 1)[at[fresh]]
    begin, stop = _stretches(at, owner, fresh, least)
    hot = (least[begin] >> np.uint64(63)).astype(bool) if len(frequent) else np.zeros(len(begin), bool)
    bucket = (_mixed(least[begin]) % np.uint64(buckets)).astype(np.int64) + np.where(hot, buckets, 0)
    a, z = fresh[begin], fresh[stop]
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0, [True]])).tolist() if len(by) else []
    salt = int(_mixed(known["mark"][:1].view(np.uint64))[0] % np.uint64(SALTS))
    for i, j in zip(edges, edges[1:], strict=False):
        some = by[i:j]
        docs, places = known[owner[a[some]]], place[a[some]]
        rows.append(_row(int(bucket[some[0]]), salt if hot[some[0]] else None, docs, places, _packed(strings, at[a[some]], at[z[some]] + WINDOW - 1)))
    return rows


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Ids, hashes and texts of a task's rows, in blocks of so many bytes."""
    ids, marks, texts, size = [], [], [], 0
    for b in batches:
        for i, m, t in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if t:
                ids.append(i)
                marks.append(m)
                texts.append(t)
                size += len(t)
            if size >= block_bytes:
                yield ids, marks, texts
                ids, marks, texts, size = [], [], [], 0
    if ids:
        yield ids, marks, texts


def _send(block_bytes: int, buckets: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("substring")
        for ids, marks, texts in _blocks(batches, block_bytes):
            yield _rows(_send_block(ids, marks, texts, buckets, frequent))

    return run


def _short_counts(block_bytes: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The short runs that occur often in a block of texts, with their number, and the block's words under hash 0."""
        turn_to("substring")
        for _, _, texts in _blocks(batches, block_bytes):
            joined = [j for j in (b" ".join(t.split()) for t in texts) if j]
            if not joined:
                continue
            strings = _Strings(b"\n".join(joined) + b"\n", np.array([len(j) + 1 for j in joined]))
            (short,) = strings.hashes(SHORT)
            h, n = np.unique(short[strings.runs(SHORT)[1]], return_counts=True)
            often = n >= least
            h, n = np.append(h[often], np.uint64(0)), np.append(n[often], strings.words.sum())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return run


def frequent_runs(scratch: Scratch, rows: DataFrame, block_bytes: int, frequent: int, block_least: int) -> np.ndarray:
    """The sorted hashes of the corpus's frequent short runs, at most MAX_FREQUENT."""
    counts = rows.mapInArrow(_short_counts(block_bytes, block_least), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts.filter((F.col("n") >= frequent) | (F.col("hash") == 0)), "frequent")
    words = counts.filter("hash = 0").agg(F.sum("n")).first()[0] or 0
    # each of the runs found occurs so often that no more than MAX_FREQUENT fit among all words
    found = counts.filter((F.col("n") >= max(frequent, words // MAX_FREQUENT)) & (F.col("hash") != 0)).select("hash").toArrow()
    return np.sort(found.column("hash").to_numpy().astype(np.int64).view(np.uint64))


def _fold(rows: list[Row]) -> tuple[Row | None, Row | None]:
    """A bucket's rows as one: the spans of windows that occur earlier, and the stretches of all others."""
    doc = np.concatenate([np.frombuffer(r[2], DOC) for r in rows])
    pos = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]).astype(np.int64)
    pieces = [x for r in rows for x in zstandard.ZstdDecompressor().decompress(r[4]).split(b"\n")]
    order = np.lexsort((pos, doc["mark"], doc["id"]))
    doc, pos = doc[order], pos[order]
    pieces = [pieces[i] for i in order.tolist()]
    strings = _Strings(b"\n".join(pieces) + b"\n", np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
    del pieces
    owner, at = strings.runs(WINDOW)
    place = pos[owner] + (at - strings.first[owner])
    d = doc[owner]
    back = np.flatnonzero((d[1:] == d[:-1]) & (place[1:] <= place[:-1]))
    if len(back):  # a document that came twice, cut in other ways
        turn = np.lexsort((place, d["mark"], d["id"]))
        owner, at, place, d = owner[turn], at[turn], place[turn], d[turn]
    (long,) = strings.hashes(WINDOW)
    first = _earliest(strings, at, long[at])
    again = (d[first] != d) | (place[first] != place)
    which = np.flatnonzero(again)
    spans = _span_row(*_spans(d[which], place[which])) if len(which) else None
    fresh = np.flatnonzero(first == np.arange(len(at)))  # of a document that came twice, once
    begin, stop = _stretches(at, owner, fresh)
    a, z = fresh[begin], fresh[stop]
    kept = _row(rows[0][0], None, d[a], place[a], _packed(strings, at[a], at[z] + WINDOW - 1)) if len(a) else None
    return spans, kept


def _count(batches: Iterator[pa.RecordBatch], fold_bytes: int = FOLD_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and salt. Each part's rows are folded; of a salted part what is new in it is sent on."""
    turn_to("substring")
    rows: list[Row] = []
    size = held = 0

    def folded() -> list[Row]:
        """Folds rows to one and returns the spans found."""
        nonlocal rows, size, held
        spans, kept = _fold(rows)
        rows = [kept] if kept else []
        held = size = _unpacked(kept[4]) if kept else 0
        return [spans] if spans else []

    now, out = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in _SENT.names), strict=True):
            if row[0] is None:
                out.append(row)
                continue
            if row[:2] != now:
                if rows:
                    out += folded()
                    if now[1] is not None:
                        out += rows
                rows, size, held, now = [], 0, 0, row[:2]
            rows.append(row)
            size += _unpacked(row[4])
            if size > held + max(held, fold_bytes):
                out += folded()
        yield _rows(out)
        out = []
    if rows:
        out += folded()
        if now[1] is not None:
            out += rows
        yield _rows(out)


def _unpacked(packed: bytes) -> int:
    return zstandard.frame_content_size(packed)


FOUND = "doc_id long, mark long, pos int, end int"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, a row each."""
    for b in batches:
        docs, pos, end = (b"".join(b.column(c).to_pylist()) for c in ("docs", "places", "packed"))
        d = np.frombuffer(docs, DOC)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(d[k])) for k in ("id", "mark")), pa.array(np.frombuffer(pos, np.int32)), pa.array(np.frombuffer(end, np.int32))], ["doc_id", "mark", "pos", "end"])


def _document(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """What tells documents apart."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)), F.xxhash64(text.cast("string"))


def repeated_spans(scratch: Scratch, docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, frequent: int = FREQUENT, block_least: int = BLOCK_LEAST, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """doc_id (NULL_ID for null), mark, pos and end: spans of words inside windows that start earlier as well. May overlap."""
    doc_id, mark = _document(F.col("doc_id"), F.col("text"))
    rows = docs.select(doc_id.alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, 3 * size // bucket_bytes)  # each word is sent about three times
    often = frequent_runs(scratch, rows, block_bytes, frequent, block_least)
    sent = rows.mapInArrow(_send(block_bytes, buckets, often), SENT)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, 3 * size // TASK_BYTES))

    def counted(part: DataFrame) -> DataFrame:
        # spans have no bucket: they are dealt out by their own content
        key = F.when(F.col("bucket").isNull(), F.xxhash64("docs", "places")).otherwise(F.xxhash64("bucket", "salt"))
        return part.repartition(tasks, key).sortWithinPartitions("bucket", "salt").mapInArrow(lambda b: _count(b, fold_bytes), SENT)

    once = scratch.save(counted(sent), "counted")
    spans = once.filter("bucket is null")
    if len(often):
        spans = spans.unionByName(counted(once.filter("bucket is not null")))
    return spans.select("docs", "places", "packed").mapInArrow(_found, FOUND)


def _removed(n: int, spans: list[dict] | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    for s in spans or ():
        gone[s["pos"] : s["end"]] = True
    return gone


def _kept(text: bytes | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = _removed(len(words), spans)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_kept(t, s) for t, s in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True)]
        n, gone, kept = zip(*got, strict=True) if got else ((), (), ())
        ids = b.column("doc_id")
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_spans(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """docs and a column of that name: what to remove from each row, null for nothing."""
    ready(spark)
    scratch = Scratch(spark, "substring")
    spans = scratch.save(repeated_spans(scratch, docs), "spans")
    scratch.drop("counted", "frequent")
    own_id, own_mark = unused([*docs.columns, name], "id", "mark")
    by_doc = scratch.save(spans.groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.collect_set(F.struct("pos", "end")).alias(name)), "by-doc")
    scratch.drop("spans")
    doc_id, mark = _document(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({own_id: doc_id, own_mark: mark})
    return keyed.join(by_doc, [own_id, own_mark], "left").drop(own_id, own_mark)


def removals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs."""
    rows = with_spans(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "spans")
    return rows.select("doc_id", "text", "spans").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _texts(spans: str, new: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_kept(t, s)[2].decode() if s else None for t, s in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column(spans).to_pylist(), strict=True)]
            names = [c for c in b.schema.names if c != spans]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(texts, pa.string())], [*names, new])

    return run


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with repeated spans taken out of text (kept words joined by one space) and n_chars brought up to date; texts
    that lose nothing stay as they are, and no row is dropped."""
    own = docs.columns
    spans, changed = unused(own, "spans", "text")
    rows = with_spans(spark, docs, spans)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{changed}` string"
    out = rows.mapInArrow(_texts(spans, changed), schema)
    text = F.col(changed)
    new = {"text": F.coalesce(text, F.col("text"))}
    if "n_chars" in own:
        new["n_chars"] = F.when(text.isNotNull(), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*((new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
s AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM f, range(0, {WINDOW}) AS t(k) WHERE nth > 1),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)
"""
