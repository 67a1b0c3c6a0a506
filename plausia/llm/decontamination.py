"""Benchmark decontamination: windows of templates, hash-joined, with a check of what fills the slots.

A text is read as a template: numbers, units after a number, and names become typed slots, all else is lower case without outer
punctuation; a sign of arithmetic beside a number is a word like any other. What is a name can't be told for sure, so a window
has up to three templates, and any may match: capitalised words that don't open a sentence are names; no word is, because
case may be lost when a text is copied; every capitalised word is, also one that opens a sentence or the window. What a window's
templates are depends on its own words only. Windows of WINDOW words (a shorter item is one window) of texts and benchmark are
joined by hash; a pair is confirmed word for word, and its slots must be consistent: a value of the benchmark always stands
against the same value of the text, over all windows of an item that lie alike. So a question with other numbers or names is
caught, and a chance likeness of slots isn't. A window with under LEAST_WORDS words that aren't slots is too common as a
template; it is matched exactly, slots and all.

The benchmark's texts are sent to every task only while they have at most MAX_SENT bytes, which are summed before; a worker
builds its index of them once. Beyond that, windows of both sides are joined by a shuffle on their hash: a bitmap of fixed size drops
most of the texts' windows where they are made, hashes alone are joined first, and words are looked up for hits only.

Defined results: null and empty texts, and items of under LEAST_EXACT words, match nothing; an empty benchmark matches nothing;
repeated rows are judged each; a null doc_id is judged like any other; items without an item_id are matched like others and count
as one item that isn't listed; several items of one id count as one, each matched by its own text. Columns may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import NULL_ID, Scratch, cached_for, ready, table, turn_to, unused

WINDOW, LEAST_WORDS, LEAST_EXACT = 10, 5, 4
#: Bytes of benchmark texts that are sent to every task at most (an index of them takes about 25 times as much).
MAX_SENT = 4_000_000
MAX_WORDS = 300_000
#: The bitmap of the shuffle form: 1 << BITMAP bits, told by the first bits of a hash.
BITMAP = 26
UNITS = frozenset(
    "% $ c cm day days dollars euro euros f ft g gb gram grams h hour hours hz inch inches k kb kg khz kilometers kilometres km kmh kw kwh l lb lbs "
    "liter liters litre litres m mb meter meters metre metres mg mhz mi mile miles min minute minutes ml mm month months mph ms oz percent pound "
    "pounds s sec second seconds tb ton tons tonne tonnes v volt volts w watt watts week weeks yard yards year years".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen".split()
)
_NUMBER = re.compile(r"[+-]?[$£€]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-z]{1,3})?", re.I)
_CORE = re.compile(r"[^\W_].*[^\W_]|[^\W_]|[$%]", re.S)
_SIGN = re.compile(r"([-+*/=^<>\u00d7\u00f7\u2212])[.,;:!?]*")
#: Most words: Latin letters, at most the first one a capital, and marks after them.
_COMMON = re.compile("([A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)([.,;:!?]*)")
#: What a word is, in the low bits of its code; ENDS marks the end of a sentence.
LITERAL, NUMBER, NAME, UNIT, NOTHING, SIGN, KIND, ENDS = 0, 1, 2, 3, 4, 5, 7, 8
_FLAGS = np.uint64(15)
_ENDING = frozenset(".!?:")
_SLOTS = {NUMBER: np.uint64(0x1000), NAME: np.uint64(0x2000), UNIT: np.uint64(0x3000)}
_RNG = np.random.default_rng(77)
_PLACES = _RNG.integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def core(word: str) -> str:
    """A word without outer punctuation; a sign of arithmetic is its own core."""
    m = _CORE.search(word)
    if m:
        return m[0]
    m = _SIGN.fullmatch(word)
    return m[1] if m else ""


def kind(word: str) -> int:
    """What a word can be, with ENDS if a sentence ends after it."""
    c = core(word)
    if not c:
        return NOTHING
    if len(c) == 1 and _SIGN.fullmatch(c):
        return SIGN | (ENDS if word[-1] in _ENDING else 0)
    low = c.lower()
    k = NUMBER if _NUMBER.fullmatch(c) or low in NUMBERS else UNIT if low in UNITS else NAME if c[0].isupper() and (len(c) == 1 or not c.isupper()) else LITERAL
    return k | (ENDS if word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":") else 0)


class _Codes(dict):
    """A 60-bit hash of a word's core in lower case, and its kind, for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        m = _COMMON.fullmatch(word)
        if m:
            low = m[1].lower()
            k = NUMBER if low in NUMBERS else UNIT if low in UNITS else NAME if m[1] != low and len(low) > 1 else LITERAL
            c = (xxhash.xxh64_intdigest(low, seed=10) & ~15) | k | (ENDS if m[2][-1:] in _ENDING else 0)
        else:
            c = (xxhash.xxh64_intdigest(core(word).lower(), seed=10) & ~15) | kind(word)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = c
        return c


_CODES = _Codes()
cached_for("benchmark", _CODES.clear)


def codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


NAMED, PLAIN, EVERY, EXACT = range(4)


def windows_of(code: np.ndarray, size: int, exact: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first words and hashes of all windows with names as the first template has them; then of those that the second and
    third change; and, if asked for, of all windows with nothing as a slot."""
    n = len(code) - size + 1
    if n <= 0:
        return
    literal = code & ~_FLAGS
    k = (code & np.uint64(KIND)).astype(np.uint8)
    opens = np.concatenate([[True], (code[:-1] & np.uint64(ENDS)) != 0])
    capital = k == NAME
    name = capital & ~opens
    first = np.where(k == NUMBER, _SLOTS[NUMBER], literal)
    plain = first.copy()
    plain[(k == UNIT) & np.concatenate([[False], k[:-1] == NUMBER])] = _SLOTS[UNIT]
    inner = np.where(name, _SLOTS[NAME], plain)
    yield NAMED, np.arange(n), _hashed(size, lambda i: first[:n] if i == 0 else inner[i : i + n])
    starts = _covering(np.flatnonzero(name), 1, size, n)
    if len(starts):
        yield PLAIN, starts, _hashed(size, lambda i: first[starts] if i == 0 else plain[starts + i])
    every = _covering(np.flatnonzero(capital & opens), 0, size, n, np.flatnonzero(name))
    if len(every):
        slot = np.where(capital, _SLOTS[NAME], plain)
        begin = np.where(capital, _SLOTS[NAME], first)
        yield EVERY, every, _hashed(size, lambda i: begin[every] if i == 0 else slot[every + i])
    if exact:
        yield EXACT, np.arange(n), _hashed(size, lambda i: literal[i : i + n])


def _covering(at: np.ndarray, low: int, size: int, n: int, more: np.ndarray | None = None) -> np.ndarray:
    """The windows that hold one of some words at place low or later, or begin with one of some more."""
    hit = np.zeros(n + size, bool)
    for i in range(low, size):
        hit[np.maximum(at - i, -1)] = True  # -1: the last entry, which isn't read
    if more is not None:
        hit[more] = True
    return np.flatnonzero(hit[:n])


def _hashed(size: int, word) -> np.ndarray:
    x = word(0) * _PLACES[0] + np.uint64(size)
    for k in range(1, size):
        x = (x ^ (x >> np.uint64(31))) * _PLACES[k] + word(k)
    return x ^ (x >> np.uint64(29))


def slots(words: list[str], mode: int) -> list[tuple[int, str]]:
    """A window's words as (kind, value) in one of its templates; kind is LITERAL for what is no slot."""
    out, before, ended = [], NOTHING, True
    for i, w in enumerate(words):
        k = kind(w)
        plain = k & KIND
        if plain == SIGN or mode == EXACT or plain == UNIT and (before != NUMBER or i == 0) or plain == NAME and (mode == PLAIN or mode == NAMED and (ended or i == 0)):
            plain = LITERAL
        out.append((plain, core(w).lower()))
        before, ended = k & KIND, bool(k & ENDS)
    return out


def mapping(item: list[tuple[int, str]], text: list[tuple[int, str]]) -> dict[tuple[int, str], str] | None:
    """What stands against each slot value of the benchmark; None if the templates differ or a value has two."""
    out: dict[tuple[int, str], str] = {}
    for (k, a), (m, b) in zip(item, text, strict=True):
        if k != m or k == LITERAL and a != b:
            return None
        if k != LITERAL and out.setdefault((k, a), b) != b:
            return None
    return out


def templates(item: list[str]) -> list[int]:
    """The templates of an item's window that have enough words that aren't slots; EXACT where none has."""
    found = [m for m in (NAMED, PLAIN, EVERY) if sum(k == LITERAL for k, _ in slots(item, m)) >= LEAST_WORDS]
    return found or [EXACT]


def confirmed(item: list[str], text: list[str]) -> dict[tuple[int, str], str] | None:
    """mapping() of two windows' words in the first of the item's templates that has one."""
    for mode in templates(item):
        m = mapping(slots(item, mode), slots(text, mode))
        if m is not None:
            return m
    return None


def consistent(maps: list[dict[tuple[int, str], str]]) -> bool:
    """Whether windows that lie alike agree on what stands against each value, or one of them is word for word."""
    every: dict[tuple[int, str], set[str]] = defaultdict(set)
    for m in maps:
        for k, v in m.items():
            every[k].add(v)
    return all(len(v) == 1 for v in every.values()) or any(all(k[1] == v for k, v in m.items()) for m in maps)


def _something(code: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the words that aren't punctuation alone; a sign only if the word before or after it in its text is a number."""
    k = (code & np.uint64(KIND)).astype(np.uint8)
    keep = k < NOTHING
    sign = np.flatnonzero(k == SIGN)
    if len(sign):
        same = owner[1:] == owner[:-1]
        before, after = np.zeros(len(k), bool), np.zeros(len(k), bool)
        before[1:] = same & (k[:-1] == NUMBER)
        after[:-1] = same & (k[1:] == NUMBER)
        keep[sign] = (before | after)[sign]
    return np.flatnonzero(keep)


def words_of(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of one text that are something, with their codes."""
    words = (text or "").split()
    code = codes(words)
    at = _something(code, np.zeros(len(words), np.int8))
    return [words[i] for i in at.tolist()], code[at]


#: A window of the benchmark: its hash, its number of words, whether it is matched exactly, and its first word.
Window = tuple[int, int, bool, int]


def item_windows(words: list[str], code: np.ndarray) -> list[Window]:
    size = min(WINDOW, len(words))
    if size < LEAST_EXACT:
        return []
    wanted = [templates(words[i : i + size]) for i in range(len(words) - size + 1)]
    return [(h, size, mode == EXACT, i) for mode, starts, hashes in windows_of(code, size, True) for i, h in zip(starts.tolist(), hashes.tolist(), strict=True) if mode in wanted[i]]


class Texts:
    """The words of some texts, one after the other."""

    def __init__(self, texts: list[str | None]):
        split = [t.split() if t else [] for t in texts]
        self.words = [w for ws in split for w in ws]
        code = codes(self.words)
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        self.at = _something(code, owner)
        self.code, self.owner = code[self.at], owner[self.at]
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))

    def windows(self, sizes: dict[int, bool], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, first words and hashes of the windows within a text whose hash the bitmap has. sizes: those wanted, and whether exactly too."""
        shift = np.uint64(65 - len(bits).bit_length())
        for size, exact in sizes.items():
            for _, starts, h in windows_of(self.code, size, exact):
                near = np.flatnonzero(bits[(h >> shift).astype(np.int64)])
                near = near[self.owner[starts[near]] == self.owner[starts[near] + size - 1]]
                yield size, starts[near], h[near]

    def of(self, start: int, size: int) -> list[str]:
        return [self.words[i] for i in self.at[start : start + size].tolist()]


class Matcher:
    """The benchmark's windows by hash, in arrays."""

    def __init__(self, items: list[tuple[int, str]]):
        """items: ids and texts."""
        self.ids = [i for i, _ in items]
        self.words: list[list[str]] = []
        rows = []
        for n, (_, text) in enumerate(items):
            words, code = words_of(text)
            self.words.append(words)
            rows += [(h, n, i, size, exact) for h, size, exact, i in item_windows(words, code)]
        self.table = np.array(sorted(set(rows)), [("hash", np.uint64), ("item", np.int32), ("place", np.int32), ("size", np.int8), ("exact", bool)])
        self.hash = np.ascontiguousarray(self.table["hash"])
        self.sizes = {int(s): bool(self.table["exact"][self.table["size"] == s].any()) for s in np.unique(self.table["size"])}
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def match(self, texts: list[str | None]) -> list[tuple[set[int], int]]:
        """For each text the ids of its items, and the number of windows that are theirs."""
        found: list[dict[tuple[int, int], dict]] = [defaultdict(dict) for _ in texts]
        mine = Texts(texts)
        for size, starts, h in mine.windows(self.sizes, self.bits):
            low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            for j in np.flatnonzero(high > low).tolist():
                i = int(starts[j])
                own, text = mine.of(i, size), int(mine.owner[i])
                for _, item, place, theirs, _ in self.table[low[j] : high[j]].tolist():
                    by = found[text][item, i - place]
                    if theirs == size and i not in by and (m := confirmed(self.words[item][place : place + size], own)) is not None:
                        by[i] = m
        out = []
        for by in found:
            sure = [(item, len(maps)) for (item, _), maps in by.items() if maps and consistent([*maps.values()])]
            out.append(({self.ids[item] for item, _ in sure}, sum(n for _, n in sure)))
        return out


_MATCHERS: dict[str, Matcher] = {}
cached_for("matcher", _MATCHERS.clear)


def _in_place(items: list[tuple[int, str]], key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("benchmark")
        matcher = _MATCHERS.get(key)
        if matcher is None:
            _MATCHERS.clear()
            matcher = _MATCHERS[key] = Matcher(items)
        for b in batches:
            got = matcher.match(b.column("text").cast(pa.string()).to_pylist())
            columns = [pa.array([sorted(ids) for ids, _ in got], pa.list_(pa.int64())), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *names])

    return run


ITEM_ROWS = "hash long, size int, exact boolean, item long, item_id long, item_place int, item_words string"


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The benchmark's windows, a row each."""
    for b in batches:
        rows = []
        for item, item_id, text in zip(*(b.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
            words, code = words_of(text)
            rows += [(h, size, exact, item, item_id, i, " ".join(words[i : i + size])) for h, size, exact, i in set(item_windows(words, code))]
        h, size, exact, item, item_id, place, words = zip(*rows, strict=True) if rows else ((),) * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(exact, pa.bool_()), pa.array(item, pa.int64()), pa.array(item_id, pa.int64()), pa.array(place, pa.int32()), pa.array(words, pa.string())],
            ["hash", "size", "exact", "item", "item_id", "item_place", "item_words"],
        )


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which first bits the benchmark's hashes have: gathered as at most 1 << (BITMAP - 6) words of 64 bits."""
    top = windows.select(F.shiftrightunsigned("hash", 64 - BITMAP).alias("top"))
    words = top.groupBy(F.shiftright("top", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(top & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _hits(sizes: dict[int, bool], packed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts' windows that the bitmap has: hash, size, row and place."""
        turn_to("benchmark")
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            rows = b.column("row").to_numpy(zero_copy_only=False)
            mine = Texts(b.column("text").to_pylist())
            for size, starts, h in mine.windows(sizes, bits):
                owner = mine.owner[starts]
                columns = [pa.array(np.ascontiguousarray(h).view(np.int64)), pa.array(np.full(len(h), size, np.int32)), pa.array(rows[owner]), pa.array((starts - mine.first[owner]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "size", "row", "place"])

    return run


def _words_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the windows that were hit."""
    for b in batches:
        out = []
        for row, text, hits in zip(*(b.column(c).to_pylist() for c in ("row", "text", "hits")), strict=True):
            words, _ = words_of(text)
            out += [(x["hash"], x["size"], row, x["place"], " ".join(words[x["place"] : x["place"] + x["size"]])) for x in hits]
        h, size, row, place, words = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(size, pa.int32()), pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(words, pa.string())], ["hash", "size", "row", "place", "words"])


_SLOT_LIST = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string()), ("own", pa.string())]))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for a, z in zip(b.column("item_words").to_pylist(), b.column("words").to_pylist(), strict=True):
            m = confirmed(a.split(" "), z.split(" "))
            maps.append(None if m is None else [{"kind": k, "value": v, "own": o} for (k, v), o in sorted(m.items())])
        names = ["row", "item", "item_id", "lie", "place"]
        out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(maps, _SLOT_LIST)], [*names, "slots"])
        yield out.filter(pa.array([m is not None for m in maps], pa.bool_()))


def _by_shuffle(scratch: Scratch, texts: DataFrame, items: DataFrame) -> DataFrame:
    """row, ids and n for the texts (row, text) that hold an item."""
    windows = scratch.save(items.mapInArrow(_item_rows, ITEM_ROWS), "windows")
    sizes = {r["size"]: r["exact"] for r in windows.groupBy("size").agg(F.bool_or("exact").alias("exact")).collect()}  # at most WINDOW rows
    near = texts.mapInArrow(_hits(sizes, _bitmap(windows)), "hash long, size int, row long, place int")
    hits = scratch.save(near.join(windows.select("hash", "size").distinct(), ["hash", "size"], "left_semi"), "hits")
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("hash", "size", "place")).alias("hits"))
    theirs = scratch.save(texts.join(per_row, "row").select("row", "text", "hits").mapInArrow(_words_at, "hash long, size int, row long, place int, words string"), "words")
    pairs = theirs.join(windows, ["hash", "size"]).select("row", "item", "item_id", (F.col("place") - F.col("item_place")).alias("lie"), "place", "item_words", "words")
    both = pairs.mapInArrow(_confirmed, "row long, item long, item_id long, lie int, place int, slots array<struct<kind:int,value:string,own:string>>")
    whole = ["row", "item", "lie"]
    sure = scratch.save(both.groupBy(*whole, "place").agg(F.first("item_id").alias("item_id"), F.first("slots").alias("slots")), "sure")
    slot = sure.select(*whole, F.explode("slots").alias("s")).groupBy(*whole, "s.kind", "s.value").agg(F.count_distinct("s.own").alias("n"))
    torn = slot.filter("n > 1").select(*whole).distinct().withColumn("torn", F.lit(True))
    word_for_word = F.forall("slots", lambda s: s["value"] == s["own"])
    by = sure.groupBy(*whole).agg(F.first("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"), F.bool_or(word_for_word).alias("same"))
    fine = by.join(torn, whole, "left").filter("torn is null or same")
    return fine.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.sum("n").alias("n"))


def matched(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, items_name: str, windows_name: str, most_sent: int = MAX_SENT) -> DataFrame:
    """docs with two columns of those names: the ids of the items each row holds (NULL_ID for items without one), and the number of
    confirmed windows."""
    ready(spark)
    scratch = Scratch(spark, "benchmark")
    item_id = F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID))
    items = benchmark.filter("text is not null").select(item_id.alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{items_name}` array<long>, `{windows_name}` long"
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= most_sent:
        sent = sorted((r.item_id, r.text) for r in items.collect())  # at most most_sent bytes of texts
        return docs.mapInArrow(_in_place(sent, xxhash.xxh128_hexdigest(repr(sent)), [items_name, windows_name]), schema)
    (row,) = unused([*docs.columns, items_name, windows_name], "row")
    numbered = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    found = _by_shuffle(scratch, texts, items.withColumn("item", F.xxhash64("item_id", "text")))
    found = found.select(F.col("row").alias(row), F.col("ids").alias(items_name), F.col("n").alias(windows_name))
    out = numbered.join(found, row, "left")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.col(items_name), F.array().cast("array<long>")).alias(items_name), F.coalesce(F.col(windows_name), F.lit(0).cast("long")).alias(windows_name))


def judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, most_sent: int = MAX_SENT) -> DataFrame:
    """doc_id, contaminated, kept, n_items, n_windows and item_ids for every row of docs."""
    rows = matched(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, "items", "n_windows", most_sent)
    found = F.size("items") > 0
    return rows.select("doc_id", found.alias("contaminated"), (~found).alias("kept"), F.size("items").cast("long").alias("n_items"), "n_windows", F.filter("items", lambda i: i != NULL_ID).alias("item_ids"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with docs' own columns."""
    items, windows = unused(docs.columns, "items", "windows")
    return matched(spark, docs, benchmark, items, windows).filter(F.size(items) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
