"""Scans of thread and extraction documents, gold labels and lists, and the flat tables made of them.

Every scan reads with a declared schema and keeps what it couldn't read as rows, so that bad files are named and not lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from plausia.operators.saved import saved
from plausia.sources import schemas

BROKEN = "_corrupt_record"


def _read(spark: SparkSession, path: str, schema: StructType, lines: bool) -> DataFrame:
    with_broken = StructType([*schema.fields, StructField(BROKEN, StringType())])
    return spark.read.schema(with_broken).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path).withColumn("file", F.input_file_name())


def threads(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Threads that were read, and a row (file, problem) for each document that wasn't."""
    every = _read(spark, path, schemas.THREAD, lines)
    problem = F.when(F.col(BROKEN).isNotNull(), "not a thread").when(F.col("id").isNull(), "no id")
    good = every.withColumn("_problem", problem)
    return good.filter("_problem is null").drop("_problem", BROKEN, "file"), good.filter("_problem is not null").select("file", F.col("_problem").alias("problem"))


def comments(threads_: DataFrame) -> DataFrame:
    """A row for each comment, with its place in the thread."""
    at = threads_.select(F.col("id").alias("thread_id"), "category", F.posexplode("comments").alias("ordinal", "c"))
    return at.select("thread_id", "category", "ordinal", F.col("c.id").alias("comment_id"), F.col("c.parent_id").alias("parent_id"), F.when(F.col("c.author.name") != "[deleted]", F.col("c.author.name")).alias("author"), F.col("c.body").alias("body"), F.col("c.created_at").alias("created_at"), F.col("c.score").alias("score"), F.coalesce("c.status", F.lit("ok")).alias("status"))


def flattened(nested: DataFrame, replies: str = "replies") -> DataFrame:
    """Nested replies as flat rows (id, parent_id, body, depth): one level of arrays is opened at a time, as deep as the schema goes."""
    level, depth = nested.select("id", F.lit(None).cast("string").alias("parent_id"), "body", replies), 0
    out = level.select("id", "parent_id", "body", F.lit(0).alias("depth"))
    while replies in level.columns:
        depth += 1
        deeper = replies in level.schema[replies].dataType.elementType.names
        opened = level.select(F.col("id").alias("parent_id"), F.explode(replies).alias("r"))
        level = opened.select("r.id", "parent_id", "r.body", *([F.col(f"r.{replies}").alias(replies)] if deeper else []))
        out = out.unionByName(level.select("id", "parent_id", "body", F.lit(depth).alias("depth")))
    return out


def own_replies(flat: DataFrame, post: str) -> DataFrame:
    """Flat comments (id, parent_id, link_id) that belong to a post and whose parent is there; the others are dropped level by level."""
    mine = flat.filter(typed_id(F.col("link_id")) == post)
    while True:
        here = mine.select(F.col("id").alias("parent_id"))
        kept = saved(mine.filter(F.col("parent_id").isNull() | (typed_id(F.col("parent_id")) == post)).unionByName(mine.filter(F.col("parent_id").isNotNull() & (typed_id(F.col("parent_id")) != post)).join(here, "parent_id", "left_semi").select(*mine.columns)))
        if kept.count() == mine.count():
            return kept
        mine = kept


def typed_id(raw: Column) -> Column:
    """An id without the prefix that says what kind of thing it names."""
    return F.regexp_replace(raw, "^t[0-9]_", "")


def thread_rows(raw: DataFrame) -> DataFrame:
    """Raw posts as typed rows: ids without prefixes, times from seconds, the writer unless deleted."""
    return raw.select(typed_id(F.col("id")).alias("id"), F.col("subreddit").alias("community"), "title", F.col("selftext").alias("body"), F.when(~F.col("author").isin("[deleted]", "[removed]"), F.col("author")).alias("author"), F.timestamp_seconds("created_utc").alias("created_at"), F.col("score").cast("long").alias("score"), F.col("num_comments").cast("long").alias("num_comments"))


def extractions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Extractions that were read, and a row (file, problem) for each document that wasn't."""
    every = _read(spark, path, schemas.EXTRACTION, lines)
    problem = F.when(F.col(BROKEN).isNotNull(), "not an extraction").when(F.col("thread_id").isNull(), "no thread")
    good = every.withColumn("_problem", problem)
    return good.filter("_problem is null").drop("_problem", BROKEN, "file"), good.filter("_problem is not null").select("file", F.col("_problem").alias("problem"))


SERVICE = r"\b(treatment|facials?|appointment|salon|clinic|repair service|subscription)\b"


def checked(found: DataFrame, comments_: DataFrame, part: str = "mentions", most_words: int = 50, tags: list[str] | None = None, service: str = SERVICE) -> DataFrame:
    """One part of the extractions (mentions, notes, agreements or care) beside their comments, with the first rule that each row breaks
    (null for kept). comments_ are those of the threads: thread_id, comment_id, parent_id, body, status. tags: the evidence tags there
    are, all if none are given. A comment that is one quoted block counts as its writer's own only if no other comment of the thread has
    its words."""
    from plausia.functions.registry import find_quote, in_quoted_block

    m = found.select("thread_id", F.posexplode(part).alias("ordinal", "m")).select("thread_id", "ordinal", "m.*")
    text = F.lower(F.regexp_replace(F.regexp_replace("body", r"(?m)^\s*(>|&gt;)+", ""), r"\s+", " "))
    quoted = comments_.select("thread_id", F.trim(text).alias("_words")).filter("_words <> ''").groupBy("thread_id", "_words").agg(F.count(F.lit(1)).alias("_holders"))
    c = comments_.select("thread_id", "comment_id", "parent_id", "body", "status", F.lit(True).alias("there"), F.trim(text).alias("_words")).join(quoted, ["thread_id", "_words"], "left")
    above = comments_.select("thread_id", F.col("comment_id").alias("parent_id"), F.col("parent_id").alias("_grand"), F.col("status").alias("_above"))
    further = comments_.select("thread_id", F.col("comment_id").alias("_grand"), F.col("status").alias("_further"))
    j = m.join(c, ["thread_id", "comment_id"], "left").join(above, ["thread_id", "parent_id"], "left").join(further, ["thread_id", "_grand"], "left").withColumn("at", find_quote("body", "quote"))
    words = F.size(F.split(F.trim(F.expr("substring(body, at.start + 1, at.end - at.start)")), r"\s+"))
    only_quoted = F.coalesce(F.col("_holders") > 1, F.lit(False)) & F.rlike("body", F.lit(r"^\s*(>|&gt;)"))
    rules = [
        ("comment not in thread", F.col("there").isNull()), ("comment unreadable", F.col("status") != "ok"), ("quote not found", F.col("at.start").isNull()),
        ("quoted block", in_quoted_block("body", "at.start", "at.end") | only_quoted), ("quote too long", words > most_words),
    ]
    if part == "mentions":
        refers = F.col("refers_to")
        rules += [
            ("not a reply", refers.isin("parent", "earlier") & F.col("parent_id").isNull()), ("not a reply to a reply", (refers == "earlier") & F.col("_grand").isNull()),
            ("named in an unreadable comment", (refers == "parent") & (F.col("_above") != "ok") | (refers == "earlier") & (F.col("_further") != "ok")),
        ]
        if tags is not None:
            rules.append(("unknown tag", F.size(F.array_except(F.coalesce("evidence_tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)))) > 0))
        rules.append(("a service", F.rlike(F.lower(F.coalesce("product_type", F.lit(""))), F.lit(service))))
    elif part == "notes":
        rules.append(("a service", F.rlike(F.lower(F.coalesce("about", F.lit(""))), F.lit(service))))
    elif part == "agreements":
        rules.append(("not a reply", F.col("parent_id").isNull()))
    else:
        rules.append(("asks a question", F.rtrim("quote").endswith("?")))
    from plausia.operators.threads import first_reason

    return j.withColumn("reject_reason", first_reason(rules)).drop("there", "body", "status", "at", "parent_id", "_words", "_holders", "_grand", "_above", "_further")


def checked_mentions(found: DataFrame, comments_: DataFrame, most_words: int = 50) -> DataFrame:
    return checked(found, comments_, "mentions", most_words)


def comment_rows(raw: DataFrame) -> DataFrame:
    """Raw comments as typed rows: ids without prefixes, a parent only if it is a comment, the post's id, and what became of the text."""
    gone = F.when(F.col("body") == "[deleted]", "deleted").when(F.col("body") == "[removed]", "removed").otherwise("ok")
    return raw.select(
        typed_id(F.col("id")).alias("comment_id"), F.when(F.col("parent_id").startswith("t1_"), typed_id(F.col("parent_id"))).alias("parent_id"), typed_id(F.col("link_id")).alias("thread_id"),
        F.when(~F.col("author").isin("[deleted]", "[removed]"), F.col("author")).alias("author"), F.when(gone == "ok", F.col("body")).alias("body"), F.timestamp_seconds("created_utc").alias("created_at"), F.col("score").cast("long").alias("score"), gone.alias("status"),
    )


def gold_labels(spark: SparkSession, path: str, schema: StructType = schemas.LABELS) -> DataFrame:
    """A label file; a cell of tags is parted at commas or semicolons, and blank rows are left out."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    tags = F.array_distinct(F.filter(F.transform(F.split("tags", "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.filter(F.coalesce(*schema.names).isNotNull()).withColumn("tags", F.coalesce(tags, F.array().cast("array<string>")))


def json_list(spark: SparkSession, path: str, schema: StructType = schemas.PRICES) -> DataFrame:
    """A curated list: one JSON array in a file, dates as dates."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("checked_on", F.to_date("checked_on")) if "checked_on" in rows.columns else rows


def records(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON, and a row (file, line) for each line that isn't a record."""
    whole = StructType([*schema.fields, StructField(BROKEN, StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.input_file_name().alias("file"), "value", F.from_json("value", whole, {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    return lines.filter(F.col(f"r.{BROKEN}").isNull()).select("r.*").drop(BROKEN), lines.filter(F.col(f"r.{BROKEN}").isNotNull()).select("file", F.col("value").alias("line"))


SUMMARIES = StructType([StructField("name", StringType()), StructField("category", StringType()), StructField("summary", StringType()), StructField("cited", ArrayType(StringType()))])


def summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A list of saved summaries: the whole ones, and a row (file, problem) for each entry that lacks its name, text or sources."""
    every = _read(spark, path, SUMMARIES, lines=False)
    problem = F.when(F.col(BROKEN).isNotNull(), "not a summary").when(F.col("name").isNull(), "no name").when(F.coalesce(F.trim("summary"), F.lit("")) == "", "no text").when(F.coalesce(F.size("cited"), F.lit(0)) <= 0, "cites nothing")
    marked = every.withColumn("problem", problem)
    return marked.filter("problem is null").drop("problem", BROKEN, "file"), marked.filter("problem is not null").select("file", "problem")


def aliases(spark: SparkSession, path: str, section: str = "products") -> DataFrame:
    """Short names of a file {section: {category: [{short, full}]}} as rows (category, short, full)."""
    entry = StructType([StructField("short", StringType()), StructField("full", StringType())])
    schema = StructType([StructField(section, MapType(StringType(), ArrayType(entry)))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode(section).alias("category", "entries")).select("category", F.inline("entries"))


def compressed_lines(spark: SparkSession, path: str, most_lines: int = 1_000, window: int = 31) -> DataFrame:
    """The lines of zstd files (file, line), for files whose window is up to 1 << window bytes. A task reads a file as a stream and
    hands on some lines at a time; what it holds of a file is its compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                reader = zstandard.ZstdDecompressor(max_window_size=1 << window).stream_reader(io.BytesIO(content.as_py()), read_across_frames=True)
                lines: list[str] = []
                for line in io.TextIOWrapper(reader, encoding="utf-8", errors="replace"):
                    lines.append(line.rstrip("\n"))
                    if len(lines) >= most_lines:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines)], ["file", "line"])
                        lines = []
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines)], ["file", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition(max(1, len(files.inputFiles())), "path").mapInArrow(run, "file string, line string")


def submissions(lines: DataFrame, schema: StructType, rules: list[tuple[str, Column]]) -> DataFrame:
    """Dumped posts as rows with drop_reason: "not a record", or the first rule (reason, what drops) that holds; null for kept."""
    rows = lines.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    reason = F.when(F.coalesce(*(F.col(c).cast("string") for c in schema.names)).isNull(), "not a record")
    for name, drops in rules:
        reason = reason.when(drops, name)
    return rows.withColumn("drop_reason", reason)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of each file: what a cached scan is keyed by. No content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """What a scan that was kept has to do: the files (path, change) that are new, changed or gone since its fingerprint."""
    old, new = (df.select("path", F.struct("length", "modificationTime").alias(side)) for df, side in ((before, "was"), (now, "is")))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") != F.col("is"), "changed")
    return old.join(new, "path", "full").select("path", change.alias("change")).filter("change is not null")
