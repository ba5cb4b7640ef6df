"""Corpus statistics over text columns, with JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each character occurs, (letter, n)."""
    return docs.select(F.explode(F.split(text, "")).alias("letter")).where("letter != ''").groupBy("letter").agg(F.count("*").alias("n"))


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adjacent pairs of ASCII letters and spaces inside a text; no pair crosses texts."""
    pairs = F.regexp_extract_all(F.col(text), F.lit("(?=([A-Za-z ]{2}))"), F.lit(1))  # one look ahead from every place
    return docs.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).select(F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"), "n")


def metrics(text: Column) -> list[Column]:
    """Sentences and lines (one more than their marks), words, letters and digits."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return [(n("[.!?]") + 1).alias("sentences"), (n("\n") + 1).alias("lines"), n("[^ \t\n\r]+").alias("words"), n("[A-Za-z]").alias("letters"), n("[0-9]").alias("digits")]


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-empty lines as blocks: (id, block, body), blocks counted from 0 over all lines."""
    return docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("block", "body")).where(F.trim("body") != "")


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block, body): runs of lines with a letter, trimmed, underscores removed and joined by spaces; any line without a letter ends a block."""
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("has", F.col("line").rlike("[A-Za-z]"))
    w = Window.partitionBy(id_col).orderBy("pos")
    runs = lines.withColumn("block", F.count_if(~F.col("has")).over(w)).where("has")
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.translate("line", "_", "")).alias("t")))), lambda r: r["t"])
    return runs.groupBy(id_col, "block").agg(F.concat_ws(" ", body).alias("body"))


def titled_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block, title, body): a block without lower-case letters is the title of the ones after it."""
    lower = F.col("body").rlike("[a-z]")
    w = Window.partitionBy(id_col).orderBy("block")
    titled = text_blocks(docs, id_col, text).withColumn("title", F.last(F.when(~lower, F.col("body")), True).over(w))
    return titled.where(lower).select(id_col, "block", "title", "body")


def bag_of_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, word, n) of ASCII-lower-cased runs of letters."""
    words = F.regexp_extract_all(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z]+)"), F.lit(1))
    return docs.select(id_col, F.explode(words).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def topic_words(bags: DataFrame, topics: DataFrame, id_col: str, smooth: float) -> DataFrame:
    """P(word | topic) with additive smoothing over the whole vocabulary, for words that the topic has; (topic, word, p). topics: (id, topic)."""
    counts = bags.join(topics, id_col).groupBy("topic", "word").agg(F.sum("n").alias("c"))
    size = bags.agg(F.countDistinct("word").alias("v"))
    total = counts.groupBy("topic").agg(F.sum("c").alias("t"))
    return counts.join(total, "topic").crossJoin(F.broadcast(size)).select("topic", "word", ((F.col("c") + smooth) / (F.col("t") + F.col("v") * smooth)).alias("p"))


def topic_nll(bags: DataFrame, topics: DataFrame, words: DataFrame, id_col: str) -> DataFrame:
    """Negative log likelihood of each document's words under its own topic."""
    j = bags.join(topics, id_col).join(words, ["topic", "word"])
    return j.groupBy(id_col).agg(F.sum(-F.col("n") * F.log("p")).alias("nll"))


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, line), counted from 0; null texts have none."""
    return docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def trim_lines(docs: DataFrame, start: int, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines from start, counted from 1, up to end, which is left out."""
    return lines(docs, id_col, text).where((F.col("pos") + 1 >= start) & (F.col("pos") + 1 < end))


def skip_starts_with(rows: DataFrame, words: list[str]) -> DataFrame:
    """Lines that start with none of the words, stripped."""
    bad = F.lit(False)
    for w in words:
        bad = bad | F.col("line").startswith(w)
    return rows.where(~bad).withColumn("line", F.trim("line"))


def skip_angled(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Leaves out what stands from a line that starts with << to the next later line that ends with >>, both included; an open block lasts to the end.

    Whether a line is inside follows from the last line that could change that, so windows over a document's lines decide.
    """
    opens, closes = F.col("line").startswith("<<"), F.col("line").endswith(">>")
    w = Window.partitionBy(id_col).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # A block begins at an opening line with no block open: the first opening line after each closing line. A closing line ends only a block begun before it.
    marked = rows.withColumn("_ends", F.coalesce(F.count_if(closes).over(before), F.lit(0)))
    seg = Window.partitionBy(id_col, "_ends")
    first = F.min(F.when(opens, F.col("pos"))).over(seg)
    marked = marked.withColumn("_first", first).withColumn("_last", F.max("pos").over(seg))
    # A segment runs to a closing line. If the block begins on that very line, it goes on through the next segment.
    per = marked.select(id_col, "_ends", "_first", "_last").distinct()
    sw = Window.partitionBy(id_col).orderBy("_ends")
    per = per.withColumn("_late", F.coalesce(F.col("_first") == F.col("_last"), F.lit(False)))
    # Runs of segments whose only opening is their last line alternate: the second of a pair is consumed by the block that the first began.
    per = per.withColumn("_run", F.sum(F.when(F.col("_late"), 0).otherwise(1)).over(sw.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("_nth", F.row_number().over(Window.partitionBy(id_col, F.coalesce("_run", F.lit(0))).orderBy("_ends")))
    carried = F.coalesce(F.lag("_late").over(sw) & (F.lag("_nth").over(sw) % 2 == 1), F.lit(False))
    per = per.withColumn("_in", carried).select(id_col, "_ends", "_in")
    got = marked.join(per, [id_col, "_ends"])
    return got.where(~F.col("_in") & (F.col("_first").isNull() | (F.col("pos") < F.col("_first")))).select(*rows.columns)


def numbered_paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block, number, body): paragraphs of lines with a letter under the last line of digits only, which ends no paragraph."""
    rows = lines(docs, id_col, text).withColumn("t", F.trim("line")).withColumn("digits", F.col("t").rlike("^[0-9]+$"))
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("number", F.last(F.when(F.col("digits"), F.col("t")), True).over(w)).where(~F.col("digits"))
    rows = rows.withColumn("has", F.col("t").rlike("[A-Za-z]"))
    rows = rows.withColumn("block", F.count_if(~F.col("has")).over(w)).where("has")
    parts = F.array_sort(F.collect_list(F.struct("pos", "t", "number")))
    got = rows.groupBy(id_col, "block").agg(parts.alias("p"))
    return got.select(id_col, "block", F.element_at("p", -1)["number"].alias("number"), F.concat_ws(" ", F.transform("p", lambda r: r["t"])).alias("body"))


def prefixed_blocks(docs: DataFrame, prefix: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block, title, body): a block without lower-case letters that starts with the prefix is the title, without the prefix, of those after it; other such blocks are text."""
    title = ~F.col("body").rlike("[a-z]") & F.col("body").startswith(prefix)
    w = Window.partitionBy(id_col).orderBy("block")
    named = text_blocks(docs, id_col, text).withColumn("title", F.last(F.when(title, F.trim(F.substr("body", F.lit(len(prefix) + 1)))), True).over(w))
    return named.where(~title).select(id_col, "block", "title", "body")


def indented_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block, title, body): lines are not stripped; a block whose first character is no space is the title of those after it."""
    rows = lines(docs, id_col, text).withColumn("has", F.col("line").rlike("[A-Za-z]"))
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("block", F.count_if(~F.col("has")).over(w)).where("has")
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"])
    blocks = rows.groupBy(id_col, "block").agg(F.concat_ws(" ", body).alias("body"))
    title = ~F.col("body").startswith(" ")
    named = blocks.withColumn("title", F.last(F.when(title, F.col("body")), True).over(Window.partitionBy(id_col).orderBy("block")))
    return named.where(~title).select(id_col, "block", "title", "body")
