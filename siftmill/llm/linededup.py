"""Line dedup by winnowing over line hashes, all in DataFrame functions.

A window is the shortest run of non-blank lines with `words` words or more that begins at a line, or
that ends at one. Its line with the smallest hash is its fingerprint, so two documents that share a
run of `words` words share fingerprints: every window inside the run has the same one in both.
Places of fingerprints that occur once only are settled there. The others are joined by what
surrounds them: each place is extended forwards (the windows that begin at or before it) and
backwards (those that end at or behind it) and compared by digests of all lines, so that places
meet by content, and no pairs of places are made, however many share a line. The first occurrence
of a content, by (document id, line number), stays.

That deletes whole runs: let lines a to b of a document be any common run of `words` words or more
with an earlier place. Each line of it from which `words` words are left before b begins a window
inside the run; each other line lies in the window that ends at b. All these are in the run, hence
matched, and nothing outside of such a run is.

Lines are compared without leading and trailing spaces. Words are what single spaces separate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.shared import bloom_filter, bloom_pass, bloom_split, checked_broadcast, fresh, stored

KEY = ["doc", "version"]
#: A content with more places than this goes to its places by broadcast, if there are few of its kind.
HOT = 1000


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, pos, words, hash, check) of each line that isn't blank; hash and check are 64 bits
    each. version tells apart rows of one id with different texts; rows that repeat wholly count once."""
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line != ''")
    words = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    return rows.select(*KEY, "pos", words.alias("words"), F.xxhash64("line").alias("hash"), F.xxhash64(F.lit("check"), "line").alias("check"))


def line_table(lines: DataFrame, words: int) -> DataFrame:
    """(doc, version, n, pos, forward, backward): each line with its number n among the document's lines,
    and the windows that begin and that end there: begin and end (line numbers), hash (the
    fingerprint's), new (whether the window before has another fingerprint) and content (128 bits of
    all lines). Where a document holds too few words for one, it is null."""
    order = Window.partitionBy(*KEY).orderBy("pos")
    placed = lines.withColumns({"stop": F.sum("words").over(order), "n": F.row_number().over(order)})
    placed = placed.withColumn("start", F.col("stop") - F.col("words"))
    ahead = Window.partitionBy(*KEY).orderBy("start").rangeBetween(Window.currentRow, words - 1)
    behind = Window.partitionBy(*KEY).orderBy("stop").rangeBetween(1 - words, Window.currentRow)

    def window(frame, far: Column, name: str) -> dict[str, Column]:
        content = F.array(F.xxhash64(F.collect_list("hash").over(frame)), F.xxhash64(F.collect_list("check").over(frame)))
        return {f"{name}_far": far.over(frame), f"{name}_held": F.sum("words").over(frame), f"{name}_least": F.min(F.struct("hash", "n")).over(frame), f"{name}_content": content}

    seen = placed.withColumns(window(ahead, F.max("n"), "f") | window(behind, F.min("n"), "b"))
    whole = {s: F.when(F.col(f"{s}_held") >= words, F.col(f"{s}_least.n")) for s in "fb"}
    new = {f"{s}_new": ~whole[s].eqNullSafe(F.lag(whole[s]).over(order)) for s in "fb"}
    seen = seen.withColumns(new)

    def made(s: str, begin: str, end: str) -> Column:
        fields = [F.col(begin).alias("begin"), F.col(end).alias("end"), F.col(f"{s}_least.hash").alias("hash"), F.col(f"{s}_new").alias("new"), F.col(f"{s}_content").alias("content")]
        return F.when(F.col(f"{s}_held") >= words, F.struct(*fields))

    return seen.select(*KEY, "n", "pos", made("f", "n", "f_far").alias("forward"), made("b", "b_far", "n").alias("backward"))


def fingerprints(table: DataFrame) -> DataFrame:
    """(doc, version, begin, end, content, item, new): all windows of both kinds; item names the kind and
    the fingerprint's hash. Each place of a fingerprint is new once for each kind."""
    each = F.explode(F.array(*(F.when(F.col(w).isNotNull(), F.struct(F.lit(w).alias("kind"), *(F.col(f"{w}.{c}").alias(c) for c in ("begin", "end", "hash", "new", "content")))) for w in ("forward", "backward"))))
    return table.select(*KEY, each.alias("w")).where("w IS NOT NULL").select(*KEY, "w.begin", "w.end", "w.content", F.xxhash64("w.kind", "w.hash").alias("item"), "w.new")


def matches(table: DataFrame) -> DataFrame:
    """(doc, version, begin, end): windows whose content occurs before, without an overlap."""
    each = fingerprints(table)
    again = stored(each.where("new").groupBy("item").agg(F.count("*").alias("places")).where("places > 1").select("item"))
    near = stored(bloom_pass(each, "item", bloom_filter(again, "item")).select("content", *KEY, "begin", "end"))
    place = F.struct(*KEY, "begin", "end")
    first = near.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count("*").alias("places")).where("first < final")
    first = stored(first.select("content", *(F.col(f"first.{c}").alias(f"{c}0") for c in (*KEY, "end")), "places"))
    # Contents with very many places are few: they go to their places, the others meet theirs.
    parts = [near.join(checked_broadcast(first.where(f"places > {HOT}")), "content"), near.join(first.where(f"places <= {HOT}"), "content")]
    found = parts[0].union(parts[1]).where("doc != doc0 OR version != version0 OR begin > end0")
    return found.select(*KEY, "begin", "end")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """(doc, version, pos): the lines to delete. df may be empty; null ids and texts have none."""
    # A document's lines come together once; windows and repeated rows need no further shuffle.
    lines = _lines(df, id_col, text_col).repartition(*KEY).dropDuplicates([*KEY, "pos"])
    table = stored(line_table(lines, words))
    starts = stored(matches(table).groupBy(*KEY, F.col("begin").alias("n")).agg(F.max("end").alias("reach")))
    # The furthest end of the windows that have begun decides whether a line is covered.
    bloom = bloom_filter(starts.select(F.xxhash64(*KEY).alias("item")), "item")
    own = bloom_pass(table.select(*KEY, "n", "pos", F.xxhash64(*KEY).alias("item")), "item", bloom)
    covered = F.max("reach").over(Window.partitionBy(*KEY).orderBy("n"))
    return own.join(starts, [*KEY, "n"], "left").withColumn("reach", covered).where("reach >= n").select(*KEY, "pos")


def _words_in(line: Column) -> Column:
    return F.length(F.trim(line)) - F.length(F.translate(F.trim(line), " ", "")) + 1


def _deleted(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, list[str]]:
    """df without the deleted lines, and the names of the columns lines, lines_removed and words_removed
    in it, which clash with none of df's."""
    gone = stored(repeated_lines(df, id_col, text_col, words))
    drop = stored(gone.groupBy(*KEY).agg(F.sort_array(F.collect_list("pos")).alias("gone")))
    doc, version, item, lost, split, *counts = fresh(df, "doc", "version", "item", "gone", "split", "lines", "lines_removed", "words_removed")
    text = F.col(text_col).cast("string")
    rows = df.withColumns({doc: F.col(id_col), version: F.xxhash64(text)}).withColumn(item, F.xxhash64(doc, version))
    # Only documents that may lose lines are shuffled to meet them.
    may, never = bloom_split(rows, item, bloom_filter(drop.select(F.xxhash64(*KEY).alias("item")), "item"))
    may = may.join(drop.toDF(doc, version, lost).hint("merge"), [doc, version], "left").select(*rows.columns, lost)
    rows = never.withColumn(lost, F.lit(None).cast("array<int>")).union(may).withColumn(split, F.split(text, "\n"))
    # The slices between deleted lines: work in proportion to the lines.
    ends = F.concat(F.col(lost), F.array(F.size(split)))
    begins = F.concat(F.array(F.lit(0)), F.transform(lost, lambda x: x + 1))
    parts = F.zip_with(begins, ends, lambda a, b: F.slice(split, a + 1, b - a))
    kept = F.when(F.col(lost).isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))
    removed = F.transform(lost, lambda x: F.element_at(split, x + 1))
    found = rows.select(
        *(F.col(c) if c != text_col else kept.alias(c) for c in df.columns),
        F.coalesce(F.size(F.filter(split, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(counts[1]),
        F.coalesce(F.aggregate(removed, F.lit(0), lambda s, x: s + _words_in(x)), F.lit(0)).cast("long").alias(counts[2]),
    )
    return found, counts


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """df with the later repeats of runs of `words` or more words deleted from its texts, plus the
    columns lines, lines_removed and words_removed (blank lines don't count), which take the place
    of columns of these names.

    Documents come in the order of their ids, a document's lines in theirs; within a document a
    repeat must not overlap the first occurrence. A null or empty text, a row with a null id, and
    a document without repeats stay as they are; a document of which nothing is left has an empty
    text. Rows that repeat wholly are one document and both stay. Other columns stay as they are.
    """
    found, counts = _deleted(df, id_col, text_col, words)
    names = ["lines", "lines_removed", "words_removed"]
    kept = [c for c in df.columns if c not in names]
    return found.select(*kept, *(F.col(c).alias(n) for c, n in zip(counts, names)))


def keep_new_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """dedup_lines in df's own columns; a document that loses its last line goes."""
    found, (lines, lost, _) = _deleted(df, id_col, text_col, words)
    return found.where(~((F.col(lost) > 0) & (F.col(lines) == F.col(lost)))).select(*df.columns)
