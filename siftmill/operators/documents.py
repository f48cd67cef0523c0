"""Structure of documents: lines, titles, sections, metrics, outlines, chunks.

A document's lines are rows; the state that a reader would carry from line to line (inside a code
fence, after a blank line, which section) is running sums and last values over windows by
document, so all documents work at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import HEADING, PAGE_MARKER, clip, is_plain_heading, normal_space, normal_text, paragraph_count, strip, word_count

#: Limits (fixed values).
MAP_REDUCE_CHARS, OUTLINE_CHARS, ANCHORED_SECTIONS, TITLE_CHARS = 12_000, 120, 40, 120
CHUNK_WORDS = (500, 800, 1000)


def cleaned(df: DataFrame, id_col: str, text_col: str, kind: Column | None = None) -> DataFrame:
    """(id_col, text): normalised texts with page markers blanked; null texts are left out."""
    lines = F.split(normal_text(F.col(text_col).cast("string"), kind), "\n")
    blanked = F.transform(lines, lambda x: F.when(x.rlike(PAGE_MARKER), "").otherwise(x))
    return df.select(id_col, F.array_join(blanked, "\n").alias("text")).where("text IS NOT NULL")


def document_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, i, raw, line, fence, code, prev_blank, heading, level, is_title, is_section): the lines of
    cleaned texts with what structure sees in them. A fence line is invisible to the others; a
    numbered-sign heading counts inside code too, a plain one only outside and not after a blank line."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("line", strip(F.col("raw")))
    lines = lines.withColumn("fence", F.startswith("line", F.lit("```")))
    before = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(id_col).orderBy("i")
    blank = F.when(~F.col("fence"), F.col("line") == "")
    lines = lines.withColumns({
        "code": F.coalesce(F.sum(F.col("fence").cast("int")).over(upto), F.lit(0)) % 2 == 1,
        "prev_blank": F.coalesce(F.last(blank, ignorenulls=True).over(before), F.lit(True)),
    })
    marked = F.col("line").rlike(HEADING) & ~F.col("fence")
    plain = ~F.col("fence") & ~F.col("code") & ~F.col("prev_blank") & is_plain_heading(F.col("line"))
    lines = lines.withColumns({
        "heading": F.when(marked, strip(F.regexp_extract("line", HEADING, 2))).when(plain, F.col("line")),
        "level": F.when(marked, F.length(F.regexp_extract("line", HEADING, 1))).when(plain, 3),
    })
    candidate = ~F.col("fence") & (F.col("heading").isNotNull() | ((F.col("line") != "") & (F.col("i") < 3)))
    first = F.min(F.when(candidate, F.col("i"))).over(Window.partitionBy(id_col))
    is_title = F.coalesce(F.col("i") == first, F.lit(False))
    return lines.withColumns({"is_title": is_title, "is_section": F.col("heading").isNotNull() & ~is_title})


def title_of_lines() -> Column:
    """The title among a document's lines, as an aggregate: the first heading, or the first 120 characters of an early
    line; may be null."""
    return F.max(F.when(F.col("is_title"), F.coalesce("heading", F.left("line", F.lit(TITLE_CHARS)))))


def document_titles(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, title) of documents' lines."""
    return lines.groupBy(id_col).agg(title_of_lines().alias("title"))


def document_sections(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, section, heading, level, line, text): sections in order from 1. A document without any has
    one of level 1 with its title (or `Document`) and its whole text."""
    # One shuffle by document: windows, sections and what stands for a document without any all use it.
    own = Window.partitionBy(id_col)
    begins = F.col("is_section").cast("int")
    lines = document_lines(docs, id_col).withColumns({"section": F.sum(begins).over(own.orderBy("i")), "sections": F.sum(begins).over(own)})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"]), "\n")
    found = lines.where("section > 0 OR sections = 0").groupBy(id_col, "section").agg(
        F.min_by("heading", "i").alias("heading"), F.min_by("level", "i").alias("level"), F.min("i").alias("line"), body.alias("body"), title_of_lines().alias("title"),
    )
    none = F.col("section") == 0
    return found.select(
        id_col, F.greatest("section", F.lit(1)).cast("long").alias("section"), F.when(none, F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Document"))).otherwise(F.col("heading")).alias("heading"),
        F.when(none, 1).otherwise(F.col("level")).alias("level"), "line", F.when(none, strip(F.col("body"))).otherwise(F.regexp_replace("body", r"^\n+|\n+$", "")).alias("text"),
    )


def document_metrics(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, title, word_count, char_count, section_count, paragraph_count, table_count, code_block_count,
    heading_count): a row for each document; table_count counts lines that start with | and have another."""
    lines = document_lines(docs, id_col)
    opens = F.col("fence") & F.col("code")
    table = ~F.col("fence") & ~F.col("code") & F.startswith("line", F.lit("|")) & F.contains(F.substring("line", 2, 1 << 30), F.lit("|"))
    title = title_of_lines()
    counts = lines.groupBy(id_col).agg(
        F.coalesce(F.when(title != "", title), F.lit("Untitled document")).alias("title"),
        F.greatest(F.count_if("is_section"), F.lit(1)).alias("section_count"), F.count_if(table).alias("table_count"), F.count_if(opens).alias("code_block_count"),
    )
    text = F.col("text")
    sizes = docs.select(id_col, word_count(text).cast("long").alias("word_count"), F.length(text).cast("long").alias("char_count"), paragraph_count(text).cast("long").alias("paragraph_count"))
    return sizes.join(counts, id_col).select(id_col, "title", "word_count", "char_count", "section_count", "paragraph_count", "table_count", "code_block_count", F.col("section_count").alias("heading_count"))


def document_outlines(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, outline): a line for each section, with the first 120 characters of its text."""
    line = F.concat(F.lit("- ["), F.col("level").cast("string"), F.lit("] "), "heading", F.lit(": "), F.left(normal_space(F.col("text")), F.lit(OUTLINE_CHARS)))
    parts = F.array_sort(F.collect_list(F.struct("section", line.alias("line"))))
    return sections.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("outline"))


def anchored_texts(sections: DataFrame, id_col: str = "doc_id", most: int = 20_000) -> DataFrame:
    """(id_col, anchored): the first sections under their headings, as long as all together keep to `most`
    characters (of the first 40); if not even one does, the start of the first one's text."""
    block = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "heading", F.lit("\n"), "text")
    order = Window.partitionBy(id_col).orderBy("section")
    blocks = sections.where(F.col("section") <= ANCHORED_SECTIONS).withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(order))
    kept = F.array_sort(F.collect_list(F.when(F.col("used") <= most, F.struct("section", "block"))))
    found = blocks.groupBy(id_col).agg(F.array_join(F.transform(kept, lambda x: x["block"]), "\n\n").alias("kept"), F.min_by("text", "section").alias("first"), F.size(kept).alias("n"))
    return found.select(id_col, F.when(F.col("n") > 0, F.col("kept")).otherwise(F.left("first", F.lit(most))).alias("anchored"))


def needs_map_reduce(text: Column, threshold: int = MAP_REDUCE_CHARS) -> Column:
    return F.length(text) > threshold


def fragments(sections: DataFrame, id_col: str = "doc_id", target: int = CHUNK_WORDS[1], most: int = CHUNK_WORDS[2]) -> DataFrame:
    """(id_col, at, heading, words, text): paragraphs under their section's heading; one of more than
    `most` words is cut into slices of `target` words."""
    paragraphs = sections.select(id_col, "section", "heading", F.posexplode(F.split("text", r"(?U)\n\s*\n")).alias("p", "paragraph")).withColumn("paragraph", strip(F.col("paragraph"))).where("paragraph != ''")
    words = F.regexp_extract_all("paragraph", F.lit(r"(?U)(\S+)"), 1)
    listed = paragraphs.withColumn("listed", words)
    steps = F.sequence(F.lit(0), F.size("listed") - 1, F.lit(target))
    slices = F.when(F.size("listed") <= most, F.array("paragraph")).otherwise(F.transform(steps, lambda s: F.array_join(F.slice("listed", s + 1, target), " ")))
    parts = listed.select(id_col, "section", "heading", "p", F.posexplode(slices).alias("s", "body"))
    text = F.concat(F.lit("## "), "heading", F.lit("\n"), "body")
    return parts.select(id_col, F.struct("section", "p", "s").alias("at"), "heading", text.alias("text")).withColumn("words", word_count(F.col("text")))


def chunks(sections: DataFrame, id_col: str = "doc_id", least: int = CHUNK_WORDS[0], target: int = CHUNK_WORDS[1], most: int = CHUNK_WORDS[2]) -> DataFrame:
    """(id_col, chunk, words, headings, text): fragments packed in order. A chunk ends before a fragment
    that would take it over `most` words, if it has `least` already. A document's fold is a native
    aggregate over its ordered fragments."""
    parts = F.array_sort(F.collect_list(F.struct("at", "words", "heading", "text")))
    docs = fragments(sections, id_col, target, most).groupBy(id_col).agg(parts.alias("parts"))
    one = "struct<words: int, headings: array<string>, text: string>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("now"))

    def step(state: Column, x: Column) -> Column:
        now = state["now"]
        full = now.isNotNull() & (now["words"] >= least) & (now["words"] + x["words"] > most)
        fresh = F.struct(x["words"].alias("words"), F.array(x["heading"]).alias("headings"), x["text"].alias("text"))
        grown = F.struct((now["words"] + x["words"]).alias("words"), F.array_union(now["headings"], F.array(x["heading"])).alias("headings"), F.concat(now["text"], F.lit("\n\n"), x["text"]).alias("text"))
        done = F.when(full, F.concat(state["done"], F.array(now))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full | now.isNull(), fresh).otherwise(grown).cast(one).alias("now"))

    packed = F.aggregate("parts", start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    rows = docs.select(id_col, F.posexplode(packed).alias("chunk", "c"))
    return rows.select(id_col, "chunk", F.col("c.words").cast("long").alias("words"), "c.headings", "c.text")


def deterministic_digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, title, overview, outline): what can be said of a document without a model: its metrics in
    a sentence, its outline, and the first 600 characters of its sections in normal spacing."""
    sections = document_sections(docs, id_col)
    start = anchored_texts(sections, id_col, 3000).select(id_col, clip(normal_space(F.col("anchored")), 600).alias("opening"))
    said = F.format_string("%s: %d words in %d section(s), %d paragraph(s).", "title", "word_count", "section_count", "paragraph_count")
    facts = document_metrics(docs, id_col).select(id_col, "title", said.alias("facts"))
    rows = facts.join(document_outlines(sections, id_col), id_col).join(start, id_col)
    return rows.select(id_col, "title", F.concat("facts", F.lit(" "), "opening").alias("overview"), "outline")
