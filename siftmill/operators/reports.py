"""Profiles of the tables inside nested reports, thousands of small ones or a few large ones in one pass,
and summaries of reports.

A report's rows are those of nested.report_rows: cells of (report, section, path). Every facet is
computed for all groups at once: kinds and categories from one frequency table, moments from one
aggregation, medians from brackets, so neither many reports nor one that holds most rows make a
job or a task of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators import columns as C
from siftmill.operators import nested as N
from siftmill.operators import semantics as M
from siftmill.operators.guard import fitted_level
from siftmill.sources.scratch import kept

#: Caps of a section's profile (fixed values): columns and values of categories, numeric columns.
CATEGORY_COLUMNS, CATEGORY_VALUES, NUMERIC_COLUMNS = 5, 5, 6
#: Sections of fewer records have their medians from one aggregation: a rank's error, at most RANKS ** -1 of the
#: number of values, is none there (fixed values).
FEW_RECORDS, RANKS = 2_500, 10_000
#: Fields that name a report and that describe it, the first found wins (fixed values).
NAMING = ("info.title", "title", "report_title", "name", "company")
DESCRIBING = ("description", "info.description", "summary", "info.summary")
#: Sections that list what is open and what comes next, and meanings of columns too general to be told (fixed values).
OPEN, NEXT = ("issues", "risks", "problems"), ("next_steps", "next steps", "plan", "todo")
GENERIC = ("other detail", "temperature / physical reading", "status / category info")
#: How many fields, tokens and items a sentence lists, and the longest value that is listed (fixed values).
FIELDS, TOKENS, ITEMS, VALUE_CHARS = 8, 6, 8, 60

#: Fields that tell most, in order (fixed values); the others come after them.
TELLING = ("title", "description", "info.title", "info.description", "name", "info.EpisodeId", "configuration.episodeSteps")
#: What each level of compression keeps at most of a report's digest, level 0 keeping all (fixed values; None: all).
LADDER = {
    "fields": (None, 18, 14, 12, 10, 8), "sections": (None, 6, 5, 4, 3, 2), "columns": (None, 4, 3, 2, 1, 1), "values": (None, 3, 3, 2, 2, 1),
    "numeric": (None, 5, 4, 3, 2, 1), "tokens": (None, 8, 6, 5, 4, 3), "findings": (None, 2, 2, 1, 1, 0), "counts": (None, 8, 6, 5, 4, 3),
    "summary_chars": (None, 220, 160, 120, 90, 0), "section_fields": (None, 10, 8, 6, 4, 3),
}


def section_columns(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, section, path, bucket, records, filled, distinct) of the columns of tables: numeric if all values
    are numbers; else text if they are longer than 60 characters on average or over half as many as the
    section's records are distinct (null, where a record has none, being one); else categorical."""
    size = rows.where("kind = 'table'").groupBy(id_col, "section").agg(F.sum("record").alias("records"))
    unsigned = F.when(F.col("numeric") == 0, F.ltrim("value", F.lit("-"))).otherwise(F.col("value"))  # 0.0 and -0.0 are one value
    f = rows.where("kind = 'cell'").groupBy(id_col, "section", "path", unsigned.alias("value")).agg(F.count("*").alias("n"), F.count("numeric").alias("numbers"))
    held = F.when(F.col("value").isNotNull(), F.col("n"))
    per = f.groupBy(id_col, "section", "path").agg(
        F.coalesce(F.sum(held), F.lit(0)).alias("filled"), F.count("value").alias("values"), F.sum("numbers").alias("numbers"), F.sum(F.length("value") * held).alias("chars"),
    )
    per = per.join(size, [id_col, "section"])
    distinct = F.col("values") + (F.col("filled") < F.col("records")).cast("int")
    text = (F.coalesce(F.try_divide("chars", "filled"), F.lit(0)) > C.TEXT_LENGTH) | (distinct > C.TEXT_SHARE * F.col("records"))
    bucket = F.when((F.col("filled") > 0) & (F.col("numbers") == F.col("filled")), "numeric").when(text, "text").otherwise("categorical")
    return per.select(id_col, "section", "path", bucket.alias("bucket"), "records", "filled", distinct.alias("distinct"))


def section_categories(rows: DataFrame, id_col: str, columns: DataFrame | None = None, most: int = CATEGORY_COLUMNS, k: int = CATEGORY_VALUES) -> DataFrame:
    """(id_col, section, path, unique, place, value, count, rank): the k most frequent values of each of a section's
    `most` categorical columns with the most values. Ties by value and by path; null is no value."""
    columns = section_columns(rows, id_col) if columns is None else columns
    wanted = columns.where("bucket = 'categorical' AND filled > 0").select(id_col, "section", "path", (F.col("distinct") - (F.col("filled") < F.col("records")).cast("int")).alias("unique"))
    place = F.row_number().over(Window.partitionBy(id_col, "section").orderBy(F.desc("unique"), "path"))
    wanted = wanted.withColumn("place", place).where(F.col("place") <= most)
    f = rows.where("kind = 'cell' AND value IS NOT NULL").groupBy(id_col, "section", "path", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(id_col, "section", "path").orderBy(F.desc("count"), "value"))
    found = f.join(wanted, [id_col, "section", "path"]).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(id_col, "section", "path", "unique", "place", "value", "count", "rank")


def section_numbers(rows: DataFrame, id_col: str, columns: DataFrame | None = None, most: int | None = NUMERIC_COLUMNS) -> DataFrame:
    """(id_col, section, path, min, max, mean, median, std, cv, rank) of a section's `most` numeric columns that vary
    most (all, if None), to 4 places; cv as in columns.numeric_stats; ties by path."""
    columns = section_columns(rows, id_col) if columns is None else columns
    by = [id_col, "section", "path"]
    values = rows.where("kind = 'cell' AND numeric IS NOT NULL AND NOT isnan(numeric)").select(*by, F.col("numeric").alias("value"))
    middle = F.percentile_approx("value", [0.5, 0.5 + 1 / RANKS], RANKS)  # ranks n / 2 and n / 2 + 1, or (n + 1) / 2 twice
    found = values.groupBy(*by).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), middle.alias("m"))
    found = found.withColumn("median", (F.col("m")[0] + F.col("m")[1]) / 2).join(columns.where("bucket = 'numeric'").select(*by), by)
    # A path has at most one value a record.
    long = rows.where("kind = 'table'").groupBy(id_col, "section").agg(F.sum("record").alias("n")).where(F.col("n") >= FEW_RECORDS).select(id_col, "section")
    if not long.isEmpty():
        ranked = C.ranked_values(values.join(long, [id_col, "section"], "left_semi"), by, {"median": 0.5}).select(*by, ((F.col("low") + F.col("high")) / 2).alias("exact"))
        found = found.join(ranked, by, "left").withColumn("median", F.coalesce("exact", "median"))
    found = found.select(*by, *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")))
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).when(F.col("std").isNull(), F.lit(0.0)).otherwise(F.col("std") / F.abs("mean"))
    rank = F.row_number().over(Window.partitionBy(id_col, "section").orderBy(F.desc("cv"), "path"))
    ranked = found.withColumn("cv", cv).withColumn("rank", rank)
    return ranked if most is None else ranked.where(F.col("rank") <= most)


# Summaries


def _listed(frame: DataFrame, keys: list[str], order: list[str], text: Column, most: int | None = None) -> DataFrame:
    """(*keys, listed): the first `most` texts of each group, in order, with commas."""
    if most is not None:
        frame = frame.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= most)
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_text"))))
    return frame.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["_text"]), ", ").alias("listed"))


def _first(fields: DataFrame, id_col: str, names: tuple[str, ...], into: str) -> DataFrame:
    """(id_col, into): the value of the first of the fields that a report has."""
    table = fields.sparkSession.createDataFrame(list(enumerate(names)), "place int, path string")
    return fields.join(F.broadcast(table), "path").where("value IS NOT NULL AND value != ''").groupBy(id_col).agg(F.min_by("value", "place").alias(into))


def report_statements(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, part, place, section, text): what can be said of each report, a sentence each; part is summary,
    finding or recommendation. Markers of structure are no values; meanings too general aren't told."""
    columns = section_columns(rows, id_col)
    fields = rows.where("kind = 'field'").select(id_col, "path", "value").distinct().where(~F.coalesce(F.col("value").rlike(r"^\[.*\]$"), F.lit(False)))
    sections = N.report_sections(rows, id_col)
    values = N.report_values(rows, id_col)
    said = lambda df, part, place, text, section=F.lit(""): df.select(id_col, F.lit(part).alias("part"), F.lit(place).alias("place"), section.alias("section"), text.alias("text"))
    pair = F.concat("path", F.lit(" = "), F.coalesce("value", F.lit("none")))
    described = _first(fields, id_col, DESCRIBING, "about")
    bare = fields.join(described, id_col, "left_anti")
    counted = F.concat(F.col("count").cast("string"), F.when(F.col("kind") == "table", " records in ").when(F.col("kind") == "list", " entries in ").otherwise(" object in "), "section")
    per, word = [id_col, "section"], F.concat("value", F.lit(" ×"), F.col("count").cast("string"))
    top = section_categories(rows, id_col, columns).where((F.length("value") <= VALUE_CHARS) & ~F.contains("value", F.lit("[")))
    # Stored, for rules to be held against each name once: what filters phrases would else be pushed down to every cell.
    names = kept(rows.where("kind = 'cell'").select("path").distinct().select("path", M.phrase_of(M.role_of(F.col("path"))).alias("phrase")))
    meant = columns.join(names.where(~F.lower("phrase").isin(*GENERIC)), "path")
    number = F.concat("path", F.lit(" from "), F.col("min").cast("string"), F.lit(" to "), F.col("max").cast("string"), F.lit(" around "), F.col("median").cast("string"))
    short = sections.withColumn("name", F.lower("section"))
    parts = [
        said(described, "summary", 0, F.trim("about")),
        said(_listed(bare, [id_col], ["path"], pair, FIELDS), "summary", 1, F.concat(F.lit("Known of it: "), "listed", F.lit("."))),
        said(_listed(sections, [id_col], ["section"], counted), "summary", 2, F.concat(F.lit("It is made up of "), "listed", F.lit("."))),
        said(_listed(values.where("kind = 'token'"), per, ["rank"], word, TOKENS), "finding", 0, F.concat("section", F.lit(" repeats the tokens "), "listed", F.lit(".")), F.col("section")),
        said(_listed(values.where("kind = 'item'"), per, ["rank"], word, ITEMS), "finding", 1, F.concat("section", F.lit(" lists "), "listed", F.lit(".")), F.col("section")),
        said(_listed(top, [*per, "path", "unique"], ["rank"], word), "finding", 2, F.concat("section", F.lit("."), "path", F.lit(" takes "), F.col("unique").cast("string"), F.lit(" values, most often "), "listed", F.lit(".")), F.col("section")),
        said(_listed(section_numbers(rows, id_col, columns), per, ["rank"], number), "finding", 3, F.concat("section", F.lit(" measures "), "listed", F.lit(".")), F.col("section")),
        said(_listed(meant, per, ["path"], F.concat("path", F.lit(" as "), F.lower("phrase"))), "finding", 4, F.concat("section", F.lit(" holds "), "listed", F.lit(".")), F.col("section")),
        said(short.where(F.col("name").isin(*OPEN) & (F.col("kind") == "list") & (F.col("count") > 0)), "recommendation", 0, F.format_string("Settle what %s names: %d in all.", "section", "count"), F.col("section")),
        said(short.where(F.col("name").isin(*NEXT)), "recommendation", 1, F.format_string("Take up what %s sets out: %d in all.", "section", "count"), F.col("section")),
    ]
    return reduce(DataFrame.union, parts)


def report_summaries(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, title, executive_summary, key_findings, calculated_metrics, anomalies_detected, recommendations, fields,
    sections), a row for each report: its statements, and the counts behind them."""
    fields = rows.where("kind = 'field'").select(id_col, "path", "value").distinct()
    sections = N.report_sections(rows, id_col)
    reports = rows.select(id_col).distinct()
    of = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("place", "section", "text")))), lambda x: x["text"])
    told = report_statements(rows, id_col).groupBy(id_col).agg(*(of(p).alias(p) for p in ("summary", "finding", "recommendation")))
    sizes = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("count."), "section").alias("key"), F.col("count").cast("string").alias("value"))))
    wide = F.array_sort(F.collect_list(F.when(F.col("kind") == "table", F.struct(F.concat(F.lit("columns."), "section").alias("key"), F.col("columns").cast("string").alias("value")))))
    counts = sections.groupBy(id_col).agg(F.count("*").alias("sections"), F.concat(sizes, wide).alias("metrics"))
    found = (
        reports.join(fields.groupBy(id_col).agg(F.count_distinct("path").alias("fields")), id_col, "left").join(_first(fields, id_col, NAMING, "named"), id_col, "left")
        .join(told, id_col, "left").join(counts, id_col, "left").fillna(0, ["fields", "sections"])
    )
    none = F.array().cast("array<string>")
    metrics = F.map_from_entries(F.concat(
        F.array(*(F.struct(F.lit(name).alias("key"), F.col(c).cast("string").alias("value")) for name, c in (("top_level_fields", "fields"), ("sections", "sections")))),
        F.coalesce("metrics", F.array().cast("array<struct<key: string, value: string>>")),
    ))
    title = F.coalesce(F.concat(F.lit("Report: "), "named"), F.format_string("Report with %d fields and %d sections", "fields", "sections"))
    return found.select(
        id_col, title.alias("title"), F.array_join(F.coalesce("summary", none), " ").alias("executive_summary"), F.coalesce("finding", none).alias("key_findings"), metrics.alias("calculated_metrics"),
        none.alias("anomalies_detected"), F.coalesce("recommendation", none).alias("recommendations"), "fields", "sections",
    )


# Digests within a budget


def digest_pieces(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, facet, section, place, rank, text): the pieces of a report's digest. section is the place of a piece's
    section among the report's, 0 for what belongs to none; place and rank are what the ladder's limits
    are held against, rank being that of a value in its column."""
    columns = section_columns(rows, id_col)
    fields = rows.where("kind = 'field'").select(id_col, "path", "value").distinct()
    sections = N.report_sections(rows, id_col).withColumn("order", F.row_number().over(Window.partitionBy(id_col).orderBy("section")))
    telling = rows.sparkSession.createDataFrame(list(enumerate(TELLING)), "first int, path string")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.coalesce("first", F.lit(len(TELLING))), "path"))
    titles = fields.join(F.broadcast(telling), "path", "left").withColumn("place", place)
    at = sections.select(id_col, "section", "order")
    inner = fields.select(id_col, F.substring_index("path", ".", 1).alias("section"), "path").where("path != section").join(sections.where("kind = 'object'").select(id_col, "section"), [id_col, "section"], "left_semi")
    inner = inner.withColumn("place", F.row_number().over(Window.partitionBy(id_col, "section").orderBy("path")))
    values = N.report_values(rows, id_col)
    told = report_statements(rows, id_col)
    found = told.where("part = 'finding'").withColumn("n", F.row_number().over(Window.partitionBy(id_col, "section").orderBy("place", "text")))
    zero, dot = F.lit(0), F.lit(".")

    def pieces(frame: DataFrame, facet: str, text: Column, place: Column, rank: Column = zero, owned: bool = True) -> DataFrame:
        frame = frame.select(id_col, *(["section"] if owned else []), F.lit(facet).alias("facet"), place.cast("int").alias("place"), rank.cast("int").alias("rank"), text.alias("text"))
        order = F.col("order") if owned else zero
        return (frame.join(at, [id_col, "section"]) if owned else frame).select(id_col, "facet", order.cast("int").alias("section"), "place", "rank", "text")

    count = F.col("count").cast("string")
    valued = F.concat("value", F.lit(" ×"), count)
    number = F.concat("section", dot, "path", F.lit(": "), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("min", "median", "mean", "max"))))
    return reduce(DataFrame.union, [
        pieces(titles, "fields", F.concat("path", F.lit(": "), F.coalesce("value", F.lit("none"))), F.col("place"), owned=False),
        pieces(told.where("part = 'summary' AND place = 0"), "summary_chars", F.col("text"), zero, owned=False),
        pieces(sections.drop("order"), "sections", F.concat("section", F.lit(": "), "kind", F.lit(" of "), count), zero),
        pieces(inner, "section_fields", F.col("path"), F.col("place")),
        pieces(section_categories(rows, id_col, columns), "columns", F.concat("section", dot, "path", F.lit(": "), valued), F.col("place"), F.col("rank")),
        pieces(section_numbers(rows, id_col, columns), "numeric", number, F.col("rank")),
        pieces(values.where("kind = 'token'"), "tokens", F.concat("section", F.lit(": "), valued), F.col("rank")),
        pieces(values.where("kind = 'item'"), "counts", F.concat("section", F.lit(": "), valued), F.col("rank")),
        pieces(found, "findings", F.col("text"), F.col("n")),
    ])


def _limit(name: str, level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("int") for x in LADDER[name])), level + 1)


def _at_level(level: Column) -> Column:
    """What a level leaves of a piece, null if nothing."""
    within = lambda x, name: F.coalesce(x <= _limit(name, level), F.lit(True))
    own = F.lit(True)
    for facet in LADDER:
        if facet not in ("sections", "values", "summary_chars"):
            own = F.when(F.col("facet") == facet, within(F.col("place"), facet)).otherwise(own)
    own = own & ((F.col("facet") != "columns") | within(F.col("rank"), "values")) & within(F.col("section"), "sections")
    cut = F.coalesce(F.left("text", _limit("summary_chars", level)), F.col("text"))
    left = F.when(F.col("facet") == "summary_chars", cut).otherwise(F.col("text"))
    return F.when(own & (left != ""), left)


def digest_levels(pieces: DataFrame, id_col: str) -> DataFrame:
    """(id_col, level, pieces, chars, tokens): what is left of each report's digest on each level, all in one pass:
    a row for each report and level, whatever the number of pieces."""
    every = range(len(next(iter(LADDER.values()))))
    left = {level: _at_level(F.lit(level)) for level in every}
    sums = pieces.groupBy(id_col).agg(*(f.alias(f"{n}{i}") for i, x in left.items() for n, f in (("pieces", F.count(x)), ("chars", F.coalesce(F.sum(F.length(x)), F.lit(0))))))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"pieces{i}").alias("pieces"), F.col(f"chars{i}").alias("chars")) for i in every)))
    return sums.select(id_col, rows.alias("r")).select(id_col, "r.*").withColumn("tokens", F.ceil(F.col("chars") / 4.0))


def fitted_digests(pieces: DataFrame, id_col: str, budget: int) -> DataFrame:
    """(id_col, level, tokens, digest): each report's digest on the first level that keeps to the budget (the last, if
    none does), a line a piece."""
    fits = fitted_level(digest_levels(pieces, id_col), id_col, budget)
    rows = pieces.join(fits, id_col).withColumn("left", _at_level(F.col("level")))
    line = F.when(F.col("left").isNotNull(), F.struct("section", "facet", "place", "rank", "left"))
    return rows.groupBy(id_col, "level", "tokens").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["left"]), "\n").alias("digest"))
