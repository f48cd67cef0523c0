"""Verification of numbers in narratives, and budgets for what a narrator gets to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.claims import claims, fact_variants
from siftmill.functions.text import token_estimate
from siftmill.operators.nested import scalars

#: Budgets (fixed values): context less reply, and the least that is left.
CONTEXT, REPLY, LEAST_BUDGET, MIN_RATIO, DROPPED, PREVIEW = 2048, 500, 256, 0.5, 8, 80

#: What each level of compression keeps at most, level 0 keeping all (fixed values; None: all).
PROFILE_LADDER = {
    "numeric": (None, 6, 4, 2, 1, 1), "categorical": (None, 5, 3, 2, 1, 0), "values": (None, 4, 3, 2, 1, 1), "outliers": (None, 5, 3, 2, 1, 0),
    "pairs": (None, 4, 2, 1, 1, 0), "missing": (None, 4, 2, 1, 1, 0), "imbalance": (None, 4, 2, 1, 0, 0), "unique_counts": (None, 30, 15, 8, 0, 0),
    "names": (None, 10, 6, 3, 1, 1), "sample_rows": (None, None, None, 2, 1, 0),
}


def input_budget(stated: int | None = None, context: int = CONTEXT, reply: int = REPLY) -> int:
    """Tokens for a prompt: what is stated, or the context less the reply, but 256 at least."""
    return max(LEAST_BUDGET, context - reply if stated is None else stated)


# Facts and claims


def extracted_claims(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, pos, value, suffix): the numbers that texts state."""
    rows = df.select(id_col, F.posexplode(claims(F.col(text_col))).alias("pos", "c"))
    return rows.select(id_col, "pos", "c.value", "c.suffix")


def variants(facts: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """(*keys, fact): every form in which one of the facts may be restated, each once (for each key)."""
    return facts.select(*keys, F.explode(fact_variants(F.col(value).cast("double"))).alias("fact")).distinct()


def digest_facts(digests: DataFrame, *keys: str) -> DataFrame:
    """(*keys, fact): what digests (*keys, v VARIANT) allow to state: the forms of every number in them, however
    deep, and of the numbers that their texts state. Truth values are no numbers."""
    found = scalars(digests, *keys)
    numbers = found.where("numeric IS NOT NULL").select(*keys, F.col("numeric").alias("value"))
    stated = found.where("text IS NOT NULL").select(*keys, F.explode(claims(F.col("text"))).alias("c")).select(*keys, "c.value")
    return variants(numbers.union(stated).distinct(), *keys)


def verified_claims(found: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """found (.., *keys, value, suffix) with the column verified: whether a fact of the same keys is within a
    thousandth, or, of a claim with a scale, within 2 %. Without keys, whether any fact is; a claim with a
    null key isn't verified.

    An equi-join, not a product: facts and claims are put into bands of twice the tolerance's width
    (absolute ones, or of the logarithm), and a claim looks into its own band and its neighbours.
    Each (keys, value, suffix) is looked up once, however many rows make the claim.
    """
    f = facts.where("fact IS NOT NULL").select(*keys, "fact").distinct()
    band = lambda x: F.floor(x / 0.002).cast("long")
    log_band = lambda x: F.floor(F.log(F.abs(x)) / 0.05).cast("long")
    sign = lambda x: F.signum(x).cast("int")
    place = lambda kind, s, b: F.struct(F.lit(kind).alias("_k"), s.cast("int").alias("_s"), b.cast("long").alias("_b"))
    placed = lambda frame, places, *columns: frame.select(*keys, *columns, F.explode(places).alias("_p")).select(*keys, *columns, "_p.*")
    zero, fact, value = F.lit(0), F.col("fact"), F.col("value")
    scaled = F.col("suffix") != ""
    # A row lists all its places at once: facts and claims, which may come from whole tables, are read once for all.
    listed = placed(f, F.array_compact(F.array(
        F.when(fact == 0, place("z", zero, zero)), F.when(F.abs(fact) < 1e15, place("e", zero, band(fact))), F.when(fact != 0, place("r", sign(fact), log_band(fact))),
    )), "fact")
    asked = found.select(*keys, "suffix", "value").distinct()
    near = lambda kind, s, b: F.array(*(place(kind, s, b + i) for i in (-1, 0, 1)))
    looked = placed(asked, (
        F.when(~scaled & (F.abs(value) < 1e15), near("e", zero, band(value))).when(scaled & (value != 0), near("r", sign(value), log_band(value)))
        .when(scaled & (value == 0), F.array(place("z", zero, zero)))
    ), "suffix", "value")
    gap = F.abs(F.col("value") - F.col("fact"))
    same = F.when(F.col("_k") == "e", gap <= 1e-3).otherwise(gap <= 0.02 * F.abs("fact"))
    good = looked.join(listed, [*keys, "_k", "_s", "_b"]).where(same).select(*keys, "suffix", "value").distinct().withColumn("_good", F.lit(True))
    return found.join(good, [*keys, "suffix", "value"], "left").select(*found.columns, F.coalesce("_good", F.lit(False)).alias("verified"))


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, sentence, text): sentences end at ., ! or ? before white space."""
    return df.select(id_col, F.posexplode(F.split(F.col(text_col), r"(?<=[.!?])\s+")).alias("sentence", "text"))


def guarded_items(items: DataFrame, facts: DataFrame, *keys: str, text_col: str = "text", of: tuple[str, ...] = ()) -> DataFrame:
    """items with claims_found, claims_verified and kept: an item stays if all its claims are verified;
    an item without numbers always does. keys name an item, of those of them that facts have too."""
    at = F.struct(*keys)
    found = extracted_claims(items.select(at.alias("at"), F.col(text_col).alias("part")), "at", "part")
    checked = verified_claims(found.select("at", *(F.col(f"at.{k}").alias(k) for k in of), "value", "suffix"), facts, *of)
    per = checked.groupBy("at").agg(F.count("*").alias("claims_found"), F.count_if("verified").alias("claims_verified"))
    rows = items.withColumn("at", at).join(per, "at", "left").fillna(0, ["claims_found", "claims_verified"])
    return rows.select(*items.columns, "claims_found", "claims_verified", (F.col("claims_found") == F.col("claims_verified")).alias("kept"))


def guarded_texts(df: DataFrame, facts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, text, claims_found, claims_verified, dropped, status): texts without the sentences that
    state unverified numbers. Status: skipped without facts; pass without claims; fallback if under
    half of the claims hold or nothing is left; else guarded."""
    rows = guarded_items(sentences(df, id_col, text_col).withColumnRenamed("text", "part"), facts, id_col, "sentence", text_col="part")
    n, good = F.col("claims_found"), F.col("claims_verified")
    keep = F.when(n == good, F.struct("sentence", "part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["part"]), " ")
    lost = F.array_sort(F.collect_list(F.when(n != good, F.struct("sentence", F.left("part", F.lit(PREVIEW)).alias("part")))))
    whole = rows.groupBy(id_col).agg(text.alias("text"), F.sum(n).alias("claims_found"), F.sum(good).alias("claims_verified"), F.slice(F.transform(lost, lambda x: x["part"]), 1, DROPPED).alias("dropped"))
    any_fact = facts.limit(1).count() > 0
    status = (
        F.when(F.lit(not any_fact), "skipped").when(F.col("claims_found") == 0, "pass")
        .when((F.col("claims_verified") < MIN_RATIO * F.col("claims_found")) | ((F.size("dropped") > 0) & (F.trim("text") == "")), "fallback").otherwise("guarded")
    )
    return whole.withColumn("status", status)


# Whole summaries


#: A summary's lists in the order in which what they lose is reported, and the title that takes the place of one
#: with a wrong number (fixed values).
LISTS, NO_TITLE = ("key_findings", "anomalies_detected", "recommendations"), "General summary"
FIELDS = ("title", "executive_summary", "key_findings", "calculated_metrics", "anomalies_detected", "recommendations")
_PARTS = ("title", "executive_summary", *LISTS, "calculated_metrics")


def summary_parts(df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, part, place, name, text): a summary's title, the sentences of its executive_summary, the items of
    its lists and its numeric metrics (map<string,string>), each with an address: part (a number, in
    the order of a report) and place. Nulls have no part."""

    def of(part: str, texts: Column, names: Column | None = None) -> Column:
        at = F.lit(_PARTS.index(part))
        name = F.lit(part) if names is None else None
        return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x, i: F.struct(at.alias("part"), i.alias("place"), (name if names is None else F.concat(F.lit(f"{part}."), F.get(names, i))).alias("name"), x.alias("text")))

    split = F.split(F.coalesce("executive_summary", F.lit("")), r"(?<=[.!?])\s+")
    metrics = F.map_filter("calculated_metrics", lambda k, v: v.try_cast("double").isNotNull())
    every = F.concat(
        of("title", F.array("title")), of("executive_summary", split), *(of(c, F.col(c)) for c in LISTS),
        of("calculated_metrics", F.map_values(metrics), F.map_keys(metrics)),
    )
    return df.select(id_col, F.explode(every).alias("p")).select(id_col, "p.*").where("text IS NOT NULL")


def guarded_summaries(df: DataFrame, facts: DataFrame, anchors: DataFrame, id_col: str) -> DataFrame:
    """df's summaries (id_col, and FIELDS), each a row of its own id, held against the facts (id_col, fact) of their
    own digest, plus status, claims_found, claims_verified, claims_dropped and dropped (the first 8).

    A part stays if every number in it is a fact: a sentence, an item, a numeric metric; a title with a
    wrong one gives way to `General summary`. status: skipped without facts of this id, pass without
    claims (both leave the summary as it is); fallback, if under half of the claims hold, or nothing is
    left of an executive summary that lost parts: then the fields are the anchor's (id_col, FIELDS); else
    guarded. A null field is an empty one; a null id has no facts.
    """
    parts = guarded_items(summary_parts(df, id_col), facts, id_col, "part", "place", of=(id_col,))
    lost = F.when(F.col("part") == len(_PARTS) - 1, F.concat("name", F.lit(": "), "text")).otherwise(F.concat("name", F.lit(": "), F.left("text", F.lit(PREVIEW))))
    row = F.struct("part", "place", "kept", lost.alias("lost"), "text", F.substring_index("name", "calculated_metrics.", -1).alias("key"))
    per = parts.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("parts"), F.sum("claims_found").alias("claims_found"), F.sum("claims_verified").alias("claims_verified"))
    texts = lambda part: F.transform(F.filter("parts", lambda p: (p["part"] == _PARTS.index(part)) & p["kept"]), lambda p: p["text"])
    bad = F.transform(F.filter("parts", lambda p: (p["part"] == len(_PARTS) - 1) & ~p["kept"]), lambda p: p["key"])
    known = facts.select(id_col).distinct().withColumn("_facts", F.lit(True))
    rows = df.select(id_col, *FIELDS).join(per, id_col, "left").join(known, id_col, "left")
    anchor = anchors.select(id_col, *(F.col(c).alias(f"_{c}") for c in FIELDS), F.lit(True).alias("_anchor"))
    none = F.array().cast("array<string>")
    rows = rows.join(anchor, id_col, "left").fillna(0, ["claims_found", "claims_verified"])
    dropped = F.coalesce(F.transform(F.filter("parts", lambda p: ~p["kept"]), lambda p: p["lost"]), none)
    left = F.array_join(F.coalesce(texts("executive_summary"), none), " ")
    n, good = F.col("claims_found"), F.col("claims_verified")
    status = (
        F.when(F.col("_facts").isNull(), "skipped").when(n == 0, "pass")
        .when((good < MIN_RATIO * n) | ((F.size(dropped) > 0) & (F.trim(left) == "")), "fallback").otherwise("guarded")
    )
    rows = rows.withColumns({"_status": status, "_left": left, "_dropped": dropped})
    guarded = {
        "title": F.when(F.size(texts("title")) > 0, F.col("title")).otherwise(F.when(F.col("title").isNotNull(), NO_TITLE)), "executive_summary": F.col("_left"),
        "calculated_metrics": F.map_filter("calculated_metrics", lambda k, v: ~F.array_contains(bad, k)), **{c: texts(c) for c in LISTS},
    }
    checked = F.col("_status").isin("guarded", "fallback")
    shown = [
        F.when(F.col("_status") == "guarded", guarded[c]).when((F.col("_status") == "fallback") & F.col("_anchor"), F.col(f"_{c}")).when(F.col("_status") == "fallback", None).otherwise(F.col(c)).alias(c)
        for c in FIELDS
    ]
    tally = [F.when(checked, c).otherwise(0).alias(name) for c, name in ((n, "claims_found"), (good, "claims_verified"), (n - good, "claims_dropped"))]
    return rows.select(id_col, *shown, F.col("_status").alias("status"), *tally, F.when(checked, F.slice("_dropped", 1, DROPPED)).otherwise(none).alias("dropped"))


# Budgets


def ladder_sizes(facets: DataFrame, id_col: str, ladder: dict[str, tuple] = PROFILE_LADDER) -> DataFrame:
    """(id_col, level, chars, tokens): what is left of a digest on each level. facets: (id_col, facet,
    rank, text), rank from 1; a facet that the ladder doesn't name stays whole."""
    rows = [(f, level, limit) for f, limits in ladder.items() for level, limit in enumerate(limits)]
    limits = facets.sparkSession.createDataFrame(rows, "facet string, level int, most int")
    levels = facets.withColumn("level", F.explode(F.array(*map(F.lit, range(6)))))
    kept = levels.join(F.broadcast(limits), ["facet", "level"], "left").withColumn("chars", F.when(F.col("most").isNull() | (F.col("rank") <= F.col("most")), F.length("text")).otherwise(0))
    sizes = kept.groupBy(id_col, "level").agg(F.sum("chars").alias("chars"))
    return sizes.withColumn("tokens", F.ceil(F.col("chars") / 4.0))


def fitted_level(sizes: DataFrame, id_col: str, budget: int) -> DataFrame:
    """(id_col, level, tokens): the first level within the budget, or the last one."""
    fits = sizes.groupBy(id_col).agg(F.min(F.when(F.col("tokens") <= budget, F.col("level"))).alias("first"))
    level = fits.select(id_col, F.coalesce("first", F.lit(5)).alias("level"))
    return level.join(sizes.select(id_col, "level", "tokens"), [id_col, "level"])


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, tokens): estimates."""
    return df.select(id_col, token_estimate(F.col(text_col)).alias("tokens"))
