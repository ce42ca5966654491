"""Persona files: front matter, sections, exemplars and rules, read as tables of lines.

files(path, text). Everything is relational: lines are exploded once, front matter and sections are runs of lines found by
running sums, and their bodies are ordered aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a normalized section heading must contain, and the section's column
SECTIONS = {"role_and_voice": "role", "review_priorities": "priorities", "style_exemplars": "exemplar", "do_not_touch": "do not touch", "comment_conventions": "comment"}


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("n", "line"))


def _marked(files: DataFrame) -> DataFrame:
    """Lines with `front`: inside the front matter, which opens with the first line and closes with the next rule."""
    order = Window.partitionBy("path").orderBy("n")
    rule = F.col("line") == "---"
    rows = _lines(files).withColumn("_rule", rule).withColumn("_opens", F.first(F.col("line") == "---").over(order)).withColumn("_rules", F.sum(rule.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    closed = F.max("_rules").over(Window.partitionBy("path")) >= 2
    rows = rows.withColumn("_front", F.col("_opens") & closed & ((F.col("_rules") == 1) | ((F.col("_rules") == 2) & F.col("_rule"))))
    return rows.select("path", "n", "line", "_rule", F.col("_front").alias("front"))


def front_matter(files: DataFrame) -> DataFrame:
    """path, key, value: scalars, and folded blocks joined by spaces."""
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    key = F.regexp_extract("line", r"\A([A-Za-z0-9_]+):\s?.*\z", 1)
    rows = _marked(files).filter("front and not _rule").withColumn("_key", key).withColumn("_field", F.sum((key != "").cast("int")).over(order)).filter("_field > 0")
    own = F.regexp_extract("line", r"\A[A-Za-z0-9_]+:\s?(.*)\z", 1)
    head = F.min_by(F.struct(F.col("_key").alias("k"), own.alias("v")), "n")
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_key") == "", F.struct("n", F.trim("line").alias("s"))))), lambda x: x["s"]), " ")
    out = rows.groupBy("path", "_field").agg(head.alias("h"), folded.alias("folded"))
    block = F.col("h.v").isin(">-", "|-", "|", ">", "")
    value = F.when(block, F.trim("folded")).otherwise(F.trim("h.v"))
    latest = out.select("path", F.col("h.k").alias("key"), value.alias("value"), "_field")
    return latest.groupBy("path", "key").agg(F.max_by("value", "_field").alias("value"))


def sections(files: DataFrame) -> DataFrame:
    """path, section_no (0 for the title's), heading, body: the first top heading is the title."""
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    level = F.length(F.regexp_extract("line", r"\A(#{1,6})\s+.*\z", 1))
    rows = _marked(files).filter("not front").withColumn("_level", level).withColumn("_section", F.sum((level > 0).cast("int")).over(order)).filter("_section > 0")
    rows = rows.withColumn("_tops", F.sum((F.col("_level") == 1).cast("int")).over(order)).withColumn("_title", (F.col("_level") == 1) & (F.col("_tops") == 1))
    heading = F.min_by(F.trim(F.regexp_replace("line", r"\A#{1,6}\s+", "")), "n")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_level") == 0, F.struct("n", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("path", F.col("_section").alias("section_no")).agg(heading.alias("heading"), F.regexp_replace(body, r"\A\s+|\s+\z", "").alias("body"), F.max("_title").alias("is_title"))


def normalized_heading(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def exemplars(text: Column) -> Column:
    """Before-and-after pairs, or one raw entry where any block isn't a pair."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"\A\s+|\s+\z", "")), lambda b: b != "")
    shape = r"(?is)\A(?:[-*]\s*)?before:\s*(.*?)\n(?:[-*]\s*)?after:\s*(.*)\z"
    pick = lambda b, i: F.regexp_replace(F.regexp_extract(b, shape, i), r"\A\s+|\s+\z", "")
    none = F.lit(None).cast("string")
    pairs = F.transform(blocks, lambda b: F.struct(pick(b, 1).alias("before"), pick(b, 2).alias("after"), none.alias("raw")))
    whole = F.array(F.struct(none.alias("before"), none.alias("after"), text.alias("raw")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.slice(whole, 1, 0)).when(F.forall(blocks, lambda b: F.rlike(b, F.lit(shape))), pairs).otherwise(whole)


def rules(text: Column) -> Column:
    """Lines without their bullets or numbers; blank ones go."""
    bare = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\A\s*(?:[-*]|\d+[.)])\s*", "")))
    return F.filter(bare, lambda s: s != "")


def personas(files: DataFrame) -> DataFrame:
    """One row per file: name, the five sections, assistant_url and a warning per missing section."""
    found = sections(files)
    named = F.when(~F.col("is_title"), normalized_heading(F.col("heading")))
    picked = [F.min_by(F.when(F.contains(named, F.lit(m)), F.col("body")), F.when(F.contains(named, F.lit(m)), F.col("section_no"))).alias(c) for c, m in SECTIONS.items()]
    title = F.max(F.when(F.col("is_title"), F.col("heading"))).alias("_title")
    rows = files.select("path").join(found.groupBy("path").agg(*picked, title), "path", "left")  # sections are found once for both
    fields = front_matter(files).groupBy("path").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_{k}") for k in ("name", "assistantUrl")])
    file_name = F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.md\z", "")
    out = rows.join(fields, "path", "left")
    warnings = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"Missing section: {c}")) for c in SECTIONS]), lambda w: w.isNotNull())
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "path",
        F.coalesce(F.nullif("_name", F.lit("")), "_title", file_name).alias("name"),
        text("role_and_voice").alias("role_and_voice"),
        text("review_priorities").alias("review_priorities"),
        exemplars(F.col("style_exemplars")).alias("style_exemplars"),
        F.coalesce(rules(F.col("do_not_touch")), F.array().cast("array<string>")).alias("do_not_touch"),
        text("comment_conventions").alias("comment_conventions"),
        F.col("_assistantUrl").alias("assistant_url"),
        warnings.alias("warnings"),
    )
