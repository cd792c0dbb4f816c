"""Changelog lines, context rows, links and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import declarations as D
from ..functions.naming import item_name, markup_to_html, plural
from .diff import delta_text
from .state import APIS, KINDS, ordinal

PER_TYPE, MOST_LINES = 4, 400
#: Types that need no context (fixed values).
PRIMITIVES = ("#", "int", "long", "string", "bytes", "double", "true", "false", "Bool", "int128", "int256", "X", "!X", "Object", "Type", "t")


def changelog_lines(diffs: DataFrame) -> DataFrame:
    """section (added, changed or removed) and line of every difference: the declaration, marked [e2e] in the secret api, with what changed."""
    section = F.when(F.col("change") == "new", "added").when(F.col("change") == "deleted", "removed").otherwise("changed")
    declared = D.declaration_line(F.col("name"), F.col("id"), F.col("params"), F.col("result"))
    line = F.concat(F.when(F.col("api") == "e2e", "[e2e] ").otherwise(""), declared, F.when(F.col("change") == "changed", F.concat(F.lit(" ("), delta_text(), F.lit(")"))).otherwise(""))
    return diffs.withColumns({"section": section, "line": line})


def page_items(diffs: DataFrame, scope: list[str]) -> DataFrame:
    """scope, section, item, name and text of a changelog page's lists: one item for a new or removed object; for a changed one an item for its fields and one for its result."""
    fields = F.concat_ws("; ", *[F.when(F.size(c) > 0, F.concat(F.lit(word), F.array_join(c, ", "))) for word, c in (("added ", "new_fields"), ("removed ", "removed_fields"))], F.when(F.size("changed_fields") > 0, F.concat(F.lit("changed "), F.array_join(F.transform("changed_fields", lambda f: F.concat(f["name"], F.lit(" from "), f["old_type"], F.lit(" to "), f["new_type"])), ", "))))
    item = lambda section, kind, text: F.struct(F.lit(section).alias("section"), F.lit(kind).alias("item"), text.alias("text"))
    result = F.concat(F.lit("from "), F.col("old_result"), F.lit(" to "), F.col("new_result"))
    items = F.array(
        F.when(F.col("change") == "new", item("added", "object", F.lit(""))), F.when(F.col("change") == "deleted", item("removed", "object", F.lit(""))),
        F.when((F.col("change") == "changed") & (fields != ""), item("changed", "fields", fields)), F.when(F.col("new_result").isNotNull(), item("changed", "result", result)),
    )
    return diffs.select(*scope, "name", F.inline(F.filter(items, lambda x: x.isNotNull()))).select(*scope, "section", "item", "name", "text")


def report_rows(lines: DataFrame, links: DataFrame, described: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the link of their id and the description of their name, where there are any."""
    return lines.join(links, [*keys, "id"], "left").join(described, "name", "left")


def stats_text() -> Column:
    return F.concat(plural(F.col("additions"), "addition"), F.lit(", "), plural(F.col("changes"), "change"), F.lit(", "), plural(F.col("deletions"), "deletion"))


def base_type(type_: Column) -> Column:
    """Without flag prefix and vectors, whatever the case of the word vector, and without ! and % before what is left."""
    bare = F.regexp_replace(F.trim(type_), r"^flags\d*\.\d+\?", "")
    opened = F.length(F.regexp_extract(bare, r"(?i)^((?:vector<)*)", 1)) / 7
    closed = F.length(F.regexp_extract(bare, r"(>*)$", 1))
    return F.regexp_replace(D.peeled(bare, F.least(opened, closed).cast("int")), "^[%!]+", "")


def context_rows(objects: DataFrame, diffs: DataFrame, scope: list[str], per_type: int = PER_TYPE, most: int = MOST_LINES) -> DataFrame:
    """Existing declarations of the types that new and changed objects use: the first `per_type` of each type, types in the order they are first used in, until `most` lines are there before a type.

    Used in the order of api, methods before constructors, pos; an object's result before its parameters. Primitives are left out.
    """
    w = Window.partitionBy(*scope, "result").orderBy(ordinal("api", APIS), ordinal("kind", KINDS), "pos")
    top = objects.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_type)
    types = F.concat(F.array("result"), F.transform("params", lambda p: p["type"]))
    used = diffs.where("change <> 'deleted'").select(*scope, ordinal("api", APIS).alias("a"), ordinal("kind", KINDS[::-1]).alias("k"), "pos", F.posexplode(types).alias("i", "t"))
    first = used.select(*scope, base_type(F.col("t")).alias("result"), F.struct("a", "k", "pos", "i").alias("at")).where(~F.col("result").isin(*PRIMITIVES)).groupBy(*scope, "result").agg(F.min("at").alias("at"))
    hit = top.join(first, [*scope, "result"])
    # a row for each type of a scope
    per = hit.groupBy(*scope, "result").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*scope).orderBy("at", "result").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = per.withColumn("before", before).where(F.col("before") < most).select(*scope, "result", "before")
    line = D.declaration_line(F.col("name"), F.col("id"), F.col("params"), F.col("result"))
    return hit.join(room, [*scope, "result"]).select(*scope, "result", (F.col("before") + F.col("turn") - 1).cast("long").alias("place"), line.alias("line"))


def described_names(items: DataFrame) -> DataFrame:
    """name, description of changelog items, cleaned; empty ones go, of a repeated name the last counts. items: name, description, pos."""
    rows = items.select(item_name(F.col("name")).alias("name"), markup_to_html(F.col("description")).alias("description"), "pos").where("name <> '' and description <> ''")
    return rows.groupBy("name").agg(F.max_by("description", "pos").alias("description"))


def reconcile(expected: DataFrame, described: DataFrame) -> DataFrame:
    """expected, described, mismatch: counts of new objects and of described names."""
    a = expected.agg(F.count_distinct("name").alias("expected"))
    b = described.agg(F.count_distinct("name").alias("described"))
    return a.crossJoin(b).withColumn("mismatch", F.col("expected") != F.col("described"))


def classify_files(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """path, action: create without a sha on record, else update."""
    j = incoming.join(existing.select("path", "sha"), "path", "left")
    return j.select("path", F.when(F.col("sha").isNull(), "create").otherwise("update").alias("action"))


def line_index(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line (from 1), id_hex of every declaration in a text; the last line of an id counts."""
    rows = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = rows.select(*keys, (F.col("pos") + 1).alias("line"), F.regexp_extract("raw", r"^\S+#([0-9a-f]+)", 1).alias("id_hex")).where("id_hex <> ''")
    return rows.groupBy(*keys, "id_hex").agg(F.max("line").alias("line"))
