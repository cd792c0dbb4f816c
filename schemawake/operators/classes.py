"""Class tables: filters, inherited members, and objects made of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import declarations as D
from ..functions.ids import is_placeholder
from ..functions.naming import LEGACY, class_name, java_type, param_name
from ..scratch import discard, saved

#: Fixed member names that tell what a class is.
ID_MEMBER, RESPONSE, READERS = "constructor", "deserializeResponse", ("TLdeserialize", "readParams", "serializeToStream")
#: Fixed pattern of class names that may be a number of another class.
NUMBERED = r"^\S+[^0-9p][0-9]+$"


def without_legacy(classes: DataFrame) -> DataFrame:
    return classes.where(~F.col("class").rlike(LEGACY))


def without_numbered(classes: DataFrame) -> DataFrame:
    """Drops a class whose name ends in digits when the name without them is a class of the corpus."""
    numbered = F.col("class").rlike(NUMBERED)
    bases = classes.select(F.col("class").alias("_base")).distinct()
    rows = classes.withColumn("_base", F.when(numbered, F.regexp_replace("class", "[0-9]+$", "")))
    return rows.join(bases, "_base", "left_anti").select(*classes.columns)


def class_kind(functions):
    """method, constructor, bare or skip, by which functions a class has (an array of names)."""
    has = lambda f: F.array_contains(functions, f)
    return F.when(has(RESPONSE), "method").when(has(READERS[1]), "constructor").when(has(READERS[2]), "bare").otherwise("skip")


def ancestors(classes: DataFrame) -> DataFrame:
    """class, ancestor, depth (0: itself), by joins that double the distance: their number grows with the logarithm of the deepest chain.

    In a cycle each class has every other one once, at its least depth.
    """
    links = classes.where("parent is not null").select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    known = saved(classes.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth")).distinct().unionByName(links.where("class <> ancestor")), "ancestors")
    jump, n = saved(links, "jump"), known.count()
    while not jump.isEmpty():
        # what lies `step` levels up, and what is known from there
        far = jump.select("class", F.col("ancestor").alias("_at"), F.col("depth").alias("_step"))
        beyond = far.join(known.withColumnRenamed("class", "_at"), "_at").select("class", "ancestor", (F.col("depth") + F.col("_step")).alias("depth"))
        wider = saved(known.unionByName(beyond).groupBy("class", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
        further = saved(far.join(jump.withColumnRenamed("class", "_at"), "_at").select("class", "ancestor", (F.col("depth") + F.col("_step")).alias("depth")), "jump")
        discard(known, jump)
        known, jump, before = wider, further, n
        n = known.count()
        if n == before:
            break
    discard(jump)
    return known


def inherited_members(classes: DataFrame, members: DataFrame) -> DataFrame:
    """class, member, value, depth: the nearest definition of every member. members: class, member, value.

    Pointer doubling on what is found, not on the ancestors: after t rounds each class has the nearest definitions among itself and its first 2**t - 1
    ancestors and a pointer to the one 2**t up, from which it takes what it lacks; what a nearer class defines is left out in every
    round, so no table is larger than the result. A round that finds nothing is the last, also in a cycle. Of several definitions of a member in one class, or at one distance, the least value counts.
    """
    found = saved(members.join(classes.select("class").distinct(), "class", "left_semi").groupBy("class", "member").agg(F.min("value").alias("value"), F.lit(0).alias("depth")), "found")
    jump = saved(classes.where("parent is not null").select("class", F.col("parent").alias("at")).distinct(), "jump")
    n, step = found.count(), 1
    while not jump.isEmpty():
        # what the class at the end of each pointer has, and that class's pointer
        above = found.select(F.col("class").alias("at"), "member", "value", (F.col("depth") + step).alias("depth"))
        both = found.unionByName(jump.join(above, "at").select(*found.columns))
        wider = saved(both.groupBy("class", "member").agg(F.min(F.struct("depth", "value")).alias("d")).select("class", "member", "d.value", "d.depth"), "found")
        further = saved(jump.join(jump.select(F.col("class").alias("at"), F.col("at").alias("_to")), "at").select("class", F.col("_to").alias("at")).distinct(), "jump")
        discard(found, jump)
        found, jump, step, before, n = wider, further, step * 2, n, wider.count()
        if n == before:
            break
    discard(jump)
    return found


def objects_from_classes(classes: DataFrame, layer: int) -> DataFrame:
    """pkg, class, kind, id, name, name_layer, result, params of the classes that are objects.

    classes: pkg, class, parent, id (null without one), functions (array of names), fields (array of structs name, type, nesting).
    Legacy, numbered, id-less and placeholder classes go, as do those of an older layer than the snapshot's.
    """
    rows = without_numbered(without_legacy(classes)).where("id is not null").where(~is_placeholder(F.col("id")))
    rows = rows.withColumns({"kind": class_kind(F.col("functions")), "_n": class_name(F.col("class"), F.col("pkg")), "_r": class_name(F.coalesce("parent", F.lit("TLObject")), F.col("pkg"), True)}).where("kind <> 'skip'")
    rows = rows.where(~((F.lit(layer) > F.col("_n.layer")) & (F.col("_n.layer") != 0)))
    params = F.transform("fields", lambda f: F.struct(param_name(f["name"]).alias("name"), java_type(f["type"], f["nesting"]).alias("type")))
    return rows.select("pkg", "class", "kind", "id", D.lower_leaf(F.col("_n.name")).alias("name"), F.col("_n.layer").alias("name_layer"), F.col("_r.name").alias("result"), params.alias("params")).orderBy("pkg", "class")
