"""Declarations: their text, checksum id, types and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed word sets of the declaration language.
PRIMITIVES = ("true", "int", "long", "double", "string", "bytes", "Bool", "#", "int128", "int256")
BUILTINS = ("Type", "Object", "Vector", "True")


def params_text(params: Column) -> Column:
    """' a:int b:flags.0?true' of an array of structs (name, type)."""
    return F.array_join(F.transform(params, lambda p: F.concat(F.lit(" "), p["name"], F.lit(":"), p["type"])), "")


def generic_marks(result: Column) -> Column:
    """What results X and t bring before the parameters."""
    magic = F.element_at(F.split(result, " "), -1)
    generic = F.when(magic.isin("X", "t"), F.concat(F.lit(" {"), magic, F.lit(":Type}"))).otherwise("")
    return F.concat(generic, F.when(magic == "t", F.lit(" # [ t ]")).otherwise(""))


def declaration_text(name: Column, params: Column, result: Column) -> Column:
    """Canonical text whose checksum is the id; results X and t bring their generic marks."""
    return F.concat(name, generic_marks(result), params_text(params), F.lit(" = "), result)


def checksum_id(text: Column) -> Column:
    """CRC-32 of the normalised text: bytes as string, no brackets, no optional-true parameters."""
    t = F.replace(text, F.lit(":bytes "), F.lit(":string "))
    t = F.replace(t, F.lit("?bytes "), F.lit("?string "))
    t = F.translate(F.replace(t, F.lit("<"), F.lit(" ")), ">{}", "")
    return F.crc32(F.regexp_replace(t, r" \w+:\w+\.\d+\?true", "").cast("binary"))


def snapshot_line(name: Column, id_: Column, params: Column, result: Column) -> Column:
    """The line of an object in a snapshot's text."""
    return F.concat(name, F.lit("#"), F.lower(F.hex(id_)), generic_marks(result), params_text(params), F.lit(" = "), result, F.lit(";"))


def declaration_line(name: Column, id_: Column, params: Column, result: Column) -> Column:
    """The short line of changelogs, without generic marks."""
    return F.concat(name, F.lit("#"), F.lower(F.hex(id_)), params_text(params), F.lit(" = "), result, F.lit(";"))


def namespace(name: Column) -> Column:
    """What stands before the last dot; '' without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def leaf(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def flag_prefix(type_: Column) -> Column:
    """'flags.3?' of 'flags.3?int'; '' if the parameter isn't optional."""
    return F.regexp_extract(type_, r"^(flags\d*\.\d+\?)", 1)


def nesting(type_: Column) -> Column:
    """Number of Vector< > pairs around a type without its flag prefix: an opening only counts with a closing."""
    opened = F.length(F.regexp_extract(type_, r"^((?:Vector<)*)", 1)) / 7
    closed = F.length(F.regexp_extract(type_, r"(>*)$", 1))
    return F.least(opened, closed).cast("int")


def peeled(type_: Column, depth: Column) -> Column:
    return F.substr(type_, (depth * 7 + 1).cast("int"), (F.length(type_) - depth * 8).cast("int"))


def wrapped(type_: Column, depth: Column) -> Column:
    return F.concat(F.repeat(F.lit("Vector<"), depth), type_, F.repeat(F.lit(">"), depth))


def atoms(type_: Column) -> Column:
    """Array of the names a type uses: Vector once per level, then what is inside; ! and % in front are dropped."""

    def one(field: Column) -> Column:
        bare = F.regexp_replace(field, "^[!%]+", "")
        n = nesting(bare)
        inner = F.regexp_replace(peeled(bare, n), "^[!%]+", "")
        return F.concat(F.array_repeat(F.lit("Vector"), n), F.filter(F.array(inner), lambda x: x != ""))

    return F.flatten(F.transform(F.filter(F.split(F.trim(type_), r"\s+"), lambda x: x != ""), one))


def upper_leaf(name: Column) -> Column:
    """First letter of the leaf in upper case, if it is a to z."""
    last = leaf(name)
    head = F.substring(last, 1, 1)
    up = F.when(head.between("a", "z"), F.upper(head)).otherwise(head)
    return F.concat(_space(name), up, F.substr(last, F.lit(2)))


def lower_leaf(name: Column) -> Column:
    last = leaf(name)
    return F.concat(_space(name), F.lower(F.substring(last, 1, 1)), F.substr(last, F.lit(2)))


def _space(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*\.)?[^.]*$", 1)


def version_code(text: Column) -> Column:
    """Dotted version to a sortable number, two digits a part: 1.12.3 to 11203; a part that is no number counts 0."""
    return F.aggregate(F.split(text, "[.]"), F.lit(0).cast("bigint"), lambda a, x: a * 100 + F.coalesce(x.try_cast("bigint"), F.lit(0)))


def same_abstract_result(old: Column, new: Column) -> Column:
    """May the incoming result of a method replace the old one? Its leaf is capitalised, is not Updates, and differs but for case and namespace."""
    return F.substring(leaf(new), 1, 1).rlike("[A-Z]") & (F.lower(leaf(new)) != "updates") & (F.lower(leaf(old)) != F.lower(leaf(new)))
