"""Names as other clients write them: class names, Java types, parameter names, light markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed rewrites of snake-case parameter names, applied once each in this order.
PARAM_FIXES = (
    (r"^((is_admin)|is_(.*))$", "$2$3"),
    (r"^web_", ""),
    (r"__b", "_B"),
    (r"_item$", ""),
    (r"^hash2$", "hash"),
    (r"^via_invite$", "via_request"),
    (r"^_", ""),
    (r"^doc$", "id"),
)
#: Fixed Java to declaration types.
JAVA_TYPES = {
    "int": "int", "long": "long", "double": "double", "string": "string", "bytes": "bytes", "Bool": "Bool", "true": "true",
    "Integer": "int", "Long": "long", "Double": "double", "String": "string", "byte[]": "bytes", "ByteBuffer": "bytes", "boolean": "Bool", "Boolean": "Bool",
}
#: Numbers this large at a name's end are layers.
LEAST_LAYER = 100
#: Fixed patterns of legacy class names.
LEGACY = r"Old[0-9]*$|ToBeDeprecated$|(?i:ToDelete$)|Layer[0-9]+$|(?i:_legacy$)|(?i:^TL_contactLink)"


def param_name(name: Column) -> Column:
    """camelCase to snake_case, then the fixed rewrites."""
    first = F.lower(F.substring(name, 1, 1))
    rest = F.lower(F.regexp_replace(F.substr(name, F.lit(2)), r"(\p{Lu})", "_$1"))
    out = F.concat(first, rest)
    for pattern, by in PARAM_FIXES:
        out = F.regexp_replace(out, pattern, by)
    return out


def _first(c: Column, how) -> Column:
    return F.concat(how(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def class_name(name: Column, hint: Column, capital: bool = False) -> Column:
    """Struct of the dotted name and the layer that a class name tells.

    In turn: a dot splits hint and name; TL_ goes; a part `layerN` (or `layer`, N) ends the name, `old` after it makes the
    layer 1; otherwise a last number of 100 or more is the layer; a last part `old...` makes it 1; a single part loses the
    package in front of a capital; of several parts the first is uncapitalised; a single part gets the package in front.
    """
    dotted = F.instr(name, ".") > 0
    hint = F.when(dotted, F.split_part(name, F.lit("."), F.lit(1))).otherwise(F.coalesce(hint, F.lit("")))
    bare = F.replace(F.when(dotted, F.split_part(name, F.lit("."), F.lit(2))).otherwise(name), F.lit("TL_"), F.lit(""))
    package = F.when(hint.isin("", "TLRPC", "TLObject"), "").otherwise(F.regexp_replace(hint, "^TL_", ""))
    number = lambda x: F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("int"))
    drop_last = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)
    state = lambda parts, layer: F.struct(parts.alias("parts"), layer.cast("int").alias("layer"))

    def cut_at_layer(parts: Column) -> Column:
        told = F.transform(parts, lambda x, i: F.when(x == "layer", number(F.get(parts, i + 1))).when(x.startswith("layer"), number(F.substr(x, F.lit(6)))))

        def cut(at: Column) -> Column:
            where = F.array_position(F.transform(at, lambda x: x.isNotNull()), True).cast("int")  # from 1; 0 for none
            old = F.exists(F.slice(parts, F.greatest(where, F.lit(1)), F.size(parts)), lambda x: x.startswith("old"))
            layer = F.when(old, 1).otherwise(F.get(at, where - 1))
            return F.when(where > 0, state(F.slice(parts, F.lit(1), where - 1), layer)).otherwise(state(parts, F.lit(0)))

        return _let(told, cut)

    def cut_number(s: Column) -> Column:
        last = number(F.try_element_at(s["parts"], F.lit(-1)))
        hit = (s["layer"] == 0) & (F.size(s["parts"]) > 1) & (F.coalesce(last, F.lit(0)) >= LEAST_LAYER)
        return F.when(hit, state(drop_last(s["parts"]), last)).otherwise(s)

    def cut_old(s: Column) -> Column:
        return F.when(F.coalesce(F.try_element_at(s["parts"], F.lit(-1)).startswith("old"), F.lit(False)), state(drop_last(s["parts"]), F.lit(1))).otherwise(s)

    def cased(s: Column) -> Column:
        parts = s["parts"]
        only = F.get(parts, F.lit(0))
        rest = F.substr(only, F.length(package) + 1)
        prefixed = (F.size(parts) == 1) & (package != "") & only.startswith(package) & F.substring(rest, 1, 1).rlike("^[A-Z]")
        several = F.concat(F.array(_first(only, F.lower)), F.slice(parts, F.lit(2), F.size(parts)))
        return state(F.when(prefixed, F.array(_first(rest, F.lower))).when(F.size(parts) > 1, several).otherwise(parts), s["layer"])

    def named(s: Column) -> Column:
        parts = s["parts"]
        if capital:
            parts = F.when(F.size(parts) > 0, F.concat(drop_last(parts), F.array(_first(F.try_element_at(parts, F.lit(-1)), F.upper)))).otherwise(parts)
        whole = F.array_join(F.when((F.size(s["parts"]) == 1) & (package != ""), F.concat(F.array(package), parts)).otherwise(parts), ".")
        return F.struct(whole.alias("name"), s["layer"].alias("layer"))

    out = _let(F.split(bare, "_"), cut_at_layer)
    for step in (cut_number, cut_old, cased, named):
        out = _let(out, step)
    return F.when(bare == "TLObject", F.struct(F.lit("").alias("name"), F.lit(0).alias("layer"))).otherwise(out)


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def java_type(type_: Column, depth: Column) -> Column:
    """A Java field's type as a declaration type, inside `depth` vectors."""
    known = F.create_map(*[F.lit(x) for kv in JAVA_TYPES.items() for x in kv])
    tl = F.regexp_replace(type_, "^Tl_", "TL_")
    other = F.when(F.instr(tl, "_") > 0, class_name(tl, F.lit(""), True)["name"]).otherwise(_first(type_, F.upper))
    inner = F.coalesce(F.element_at(known, type_), other)
    return F.concat(F.repeat(F.lit("Vector<"), depth), inner, F.repeat(F.lit(">"), depth))


def markup_to_html(text: Column) -> Column:
    """Escape, then `code`, **bold** and *italic*."""
    t = F.trim(text, F.lit(" \t\n\r\f\x0b"))
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"`([^`\n]+?)`", "<code>$1</code>")
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "<b>$1</b>")
    return F.regexp_replace(t, r"(^|[^*\w])\*([^\s*](?:[^*\n]*?[^\s*])?)\*([^*\w]|$)", "$1<i>$2</i>$3")


def item_name(text: Column) -> Column:
    """The object name in a changelog item: without `Added `, a last colon, and `#id`."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), "^Added ", ""), ":$", "")
    return F.regexp_replace(t, "^([^#]+)#.*$", "$1")


#: Names under which clients are shown, and in short; clients whose version is shown with its build number (fixed values).
SOURCE_NAMES = {"tdesktop": "Telegram Desktop", "android": "Telegram for Android", "ios": "Telegram for iOS", "tdlib": "TDLib"}
SHORT_NAMES = {"tdesktop": "TDesktop", "android": "Android", "ios": "iOS", "tdlib": "TDLib"}
WITH_BUILD = ("android", "ios")


def source_name(source: Column, short: bool = False) -> Column:
    """A client's name; empty for an unknown one."""
    named = F.create_map(*[F.lit(x) for kv in (SHORT_NAMES if short else SOURCE_NAMES).items() for x in kv])
    return F.coalesce(F.element_at(named, source), F.lit(""))


def shown_version(source: Column, version: Column, build: Column) -> Column:
    """A client's version as shown; empty for an unknown one."""
    built = F.concat(version, F.lit(" ("), build.cast("string"), F.lit(")"))
    return F.when(source.isin(*WITH_BUILD), built).when(source.isin(*SOURCE_NAMES), version).otherwise("")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def entities_decoded(text: Column) -> Column:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
