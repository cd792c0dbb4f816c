"""Markup audit of a page corpus: tags, balance, nesting, list items, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import entities_decoded

#: Fixed tag sets: allowed ones, attributes they may have, and those never closed.
ALLOWED = "a aside b blockquote br code em figcaption figure h3 h4 hr i iframe img li ol p pre s strong u ul video".split()
ATTRIBUTES = {"a": "href", "iframe": "src", "img": "src", "video": "src"}
UNCLOSED = ("br", "hr", "img")
CHILDLESS = ("img", "iframe", "video", "br", "hr")
_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>"


def tags(pages: DataFrame) -> DataFrame:
    """page_id, seq, closing, tag, attrs of every tag."""
    found = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("seq", "raw"))
    part = lambda i: F.regexp_extract("raw", _TAG, i)
    return rows.select("page_id", "seq", (part(1) == "/").alias("closing"), part(2).alias("tag"), part(3).alias("attrs"))


def tag_audit(pages: DataFrame) -> DataFrame:
    """page_id, tag, n, allowed, missing_attr, extra_attr: openings by tag; attributes a tag needs or may not have."""
    wanted = F.create_map(*[F.lit(x) for kv in ATTRIBUTES.items() for x in kv])
    names = F.transform(F.regexp_extract_all("attrs", F.lit(r"([a-zA-Z-]+)\s*="), F.lit(1)), F.lower)
    need = F.element_at(wanted, F.col("tag"))
    rows = tags(pages).where("not closing").withColumns({"missing": F.coalesce(~F.array_contains(names, need), F.lit(False)), "extra": F.size(F.filter(names, lambda n: F.coalesce(n != need, F.lit(True)))) > 0})
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.first(F.col("tag").isin(ALLOWED)).alias("allowed"), F.count_if("missing").alias("missing_attr"), F.count_if("extra").alias("extra_attr"))


def tag_balance(pages: DataFrame) -> DataFrame:
    """page_id, tag, opened, closed, balanced: never more closings than openings so far, and as many at the end."""
    step = F.when(F.col("closing"), -1).otherwise(1)
    w = Window.partitionBy("page_id", "tag").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tags(pages).where(~F.col("tag").isin(*UNCLOSED)).withColumns({"level": F.sum(step).over(w), "step": step})
    return rows.groupBy("page_id", "tag").agg(F.count_if(~F.col("closing")).alias("opened"), F.count_if("closing").alias("closed"), ((F.min("level") >= 0) & (F.sum("step") == 0)).alias("balanced"))


def nesting(pages: DataFrame) -> DataFrame:
    """page_id, nested, reason, tag, expected, seq: is every tag closed in the order that the open ones ask for, and if not, which is the first that isn't?

    A fold over a page's tags and texts with the open tags as a stack. Reasons: `nothing open` (a closing tag too many), `other tag open`
    (expected is the tag that had to be closed first), `has content` (a tag without children is closed right behind a child of its own) and
    `never closed` (the innermost tag still open at the end). Tags are told apart as they are written; self-closed ones and those of UNCLOSED
    open nothing. seq counts tags and texts from 0; for `never closed` it is their number.
    """
    pieces = F.regexp_extract_all("html", F.lit(_TAG + "|[^<]+"), F.lit(0))
    tag = lambda x: F.regexp_extract(x, _TAG, 2)
    marks = F.transform(pieces, lambda x: F.struct(tag(x).alias("tag"), x.startswith("</").alias("closing"), (x.endswith("/>") | tag(x).isin(*UNCLOSED)).alias("alone")))
    # open: the stack; last: how deep the latest tag or text lies
    state = "struct<open:array<string>,last:int,seq:int,reason:string,tag:string,expected:string>"

    def told(open_: Column, last: Column, seq: Column, reason: Column | None = None, tag: Column | None = None, expected: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(open_.alias("open"), last.alias("last"), seq.alias("seq"), (none if reason is None else reason).alias("reason"), (none if tag is None else tag).alias("tag"), (none if expected is None else expected).alias("expected")).cast(state)

    def step(a: Column, x: Column) -> Column:
        depth, top = F.size(a["open"]), F.element_at(a["open"], -1)
        wrong = F.when(depth == 0, "nothing open").when(F.try_element_at(a["open"], F.lit(-1)) != x["tag"], "other tag open").when((a["last"] == depth) & x["tag"].isin(*CHILDLESS), "has content")
        expected = F.when((depth > 0) & (F.try_element_at(a["open"], F.lit(-1)) != x["tag"]), top)
        closed = F.when(wrong.isNotNull(), told(a["open"], a["last"], a["seq"], wrong, x["tag"], expected)).otherwise(told(F.slice(a["open"], F.lit(1), depth - 1), a["last"], a["seq"] + 1))
        opened = told(F.when(x["alone"], a["open"]).otherwise(F.array_append(a["open"], x["tag"])), depth, a["seq"] + 1)
        moved = F.when(x["tag"] == "", told(a["open"], depth, a["seq"] + 1)).when(x["closing"], closed).otherwise(opened)
        return F.when(a["reason"].isNotNull(), a).otherwise(moved)

    begin = told(F.array().cast("array<string>"), F.lit(-1), F.lit(0))
    # inline() keeps the fold from being worked out once for each column
    rows = pages.where("html is not null").select("page_id", F.inline(F.array(F.aggregate(marks, begin, step))))
    left = F.col("reason").isNull() & (F.size("open") > 0)
    reason, tag_ = F.when(left, "never closed").otherwise(F.col("reason")), F.when(left, F.try_element_at("open", F.lit(-1))).otherwise(F.col("tag"))
    return rows.select("page_id", reason.isNull().alias("nested"), reason.alias("reason"), tag_.alias("tag"), "expected", F.when(reason.isNotNull(), F.col("seq")).alias("seq"))


def version_section(pages: DataFrame, version: str, heading: str = "h3", default: str = "no changelog") -> DataFrame:
    """page_id, found, text: the first list after the first heading that names the page's version, before the next heading of level 3 or 5.

    `version` names a column. A fold over headings, list marks and what lies between counts how deep lists lie within lists, so the list ends at
    the mark that closes it; one that is never closed goes to the page's end. Marks of lists within it go, those of items become bullets; links
    from the root stay as they are (see rebased_links). A page without such a heading, or without a list in its section, has the default text.
    """
    whole = rf"<{heading}\b[^>]*>.*?</{heading}>"
    pieces = F.regexp_extract_all("html", F.lit(rf"(?s){whole}|<h[35]\b[^>]*>|</?ul\b[^>]*>|[^<]+|<"), F.lit(0))
    named = lambda x: x.rlike(f"(?s)^{whole}$") & F.contains(F.regexp_replace(x, "<[^>]*>", ""), F.col(version).cast("string"))
    marks = F.transform("_pieces", lambda x: F.struct(F.when(x.rlike("^<ul\\b"), "open").when(x.startswith("</ul"), "close").when(x.rlike("^<h[35]\\b"), "head").otherwise("").alias("kind"), F.coalesce(named(x), F.lit(False)).alias("named")))
    # at: the piece's number; deep: lists open; begin, end: the list's marks
    state = "struct<at:int,hit:boolean,deep:int,begin:int,end:int,over:boolean>"

    def told(a: Column, hit: Column, deep: Column, begin: Column, end: Column, over: Column) -> Column:
        return F.struct((a["at"] + 1).alias("at"), hit.alias("hit"), deep.alias("deep"), begin.alias("begin"), end.alias("end"), over.alias("over")).cast(state)

    def step(a: Column, x: Column) -> Column:
        stay = told(a, a["hit"], a["deep"], a["begin"], a["end"], a["over"])
        begun = a["begin"].isNotNull()
        head = F.when(~a["hit"] & x["named"], told(a, F.lit(True), F.lit(0), a["begin"], a["end"], a["over"])).when(a["hit"] & ~begun, told(a, a["hit"], a["deep"], a["begin"], a["end"], F.lit(True))).otherwise(stay)
        opened = told(a, a["hit"], a["deep"] + 1, F.coalesce(a["begin"], a["at"]), a["end"], a["over"])
        closed = F.when(begun & (a["deep"] == 1), told(a, a["hit"], F.lit(0), a["begin"], a["at"], F.lit(True))).when(begun, told(a, a["hit"], a["deep"] - 1, a["begin"], a["end"], a["over"])).otherwise(stay)
        return F.when(a["over"], stay).when(x["kind"] == "head", head).when(a["hit"] & (x["kind"] == "open"), opened).when(a["hit"] & (x["kind"] == "close"), closed).otherwise(stay)

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit(0).alias("deep"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("over")).cast(state)
    rows = pages.withColumn("_pieces", pieces)
    rows = rows.select("page_id", "_pieces", F.inline(F.array(F.aggregate(marks, start, step))))
    inside = F.array_join(F.slice("_pieces", F.col("begin") + 2, F.coalesce("end", F.col("at")) - F.col("begin") - 1), "")
    rows = rows.select("page_id", F.inline(F.array(F.struct(F.when(F.col("begin").isNotNull(), inside).alias("_list")))))
    bare = F.regexp_replace(F.replace(F.replace(F.col("_list"), F.lit("<li>"), F.lit("• ")), F.lit("</li>"), F.lit("")), r"</?ul\b[^>]*>", "")
    text = F.trim(bare, F.lit(" \t\r\n"))
    found = F.coalesce(F.col("_list") != "", F.lit(False))
    return rows.select("page_id", found.alias("found"), F.when(found, text).otherwise(F.lit(default)).alias("text"))


def list_items(pages: DataFrame, heading: str = "nav", default: str = "no changelog") -> DataFrame:
    """page_id, pos, item: list items, entities decoded, of the first section opened by `heading`; a page without any has the default text."""
    section = F.regexp_extract("html", rf"(?s)<{heading}[^>]*>(.*?)</{heading}>", 1)
    items = F.regexp_extract_all(section, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    listed = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(default)))
    return pages.select("page_id", F.posexplode(listed).alias("pos", "raw")).select("page_id", "pos", entities_decoded(F.regexp_replace("raw", "<[^>]*>", "")).alias("item"))


def rebased_links(pages: DataFrame, base: str) -> DataFrame:
    """html with links from the root made absolute, and how many there were."""
    n = F.size(F.regexp_extract_all("html", F.lit('(href="/)'), F.lit(1)))
    return pages.select("page_id", F.replace("html", F.lit('href="/'), F.lit(f'href="{base}/')).alias("html"), n.alias("links"))
