"""Operator 2, personal data: keyed surrogates of the same type, gender, script and format.

Found are e-mail addresses, IPv4 addresses, phone numbers, card and account
numbers (13 to 19 digits), social security numbers, IBANs and persons: a title or
a common given name, in capitals too, before capitalised names. Where a document
names a person, every other place of it that has one of the names alone, with a
capital or in capitals, counts as well. A mention is made of parts (an address's
local part and domain, a person's given and family names, a number's digits);
each distinct part has one surrogate, whatever spelling, case, title or separators
a mention has, so mentions of one entity stay linked across all documents
(coreference), also when only a part is repeated.

A surrogate follows from a keyed hash of type, part and attempt. It keeps length,
letters of the same script, digits, check digits' validity (cards, IBANs), a
card's first digit, a phone's country code, an IP address's class (public,
private, loopback, ...) and a top-level domain. A given name keeps its gender: the
word lists', else the one that titles give it anywhere in the corpus, if they
agree. Collision checks over the distinct parts of the whole corpus, as Spark
jobs, move a part to its next attempt when its surrogate is another part's
surrogate or is itself found in the corpus; so distinct parts stay distinct. From
attempt CROWDED on a surrogate may be a value of the corpus, if no other part has
it: where values are short, all may be taken. A part that has none after
LAST_ATTEMPT attempts is an error. Only parts beyond attempt 0, or with a gender
from titles, need a table; texts are rewritten from the key and that table, which
is broadcast up to BROADCAST_ROWS rows and joined to the documents by shuffling
beyond.

The key is the session's setting KEY_SETTING; where it is unset, each run has a
random key of its own, and its surrogates do not link to those of another run.

Cases: a null text stays null and has no entities; repeated rows are rewritten
each, alike; overlapping finds go to the earlier start, then the type listed
first; offsets count code points of the original, end exclusive; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import secrets as system_random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, saved, text_of

KEY_SETTING = "spark.schemawake.surrogateKey"
BROADCAST_ROWS = 200_000
CROWDED, LAST_ATTEMPT = 32, 512
#: Fixed word lists: titles by the gender they tell, and common given names.
TITLES = {"m": "Mr Herr Señor Sr Monsieur M Don", "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Doña", "u": "Dr Prof"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Peter Hans Karl Jürgen Wolfgang Stefan Andreas Pierre Jean Michel Philippe Carlos José Juan Luis Miguel Иван Сергей Алексей Дмитрий",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Ursula Monika Petra Sabine Claudia Marie Nathalie Isabelle Sylvie Carmen Ana Laura Marta Lucía Анна Мария Елена Ольга",
}
_SEX = {name.lower(): sex for sex, names in GIVEN.items() for name in names.split()}
_TITLE = {name: sex for sex, names in TITLES.items() for name in names.split()}
_NAME = r"[^\W\d_a-zß-öø-ÿа-я][^\W\d_]+"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+%-])([\w.+%-]{1,64})@((?:[^\W_][\w-]{0,62}\.)+[^\W\d_]{2,24})")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?![\w]|[.-]\d)")),
    ("phone", re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,8}){1,5}|0\d(?:[ .-]\d{2}){4}|[2-9]\d{2}[2-9]\d{6})(?![\w]|[.-]\d)")),
    ("person", re.compile(r"(?<!\w)(?:(?P<title>" + "|".join(sorted(_TITLE, key=len, reverse=True)) + r")\b\.?[  ]+)?(?P<names>" + _NAME + r"(?:[  -]" + _NAME + r"){0,2})(?!\w)")),
)
TYPES = tuple(t for t, _ in PATTERNS)
_TITLES = "|".join(sorted(_TITLE, key=len, reverse=True))
#: What a text must hold for any of the patterns to be worth trying.
_ANY = re.compile(r"[@0-9]")
_LISTED = {n for names in GIVEN.values() for n in names.split()}
_NAMES = re.compile(r"(?<!\w)(?:" + "|".join(sorted({*_TITLE, *_LISTED, *(n.upper() for n in _LISTED)}, key=len, reverse=True)) + r")(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")

Part = tuple[str, str]  # type and normal form


def _split_person(m: re.Match) -> list[tuple[str, str, int, int]] | None:
    """(type, normal form, start, end) of each name, or None if nothing says that it is a person."""
    title, names = m.group("title"), [(x.group(), m.start("names") + x.start(), m.start("names") + x.end()) for x in re.finditer(r"[^  -]+", m.group("names"))]
    known = _SEX.get(names[0][0].lower())
    if not title and not (known and len(names) > 1):
        return None
    sex = _TITLE[title] if title else "u"
    given = len(names) - 1 if len(names) > 1 else int(known is not None)
    return [(f"given-{_SEX.get(n.lower(), sex)}" if i < given else "family", n.lower(), a, b) for i, (n, a, b) in enumerate(names)]


def parts_of(kind: str, m: re.Match) -> list[tuple[str, str, int, int]] | None:
    if kind == "email":
        return [("local", m.group(1).lower(), m.start(1), m.end(1)), ("domain", m.group(2).lower(), m.start(2), m.end(2))]
    if kind == "person":
        return _split_person(m)
    if kind == "ip":
        return [("ip", m.group(), m.start(), m.end())]
    plain = re.sub(r"[^\w+]", "", m.group())
    if kind == "phone" and not 7 <= sum(c.isdigit() for c in plain) <= 15:
        return None
    return [(kind, plain, m.start(), m.end())]


def find(text: str) -> list[tuple[int, int, str, list[tuple[str, str, int, int]]]]:
    """(start, end, type, parts) of the entities, in order, without overlaps. A given name's part type tells the gender that its title or the word lists give it here."""
    digits, names = _ANY.search(text), _NAMES.search(text)
    if not digits and not names:
        return []
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        if kind == "email" and "@" not in text or kind != "person" and not digits or kind == "person" and not names:
            continue
        if kind == "person":
            hits = [m for x in _NAMES.finditer(text) if (m := pattern.match(text, x.start()))]
        else:
            hits = pattern.finditer(text)
        found += [(m.start(), rank, m.end(), parts) for m in hits if (parts := parts_of(kind, m))]
    out = _apart(found)
    alone = {part: kind for _, rank, _, parts in out if TYPES[rank] == "person" for kind, part, _, _ in parts if len(part) > 2}
    if alone:
        person = TYPES.index("person")
        bare = [m for m in _WORD.finditer(text) if m.group().lower() in alone and m.group()[0].isupper()]
        out = _apart(out + [(m.start(), person + 1, m.end(), [(alone[m.group().lower()], m.group().lower(), m.start(), m.end())]) for m in bare])
    return [(a, b, TYPES[min(rank, len(TYPES) - 1)], parts) for a, rank, b, parts in out]


def _apart(found: list) -> list:
    """Finds (start, rank, end, parts) by start and rank, without those that overlap one before."""
    out, end = [], 0
    for x in sorted(found, key=lambda x: x[:3]):
        if x[0] >= end:
            out.append(x)
            end = x[2]
    return out


# --- surrogates ------------------------------------------------------------------

_ALPHABETS = (("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("ß", "ÿ", "àâçéèêíñóôúüöä"), ("а", "я", "абвгдежзиклмнопрстухшя"), ("α", "ω", "αβγδεζηθικλμνξοπρστυφχψω"))
_ONSETS = {"latin": "b d f g h k l m n p r s t v w br dr gr kl st tr".split(), "cyrillic": "б в г д ж з к л м н п р с т".split()}
_VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split()}
_ENDS = {("latin", "f"): "a ia elle ina".split(), ("latin", "m"): "o en us ard".split(), ("cyrillic", "f"): "а ия ина".split(), ("cyrillic", "m"): "ий ей ан".split(), ("latin", "u"): "er in el".split(), ("cyrillic", "u"): "ов ко".split()}


class Stream:
    """Keyed pseudo-random numbers that depend on type, part and attempt only."""

    def __init__(self, key: bytes, kind: str, part: str, attempt: int) -> None:
        self.key, self.base, self.block, self.pool = key, f"{kind}\0{part}\0{attempt}\0".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.base + str(self.block).encode(), key=self.key[:64], digest_size=64).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _like(c: str, s: Stream) -> str:
    """A character of the same kind and script."""
    if c.isdigit():
        return str(s.below(10)) if c.isascii() else c
    for low, high, letters in _ALPHABETS:
        if low <= c <= high:
            return letters[s.below(len(letters))]
    if "一" <= c <= "鿿" or "ぁ" <= c <= "ヾ" or "가" <= c <= "힣":
        return chr((ord(c) & ~0x3F) + s.below(0x40)) if "一" <= c else c
    return c


def _name(sex: str, part: str, s: Stream, attempt: int) -> str:
    script = "cyrillic" if any("а" <= c <= "я" for c in part) else "latin"
    if not any("a" <= c <= "z" or "а" <= c <= "я" for c in part):
        return "".join(_like(c, s) for c in part)
    ends = _ENDS[script, sex]
    size = min(1 + len(part) // 4 + attempt // 16, 8)
    return "".join(_ONSETS[script][s.below(len(_ONSETS[script]))] + _VOWELS[script][s.below(5)] for _ in range(size)) + _ONSETS[script][s.below(len(_ONSETS[script]))] + ends[s.below(len(ends))]


#: First octets of which all addresses are public (fixed by the address registry).
_PUBLIC = [i for i in range(1, 224) if i not in (10, 100, 127, 169, 172, 192, 198, 203)]


def _ip_kept(o: list[int]) -> int:
    """How many leading octets must stay for an address to stay in its class (private, loopback, shared, link-local, test, multicast, reserved); 0 for public ones."""
    if o[0] in (10, 127, 0) or o[0] >= 224:
        return 1
    if o[:2] in ([192, 168], [169, 254]) or o[0] == 172 and 16 <= o[1] < 32 or o[0] == 100 and 64 <= o[1] < 128 or o[0] == 198 and o[1] in (18, 19):
        return 2
    return 3 if o[:3] in ([192, 0, 0], [192, 0, 2], [198, 51, 100], [203, 0, 113]) else 0


def _ip(part: str, attempt: int, s: Stream) -> str:
    octets = [int(x) for x in part.split(".")]
    keep = _ip_kept(octets)
    if keep == 2 and octets[0] in (192, 172) and attempt >= CROWDED // 2:
        octets, keep = [10], 1  # a small private range may be full; this one is private too
    head = octets[:keep] if keep else [_PUBLIC[s.below(len(_PUBLIC))]]
    return ".".join(map(str, head + [1 + s.below(254) for _ in range(4 - len(head))]))


def _iban_rest(text: str) -> int:
    """Remainder that is 1 for valid check digits."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(part: str, s: Stream) -> str:
    body = "".join(_like(c.lower(), s).upper() for c in part[4:])
    check = 98 - _iban_rest(part[:2] + "00" + body)
    if _iban_rest(part) != 1:
        check = 2 + (check - 2 + 1 + s.below(96)) % 97
    return f"{part[:2]}{check:02d}{body}"


def surrogate(kind: str, part: str, attempt: int, key: bytes, sex: str = "u") -> str:
    """The normal form that takes part's place."""
    s = Stream(key, kind, part, attempt)
    if kind == "ip":
        return _ip(part, attempt, s)
    if kind == "card":
        out = part[0] + "".join(str(s.below(10)) for _ in part[1:-1])
        check = next(str(d) for d in range(10) if luhn(out + str(d)))
        return out + (check if luhn(part) else str((int(check) + 1 + s.below(9)) % 10))
    if kind == "phone":
        keep = 0 if part[0] != "+" else 2 if part[1] in "17" else 3
        return part[:keep] + "".join(_like(c, s) for c in part[keep:])
    if kind == "iban":
        return _iban(part, s)
    if kind == "domain":
        head, _, top = part.rpartition(".")
        return "".join(_like(c, s) for c in head) + "x" * (attempt // 16) + "." + top
    if kind in ("given", "family"):
        return _name(sex if kind == "given" else "u", part, s, attempt)
    return "".join(_like(c, s) for c in part) + "".join(str(s.below(10)) for _ in range(attempt // 16) if kind == "local")


def _rendered(kind: str, new: str, old: str) -> str:
    """new in the case or layout of the mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(new)
        return "".join(next(it) if c.isalnum() or c == "+" else c for c in old)
    if kind == "ip":
        return new
    if old.isupper():
        return new.upper()
    if kind in ("local", "domain"):
        return "".join(n.upper() if i < len(old) and old[i].isupper() else n for i, n in enumerate(new))
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def family_of(kind: str) -> str:
    """The type under which a part has its surrogate: a given name's is the same whatever its title says."""
    return "given" if kind.startswith("given") else kind


def rewrite(text: str, table: dict[Part, tuple[int, str]], key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and its entities. table: attempt and gender of the parts for which these are not 0 and the word lists'."""
    out, at, spans = [], 0, []
    for a, b, kind, parts in find(text):
        for t, part, x, y in parts:
            t = family_of(t)
            attempt, sex = table.get((t, part)) or (0, _SEX.get(part, "u"))
            out += [text[at:x], _rendered(t, surrogate(t, part, attempt, key, sex), text[x:y])]
            at = y
        spans.append((a, b, kind))
    return "".join([*out, text[at:]]), spans


# --- over the corpus ---------------------------------------------------------------


def distinct_parts(docs: DataFrame) -> DataFrame:
    """type, part, sex: what is mentioned anywhere, once each; sex is a given name's in the word lists, else that of its titles where they agree, else u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = sorted({(t, p) for text in batch.column(0).to_pylist() for *_, found in find(text) for t, p, _, _ in found})
            cols = [[family_of(t) for t, _ in parts], [p for _, p in parts], [_SEX.get(p) or (t[-1] if t.startswith("given-") else "u") for t, p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["type", "part", "sex"])

    told = docs.where("text is not null").select("text").mapInArrow(run, "type string, part string, sex string")
    seen = F.when(F.col("sex") != "u", F.col("sex"))
    return told.groupBy("type", "part").agg(F.when(F.min(seen) == F.max(seen), F.min(seen)).otherwise("u").alias("sex"))


_SETTLED = "type string, part string, sex string, attempt int, new string"


def _with_surrogate(parts: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, p, x, a = (b.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(t, p, a, key, x) for t, p, x, a in zip(t, p, x, a, strict=True)], pa.string())], ["type", "part", "sex", "attempt", "new"])

    return parts.select("type", "part", "sex", "attempt").mapInArrow(run, _SETTLED)


def settle(parts: DataFrame, key: bytes) -> DataFrame:
    """type, part, sex, attempt, new: every part's surrogate, no two alike within a type and, but where a type is crowded, none a part of the corpus."""
    parts = saved(parts, "parts")
    known = parts.select("type", F.col("part").alias("new"))
    done = None
    todo = saved(_with_surrogate(parts.withColumn("attempt", F.lit(0)), key), "surrogates")
    for attempt in range(LAST_ATTEMPT):
        first = todo.groupBy("type", "new").agg(F.min(F.struct(F.xxhash64("part").alias("h"), "part")).alias("first"))
        # a part is never its own surrogate
        free = first.where("first.part <> new")
        taken = [x for x in (known if attempt < CROWDED else None, None if done is None else done.select("type", "new")) if x is not None]
        for rows in taken:
            free = free.join(rows, ["type", "new"], "left_anti")
        free = free.select("type", "first.part")
        good = saved(todo.join(free, ["type", "part"], "left_semi"), "settled")
        done = good if done is None else done.unionByName(good)
        rest = todo.join(free, ["type", "part"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        more = saved(_with_surrogate(rest, key), "surrogates")
        discard(todo)
        todo = more
        if todo.isEmpty():
            return done
    raise ValueError(f"after {LAST_ATTEMPT} attempts some parts have no surrogate of their own; their values are all in use")


SCHEMA = "surrogate_text string, n_entities int, entities string"


def _rewritten(texts: list[str], table: dict[Part, tuple[int, str]], key: bytes) -> dict:
    rows = [rewrite(t, table, key) for t in texts]
    return {"surrogate_text": [t for t, _ in rows], "n_entities": [len(s) for _, s in rows], "entities": [",".join(f"{k}:{a}:{b}" for a, b, k in s) for _, s in rows]}


def _doc_attempts(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """h (hash of the text) with the moved parts it mentions, for tables of them too long to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({(h, family_of(t), p) for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for *_, found in find(text) for t, p, _, _ in found})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["h", "type", "part"])

    mentions = docs.where("text is not null").select(F.xxhash64("text"), "text").mapInArrow(run, "h long, type string, part string").distinct()
    return mentions.join(moved, ["type", "part"]).groupBy("h").agg(F.collect_list(F.struct("type", "part", "attempt", "sex")).alias("moves"))


def key_of(spark: SparkSession) -> bytes:
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else system_random.token_bytes(32)


def replace_personal_data(docs: DataFrame, key: bytes | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and entities (type:start:end in the original) of every document."""
    spark: SparkSession = docs.sparkSession
    key = key or key_of(spark)
    listed = F.array(*map(F.lit, sorted(_SEX)))
    moved = saved(settle(distinct_parts(docs), key).where((F.col("attempt") > 0) | (F.col("sex") != "u") & ~F.array_contains(listed, F.col("part"))).select("type", "part", "attempt", "sex"), "moved")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.col("text").isNull().alias("_none"))
    if moved.count() <= broadcast_rows:
        table = spark.sparkContext.broadcast({(r["type"], r["part"]): (r["attempt"], r["sex"]) for r in moved.collect()})
        out = map_texts(rows, ["doc_id", "_none"], lambda texts: _rewritten(texts, table.value, key), SCHEMA)
    else:
        told = rows.withColumn("h", F.xxhash64("text")).join(_doc_attempts(docs, moved), "h", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [_rewritten([t or ""], {(m["type"], m["part"]): (m["attempt"], m["sex"]) for m in moves or ()}, key) for t, moves in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                cols = [[m[c][0] for m in made] for c in ("surrogate_text", "n_entities", "entities")]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["doc_id", "_none", "surrogate_text", "n_entities", "entities"])

        out = told.select("doc_id", "_none", text_of().alias("text"), "moves").mapInArrow(run, f"doc_id {kind}, _none boolean, {SCHEMA}")
    return out.select("doc_id", F.when(~F.col("_none"), F.col("surrogate_text")).alias("text"), F.col("n_entities").cast("long"), "entities")
