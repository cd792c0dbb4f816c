"""Operator 6, secret scans: three base patterns and a token-efficiency test.

A random string costs many tokens: under a tiktoken vocabulary it has few
characters per token, while words, names and numbers in common use have many.
Runs of 16 or more characters of the base-64 alphabet that fall below RATIO
characters per token are reported as kind `random`, of whatever cases, digits and
separators. A run that doesn't, or that overlaps a base span, is cut at `/` and `=`
and then at `-` and `_`, and parts of 16 or more characters are tested in its place,
so a secret in a path or after a name is not averaged with them. Not reported:
numbers, UUIDs, what overlaps a base span (so digests in lower-case hex are of
the base kind `hex` alone), and known digests and identifiers: hex in capitals or
mixed case, of the length of an MD5, SHA-1 or SHA-2 digest, behind a word that says
so (a bare one looks like any random string and is reported), UUIDs without hyphens,
integrity strings and key prints (sha384-..., SHA256:...) of the right length,
ULIDs of this age, and ISBNs whose check digit fits. Shorter strings than LEAST
are not tested for randomness at all: under 16 characters words and codes cannot
be told from secrets by their tokens.

Cases: a null text is an empty one and has no spans; offsets count code points,
end exclusive; spans are in order of start, then kind as listed in KINDS; rows
repeat as they do in the input.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base scan; letters of the keywords in either case, ASCII only.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Candidates of the token test and what it leaves alone.
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Forms of digests and identifiers that are no secrets (fixed lengths of their standards).
KNOWN = re.compile(
    "|".join((
        r"(?i:\b(?:md5|sha-?[0-9]{0,3}|digest|checksum|fingerprint|etag|commit|hash)(?:sum)?)(?: (?:is|was|of))?[\s:=()\"'-]{1,6}(?:[0-9A-Fa-f]{128}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[0-9A-Fa-f]{12}[1-5][0-9A-Fa-f]{3}[89ABab][0-9A-Fa-f]{15}(?![A-Za-z0-9])",
        r"\b(?i:sha)(?:256[-:][A-Za-z0-9+/]{43}=?|384[-:][A-Za-z0-9+/]{64}|512[-:][A-Za-z0-9+/]{86}(?:==)?)(?![A-Za-z0-9+/])",
        r"(?<![A-Za-z0-9])01[0-9A-HJKMNP-TV-Z]{24}(?![A-Za-z0-9])",
    ))
)
ISBN = re.compile(r"(?<![0-9-])(?:97[89]-)?(?:[0-9]+-){3}[0-9X](?![0-9-])")
#: Where runs are cut, one after the other.
CUTS = (re.compile(r"[^/=]+"), re.compile(r"[^_-]+"))
LEAST = 16
RATIO = 2.0
VOCABULARY = "byte_bpe_50k.tiktoken"


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _public(name: str) -> tuple[str, str]:
    import public_tokenizers as P

    return P.path(name), P.PATTERN


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), leftmost and non-overlapping within each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_isbn(s: str) -> bool:
    """Ten or thirteen digits between hyphens whose check digit fits."""
    d = [10 if c == "X" else int(c) for c in s if c != "-"]
    if len(d) == 10:
        return 10 not in d[:9] and sum((10 - i) * x for i, x in enumerate(d)) % 11 == 0
    return len(d) == 13 and 10 not in d and sum(x * (3 if i % 2 else 1) for i, x in enumerate(d)) % 10 == 0


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """Digests and identifiers, as random_spans takes what it must leave alone."""
    return [(m.start(), -1, m.end()) for m in KNOWN.finditer(text)] + [(m.start(), -1, m.end()) for m in ISBN.finditer(text) if is_isbn(m[0])]


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    out, known = [], []
    meets = lambda spans, a, b: any(x[0] < b and a < x[2] for x in spans)

    def test(a: int, b: int, cuts: tuple) -> None:
        s = text[a:b]
        if s.isdigit() or UUID.fullmatch(s):
            return
        if not meets(taken, a, b) and len(s) < ratio * len(encoding.encode_ordinary(s)):
            if not known:  # looked for once a text, and only where there is something to report
                known.append(known_spans(text))
            if not meets(known[0], a, b):
                out.append((a, 3, b))
                return
        if cuts:
            for m in cuts[0].finditer(s):
                if m.end() - m.start() >= LEAST:
                    test(a + m.start(), a + m.end(), cuts[1:])

    for m in CANDIDATE.finditer(text):
        test(m.start(), m.end(), CUTS)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(texts: list[str], encoding, ratio: float = RATIO) -> dict[str, list]:
    out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
    for t in texts:
        base = base_spans(t)
        more = random_spans(t, base, encoding, ratio)
        for k in range(3):
            out[f"n_{KINDS[k]}"].append(sum(x[1] == k for x in base))
        out["n_random"].append(len(more))
        out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        out["spans"].append(_joined(sorted(base + more)))
    return out


def find_secrets(docs: DataFrame, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every whole text. One pass, no shuffle."""
    path, pattern = _public(vocabulary)
    return map_texts(docs, ["doc_id"], lambda texts: scan(texts, _encoding(path, pattern), ratio), SCHEMA)


def masked(text: str, spans: str, by: str = "[secret]") -> str:
    """The text with its spans replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    cuts = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with every span in `text` replaced by [secret] and n_chars, where there is one, made to match; other rows and columns stay as they are."""
    path, pattern = _public(vocabulary)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for texts in parts:
            found = [None if t is None else t for t in texts.tolist()]
            spans = scan([t or "" for t in found], encoding, ratio)["spans"]
            yield pd.Series([t if not s else masked(t, s) for t, s in zip(found, spans, strict=True)], dtype=object)

    mask = F.pandas_udf(run, "string")
    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
