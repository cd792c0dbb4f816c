"""Operators 5, 6, 7, 9 and 10 against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from schemawake.llm import bpe, packing, rendezvous, secrets, simhash, token_files, vectext
from schemawake.llm.queries import tokenizer_path

from .helpers import corpus, docs, none


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_library(tokenizer):
    r = random.Random(5)
    texts = ["I'm don't we'll 's 'll they've'd x''s  a  b\n\n c \t d", "", " ", "<|endoftext|> hi", "1st ½ x²", "日本語 テスト 😀", "x" * 300, "A'S a 's b", "a\r\n b\x1cx"]
    texts += ["".join(r.choice("ab'srelv dmt \n\t.1é ") for _ in range(60)) for _ in range(2000)]
    got = bpe.Encoder(tokenizer_path()).ids(texts)
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_value_code_round_trip():
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 3, 1], np.uint32)
    for n in range(len(v) + 1):
        control, data = token_files.encode_values(v[:n])
        assert token_files.decode_values(control, data, n).tolist() == v[:n].tolist()


def expected_ids(tokenizer):
    rows = sorted(((d, t or "") for d, t, *_ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0))
    return [(d, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")) for d, t in rows]


def test_token_files(spark, tokenizer):
    got = token_files.read_token_files(token_files.write_token_files(docs(spark), tokenizer_path())).collect()
    want, at = [], 0
    for d, ids in expected_ids(tokenizer):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    assert sorted(map(str, ((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got))) == sorted(map(str, want))
    assert token_files.read_token_files(token_files.write_token_files(none(spark), tokenizer_path())).isEmpty()


def test_packing(spark, tokenizer):
    got = packing.pack_documents(docs(spark), tokenizer_path()).collect()
    total = sum(len(ids) for _, ids in expected_ids(tokenizer))
    assert sum(r["length"] for r in got) == total
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) * 1.05 + 2
    # every document's pieces, put together, are its ids; only those of over 1,024 are cut
    held = {}
    for r in got:
        held.setdefault(r["doc_id"], []).append(r)
    for d, ids in expected_ids(tokenizer):
        pieces = sorted(held[d], key=lambda r: (r["piece"], r["sequence_id"]))
        if len(ids) <= 1024:
            assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces} == {(0, 0, len(ids), zlib.crc32(ids.tobytes()))}
            continue
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (r["length"] == 1024 or r["piece"] == 0)
            at += r["length"]
        assert at == len(ids)
    assert packing.pack_documents(none(spark), tokenizer_path()).isEmpty()


def test_local_search_never_adds_bins():
    r = random.Random(2)
    for _ in range(20):
        sizes = [r.randrange(1, 1024) for _ in range(200)]
        start = packing.best_fit(sizes, 1024)
        end = packing.pack(sizes)
        assert len(end) <= len(start) and sorted(x for b in end for x in b) == list(range(200))
        assert all(sum(sizes[x] for x in b) <= 1024 for b in end)
        squares = lambda bins: sum(sum(sizes[x] for x in b) ** 2 for b in bins)
        assert squares(end) >= squares(start)


def test_secrets(spark):
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark)).where("doc_id = 11 or doc_id = 7").collect()}
    text = corpus()[11][1]
    r = rows[11]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    base = [("assign", *re.search(r'token = "[0-9a-f]+', text).span()), ("hex", *re.search("[0-9a-f]{24,}", text).span()), ("access", *re.search("AKIA[A-Z]+", text).span())]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"] == joined
    assert rows[7]["spans"] == "" and secrets.find_secrets(none(spark)).isEmpty()
    masked = secrets.mask_secrets(docs(spark))
    assert masked.columns == docs(spark).columns and "0123456789abcdef" not in masked.where("doc_id = 11").first()["text"]


def naive_base(text):
    """The three base patterns, each from left to right without overlaps; too short matches are used up and dropped."""
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        found += [("assign", m.start(), m.end())] * (len(m.group(2)) >= 6)
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans_equal_brute_force(spark):
    r = random.Random(9)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "AKIA", "AKIAQ7", "=", ":", " ", "  ", '"', "'", "0123456789abcdef", "deadbeef", "hunter2", "abc", "XYZ12345678901234", "é", "-", "/", "\n", "ſ", "K"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(1500)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in secrets.find_secrets(df).collect():
        base = naive_base(texts[row["doc_id"]] or "")
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == x[0] for x in base) for k in ("assign", "access", "hex")]
        joined = [":".join(map(str, x)) for x in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert [x for x in spans if not x.startswith("random")] == joined


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("secret=token:abcdefgh", []),  # the first match is short and is consumed
        ("PassWord : hunter22", ["assign"]),
        ("key q9Zx7Kp2Lm4Vt8Rw3Yb6Nc1 end", ["random"]),
        ("d41d8cd98f00b204e9800998ecf8427e", ["hex"]),
        ("id 123e4567-e89b-12d3-a456-426614174000 and some_long_identifier_name", []),
        ("AKIAAKIA12", []),
    ],
)
def test_secret_kinds(text, kinds):
    enc = secrets._encoding(*secrets._public(secrets.VOCABULARY))
    spans = secrets.scan([text], enc)["spans"][0]
    assert [s.split(":")[0] for s in spans.split(",") if s] == kinds


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
@pytest.mark.parametrize("frame", ["{}", "see https://example.com/account/settings/{}/profile.html", "authorization_header_value={}", "my-service-account-{}"])
def test_random_strings_of_any_shape_are_found(alphabet, frame):
    enc = secrets._encoding(*secrets._public(secrets.VOCABULARY))
    r = random.Random(7)
    found = 0
    for _ in range(200):
        s = "".join(r.choice(alphabet) for _ in range(40))
        text = frame.format(s)
        a = text.index(s)
        spans = [x.split(":") for x in secrets.scan([text], enc)["spans"][0].split(",") if x]
        found += any(int(x[1]) <= a and int(x[2]) >= a + 40 for x in spans)
    assert found >= 190  # the rest have RATIO characters a token or more


def test_words_and_identifiers_are_no_secrets():
    enc = secrets._encoding(*secrets._public(secrets.VOCABULARY))
    texts = ["internationalization", "some_long_identifier_name", "https://example.com/products/category/listing-page", "getElementsByClassName", "characteristically", "AbstractFactoryBuilder"]
    assert [secrets.scan([t], enc)["spans"] for t in texts] == [[""]] * len(texts)


def naive_fingerprint(text):
    words = text.split()
    word, owner, _, _ = vectext.words([text])
    terms, _ = vectext.shingles(word, owner, 2)
    votes = np.zeros(64)
    for term, n in Counter(terms.tolist()).items():
        votes += (1 + np.log2(n)) * np.array([1 if term >> (63 - i) & 1 else -1 for i in range(64)])
    assert len(words) == len(word)
    return sum(1 << (63 - i) for i in range(64) if votes[i] > 0)


def test_simhash(spark):
    """More ranges than documents, so that most ends are in another range than what follows them."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("3", "100"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = simhash.edited_fingerprints(docs(spark)).collect()
        h = {r["t"]: r["h"] for r in docs(spark).selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
        rows = sorted(((d, t or "") for d, t, *_ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]))
        want = []
        for i, (d, t) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            k = len(t) // 4
            edited = t[: len(t) - k] + after[:k]
            own, other, following = (naive_fingerprint(x) for x in (t, edited, after))
            like = lambda a, b: 1 - (a ^ b).bit_count() / 64
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{other:016x}", like(own, other), like(own, following)))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert simhash.edited_fingerprints(none(spark)).isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_search_counts_equal_brute_force(spark):
    rows = [(i, f"{i % 30:016x}" if i % 3 else f"{(i % 30) << 3 | 1:016x}") for i in range(200)] + [(20, "ffffffffffffffff"), (20, "fffffffffffffff0"), (None, "0" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = sorted(map(str, map(tuple, simhash.search_counts(df).select("doc_id", "fingerprint", "n_within").collect())))
    want = []
    for d, f in rows:
        n = sum(0 < (int(f, 16) ^ int(g, 16)).bit_count() <= 3 for _, g in rows)
        want.append((d, f, n if d is not None and d % 20 == 0 else None))
    assert got == sorted(map(str, want))


def test_radius_search_equals_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << x for x in r.sample(range(64), k)) for b in base for k in (1, 2, 3, 4)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fingerprint long")
    got = {(a["query"], a["found"], a["distance"]) for a in simhash.within_radius(df.limit(100), df).collect()}
    ids = [x["fingerprint"] for x in df.collect()]
    asked = {x["fingerprint"] for x in df.limit(100).collect()}
    d = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b, d(a, b)) for a in asked for b in ids if 0 < d(a, b) <= 3}


def test_rendezvous(spark):
    rows = rendezvous.assign_shards(docs(spark), [1.0] * 24, [1.0] * 25).collect()
    assert len(rows) == len(corpus())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rendezvous.assign_shards(none(spark), [1.0] * 24).isEmpty()
    hot = spark.range(9000).selectExpr("cast(null as long) doc_id", "cast(id as string) text")
    assert sorted(r["slot"] for r in rendezvous.assign_shards(hot, [1.0] * 3).collect()) == list(range(9000))
    many = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    share = {r["shard"]: r["count"] / 20000 for r in rendezvous.assign_shards(many, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(share[1] - 0.5) < 0.02


def test_known_digests_and_identifiers_are_no_secrets():
    """Planted in prose: random strings are found, digests and identifiers of the same looks are not."""
    import base64
    import string
    import uuid

    r = random.Random(11)
    encoding = secrets._encoding(*secrets._public(secrets.VOCABULARY))
    raw = lambda n: bytes(r.randrange(256) for _ in range(n))
    crockford = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    known = []
    for _ in range(40):
        known += [f"MD5: {hashlib.md5(raw(9)).hexdigest().upper()}", f"sha1={hashlib.sha1(raw(9)).hexdigest().upper()}", f"SHA-256 ({hashlib.sha256(raw(9)).hexdigest().upper()})", f"checksum is {hashlib.sha512(raw(9)).hexdigest().upper()}"]
        known += [uuid.UUID(bytes=raw(16), version=4).hex.upper(), str(uuid.UUID(bytes=raw(16)))]
        known += [f"sha{n}-{base64.b64encode(hashlib.new(f'sha{n}', raw(9)).digest()).decode()}" for n in (256, 384, 512)]
        known += ["SHA256:" + base64.b64encode(raw(32)).decode().rstrip("="), "01" + "".join(r.choice(crockford) for _ in range(24))]
    known += ["978-3-16-148410-0", "0-306-40615-2", "978-0-306-40615-7", "0-8044-2957-X"]
    hidden = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randrange(20, 44))) for _ in range(300)]
    prose_ = "the value of {} was written down in the long report about transportation and understanding"
    found = lambda s: [(s_[a:b]) for s_ in [prose_.format(s)] for a, _, b in secrets.random_spans(s_, secrets.base_spans(s_), encoding)]
    assert [k for k in known if found(k)] == []
    assert sum(found(h) == [h] for h in hidden) >= 0.97 * len(hidden)
    assert found("978-3-16-148410-1") or not secrets.is_isbn("978-3-16-148410-1")
    assert found("internationalization-and-localization") == [] == found("understanding_of_transportation/department")
