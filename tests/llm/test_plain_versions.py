"""Queries against plain versions of their contracts."""

import hashlib
import re
from collections import Counter

import xxhash

from ferrule.llm import packing, pii, simhash

SF = "/root/testdata/sf0.001"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text or "") if holds(kind, m[0])]
    line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    n = Counter(KINDS[k] for _, k, _ in found)
    return (*(n[k] for k in KINDS), hashlib.sha256(line.encode()).hexdigest())


ODD = [
    "a.b+c@x.y-z.co and @x.y, a@b, a@b., é.a@b.c.d..", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111",
    "4111 1111 1111 1112 0000000000000000", "+1 (234) 555-6789 +12345 +1-2-3-4-5-6-7-8-9-0+1234567890", "+1.2.3.4 at 10.0.0.1@host.tld", "", None, "😀 +49 (0) 30 123456-78 😀 x@y.z", "1" * 40, "a@" * 50 + "b.c",
]


def test_base_spans_equal_plain_patterns(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(10**6 + k, t) for k, t in enumerate(ODD)]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: base(t) for i, t in docs}
    assert sum(sum(v[:4]) for v in want.values()) > 20
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_fingerprints_equal_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()[:120]] + [(10**6 + k, t) for k, t in enumerate([*ODD, "É À b c d E f", "one two", "a b c\x0bd\x85e f g"])]
    got = {r.doc_id: r.fingerprint for r in simhash.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in docs}


def test_long_documents_are_dealt_by_their_pieces(spark):
    rows = spark.createDataFrame([(k, "y" * 80_000) for k in range(3)], "doc_id long, text string")
    bins = packing.pack(rows, (8, 16), shard=1000).selectExpr("bin_id div 4294967296 AS shard").groupBy("shard").count().collect()
    assert len(bins) >= 10 and max(r["count"] for r in bins) < 2000
