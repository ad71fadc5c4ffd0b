"""Operator 9. Secret scans: access identifiers, secrets and endpoints linked by interval joins within scopes."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, record

REACH = 400  # signs between parts of one credential, at most
BITS_PER_SIGN = 3.0  # entropy of what may be a secret
LETTERS_BITS = 4.0  # of a bare one of letters only, in both cases

#: (kind, part, strong, pattern). The value is the group v, or the whole match.
_ASSIGN = r"""["']?\s{0,3}(?:=|:|=>|:=)\s{0,3}["']?"""
_TELLING = r"(?i)(?:secret|token|passw(?:or)?d|pwd|api_?-?key|access_?-?key|private_?-?key|auth)"
_LOGIN = r"://(?P<{0}>[^\s/@:\"'<>]*):(?P<{1}>[^\s@/\"'<>]+)@(?P<{2}>[^\s\"'<>]+)"  # user, password and host of a URL
RULES = [
    ("private_key", "secret", True, re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), "-----BEGIN "),
    ("github_token", "secret", True, re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("slack_token", "secret", True, re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("live_key", "secret", True, re.compile(r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"), "k_"),
    ("google_key", "secret", True, re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), "AIza"),
    ("jwt", "secret", True, re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), "eyJ"),
    ("assigned_secret", "secret", True, re.compile(_TELLING + _ASSIGN + r"(?P<v>[A-Za-z0-9+/_=.~!@#$%^&*-]{12,})"), None),
    ("url_password", "secret", False, re.compile(_LOGIN.format("u", "v", "h")), "://"),
    ("url_user", "id", False, re.compile(_LOGIN.format("v", "p", "h")), "://"),
    ("url_host", "endpoint", False, re.compile(_LOGIN.format("u", "p", "v")), "://"),
    ("aws_key_id", "id", False, re.compile(r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}\b"), "A"),
    ("account_sid", "id", False, re.compile(r"\bAC[0-9a-f]{32}\b"), "AC"),
    ("client_id", "id", False, re.compile(r"\b[0-9]{6,}-[a-z0-9]{10,}\.apps\.[a-z]+\.com\b"), ".apps."),
    ("assigned_id", "id", False, re.compile(r"(?i)(?:client_?-?id|access_?-?key_?-?id|user_?-?name|user|login|account(?:_?-?id)?|tenant_?-?id|app_?-?id)" + _ASSIGN + r"(?P<v>[A-Za-z0-9@._+-]{3,})"), None),
    ("url", "endpoint", False, re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{3,}"), "://"),
    ("cloud_host", "endpoint", False, re.compile(r"(?<![a-z0-9.-])[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63})*\.(?:amazonaws|azure|windows|googleapis|cloudfront|rds|database)\.(?:com|net|org)\b"), "."),
    ("assigned_host", "endpoint", False, re.compile(r"(?i)(?:host(?:name)?|endpoint|server|base_?-?url|region|bucket)" + _ASSIGN + r"(?P<v>[A-Za-z0-9._:/-]{3,})"), None),
    ("assigned_value", "secret", False, re.compile(_TELLING + _ASSIGN + r"""(?P<v>(?<=")[^"\n]{1,300}(?=")|(?<=')[^'\n]{1,300}(?=')|[^\s"'<>,;]+)"""), None),
    ("bare_secret", "secret", False, re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"), None),
]
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_SIGN = re.compile(r"[:=]")
_DIGIT, _LETTER, _LOWER, _UPPER = (re.compile(x) for x in ("[0-9]", "[A-Za-z]", "[a-z]", "[A-Z]"))
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def parts(text: str) -> list[tuple]:
    """(kind, part, strong, start, end, scope, value) of all candidates, at most one for each value's place; earlier rules win.

    Scopes are paragraphs, numbered from 0; blank lines end them.
    """
    long, sign = bool(_LONG.search(text)), bool(_SIGN.search(text))
    found: dict[tuple[int, int], tuple] = {}
    taken = bytearray(len(text))
    for kind, part, strong, pattern, needs in RULES:
        if needs not in text if needs else not (long if kind == "bare_secret" else sign):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v" if "v" in pattern.groupindex else 0)
            value = text[a:b].rstrip(".,;")
            b = a + len(value)
            if kind == "assigned_value" and (clash := taken.find(1, a, b)) >= 0:  # other parts follow without a blank
                b = clash
                value = text[a:b]
            if kind in ("assigned_secret", "bare_secret") and (len(value) < 12 or entropy(value) < BITS_PER_SIGN):
                continue
            if kind == "bare_secret" and not (_DIGIT.search(value) and _LETTER.search(value)) and not (_LOWER.search(value) and _UPPER.search(value) and entropy(value) >= LETTERS_BITS):
                continue
            if a < b and 1 not in taken[a:b]:
                taken[a:b] = b"\1" * (b - a)
                found[a, b] = (kind, part, strong, a, b, value)
    if not found:
        return []
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]
    out, k = [], 0
    for kind, part, strong, a, b, value in sorted(found.values(), key=lambda x: x[3]):
        while k < len(breaks) and breaks[k] < a:
            k += 1
        out.append((kind, part, strong, a, b, k, value))
    return out


def _candidates(batches):
    for batch in pieces(batches):
        rows = []
        for d, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
            if text:
                rows += [(d, h, k, p, s, a, b, scope, hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:16]) for k, p, s, a, b, scope, v in parts(text)]
        if rows:
            yield record("doc_id text_hash kind part strong start end scope value_hash", *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()))])


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of complementary parts (kinds of part that differ) of one text and scope, no more than reach signs apart.

    An interval join: each part stands in the bins of reach signs that it touches, the other side also in those around.
    """
    key = ["doc_id", "text_hash", "scope"]
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    one = found.select(*key, "part", "start", "end", bins(F.col("start") - reach, F.col("end") + reach).alias("bin"))
    two = found.select(*key, F.col("part").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), F.floor(F.col("start") / reach).alias("bin2"))
    near = (F.col("part") != F.col("other")) & (F.col("from") <= F.col("end") + reach) & (F.col("to") >= F.col("start") - reach)
    # A long part may begin before the bins around the other: its end counts too.
    two = two.unionByName(found.filter(F.floor(F.col("end") / reach) > F.floor(F.col("start") / reach)).select(*key, F.col("part").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), F.explode(F.sequence(F.floor(F.col("start") / reach) + 1, F.floor(F.col("end") / reach))).alias("bin2")))
    same = one.doc_id.eqNullSafe(two.doc_id) & (one.text_hash == two.text_hash) & (one.scope == two.scope) & (F.col("bin") == F.col("bin2"))
    return one.join(two, same & near).select(one.doc_id, one.text_hash, one.scope, "part", "start", "end", "other", "from", "to").distinct()


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, kind, part, strength, start, end, scope, value_hash, ids, secrets, endpoints) of all findings.

    Parts are access identifiers, secrets and endpoints; start and end count signs from 0. ids, secrets, endpoints: how many
    parts of those kinds the interval join links to it, in its paragraph and within reach. Strong secrets (of a known form,
    or assigned to a telling name, of 12 signs or more and of high entropy, whatever its alphabet) are always reported. Weak
    candidates (bare strings of high entropy, of letters and digits or of both cases; values of any length and alphabet assigned
    to a telling name, and passwords in URLs; identifiers) are reported as "linked" where complementary parts co-occur: a secret
    with an identifier or endpoint, an identifier or endpoint with a secret. Values are given as hashes only.

    Null and empty texts have no findings. Rows without doc_id are reported with a null. Rows repeated in id and text are
    reported once. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    found = cut(docs.mapInArrow(_candidates, "doc_id long, text_hash long, kind string, part string, strong boolean, start long, end long, scope long, value_hash string").distinct())
    count = lambda part: F.sum(F.when(F.col("other") == part, 1).otherwise(0))
    links = linked(found, reach).groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("start").alias("__a"), F.col("end").alias("__b")).agg(count("id").alias("ids"), count("secret").alias("secrets"), count("endpoint").alias("endpoints"))
    at = found.doc_id.eqNullSafe(F.col("__d")) & (found.text_hash == F.col("__h")) & (found.start == F.col("__a")) & (found.end == F.col("__b"))
    rows = found.join(links, at, "left").fillna(0, ["ids", "secrets", "endpoints"])
    kept = F.col("strong") | F.when(F.col("part") == "secret", F.col("ids") + F.col("endpoints") > 0).otherwise(F.col("secrets") > 0)
    strength = F.when(F.col("strong"), "strong").otherwise("linked")
    return rows.filter(kept).select("doc_id", "kind", "part", strength.alias("strength"), "start", "end", "scope", "value_hash", "ids", "secrets", "endpoints")
