"""Operator 10. Information-theoretic sanitisation: terms that reveal protected entities, by corpus co-occurrence, are generalised or removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WORD, BROADCAST_BYTES, by_id, cut, fits, lists, pieces, raw, record, span_hashes

#: Distinct texts, at least, in which term and entity co-occur: from one alone every rare word of it would seem to reveal the entity.
JOINT = 2
GENERALISE, REMOVE = 0.6, 0.85  # disclosure from which on a term is generalised, or removed

#: (kind, pattern, a sign that must occur)
ENTITIES = [
    ("EMAIL", re.compile(r"[\w.+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"), "@"),
    ("IBAN", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), None),
    ("CARD", re.compile(r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])|(?<![0-9])\+(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"), None),
    ("IP", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"), "."),
    ("SSN", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), "-"),
    ("PHONE", re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])"), None),
]
_DIGIT = re.compile(r"[0-9]{2}")
_TOKEN = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected entities; where patterns overlap, the earlier kind wins."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    found: list[tuple[int, int, str]] = []
    for kind, pattern, needs in ENTITIES:
        if needs is None or needs in text:
            own = [m.span() for m in pattern.finditer(text)]
            if own and found:
                taken = np.zeros(len(text) + 1, bool)
                for a, b, _ in found:
                    taken[a:b] = True
                own = [(a, b) for a, b in own if not taken[a:b].any()]
            found += [(a, b, kind) for a, b in own]
    return sorted(found)


def hashed(words: list[str]) -> np.ndarray:
    """The 64-bit hashes of the lower-cased words."""
    data, offsets = raw(pa.array([w.lower() for w in words], pa.string()))
    return span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64) if len(data) else np.zeros(len(words), np.int64)


def terms_of(text: str, found: list[tuple[int, int, str]]) -> set[str]:
    """The distinct terms of the text; tokens within entities aren't terms."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _ in tokens], np.int64)
    free = np.ones(len(tokens), bool)
    for a, b, _ in found:
        free[np.searchsorted(starts, a) : np.searchsorted(starts, b)] = False
    return {text[a:b].lower() for (a, b), ok in zip(tokens, free) if ok}


def _mentions(batches):
    """(key, entities, terms) of every row that has an entity, both distinct."""
    for batch in pieces(batches):
        keys, owners, terms = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            found = entities(text) if text else []
            if found:
                keys.append(key)
                owners.append(sorted({f"{kind} {text[a:b].lower()}" for a, b, kind in found}))
                terms.append(sorted(terms_of(text, found)))
        if keys:
            yield record("key entities terms", pa.array(keys, pa.int64()), *[lists(hashed([w for own in x for w in own]), np.array([len(own) for own in x])) for x in (owners, terms)])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs (key, text), one of each key; only the texts of repeated ones are shuffled."""
    twice = cut(docs.groupBy(F.col("key").alias("__id")).count().filter("count > 1").select("__id"))
    return by_id(docs, twice, "left_anti", "key").unionByName(by_id(docs, twice, "left_semi", "key").dropDuplicates(["key"]))


def _lower_tokens(batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of the lower-cased tokens, as _TOKEN has them."""
    from .common import Tokens, lowered

    tok = Tokens(*lowered(batch), word=_WORD)
    return tok.hash.view(np.int64), tok.doc


def term_frequencies(docs: DataFrame, terms: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(term, df) over all rows of docs, for the written terms: they are broadcast if they fit, else all terms are counted."""
    if fits(terms, 16, limit):
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in terms.collect()], np.int64)))

        def run(batches):
            wanted = shared.value
            total = np.zeros(len(wanted) + 1, np.int64)
            for batch in pieces(batches):
                h, doc = _lower_tokens(batch)
                at = np.searchsorted(wanted, h)
                ok = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == h) if len(wanted) else np.zeros(0, np.int64)
                pair = np.unique(doc[ok] * (len(wanted) + 1) + at[ok])
                total += np.bincount(pair % (len(wanted) + 1), minlength=len(total))
            some = np.flatnonzero(total)
            yield record("term n", wanted[some], total[some])
    else:

        def run(batches):
            for batch in pieces(batches):
                h, doc = _lower_tokens(batch)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                term, n = np.unique(h[first], return_counts=True)
                yield record("term n", term, n)

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return counted.join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, mentions: DataFrame, joint: int = JOINT) -> DataFrame:
    """(entity, term, disclosure) of all that co-occur in joint rows or more: pointwise mutual information over the entity's information.

    disclosure = log(N n(e, t) / (n(e) n(t))) / log(N / n(e)), by numbers of rows; 1: the term has the entity's whole information.
    """
    n = docs.count()
    each = mentions.select(F.explode("entities").alias("entity"), "terms")
    of_entity = cut(each.groupBy("entity").agg(F.count("*").alias("ne")).filter(F.col("ne") >= joint))
    side = F.broadcast(of_entity) if fits(of_entity, 24) else of_entity
    pairs = cut(each.join(side, "entity").select("entity", "ne", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("ne").alias("ne")).filter(F.col("both") >= joint))
    frequencies = cut(term_frequencies(docs, cut(pairs.select("term").distinct())))
    value = F.log(F.lit(float(n)) * F.col("both") / (F.col("ne") * F.greatest("df", "both"))) / F.greatest(F.log(F.lit(float(n)) / F.col("ne")), F.lit(1e-9))
    return pairs.join(frequencies, "term").select("entity", "term", value.alias("disclosure"))


def general(word: str) -> str:
    """What stands for a generalised term."""
    return "[NUMBER]" if word[0].isdigit() else "[NAME]" if word[0].isupper() else "[WORD]"


def sanitise_text(text: str, drop: dict[int, bool]) -> tuple[str, int, int, int]:
    """The text with entities as [KIND], and its terms of the given hashes removed (True) or generalised; and how many of each."""
    found = entities(text)
    out, at, generalised, removed = [], 0, 0, 0

    def clean(piece: str) -> str:
        nonlocal generalised, removed
        if not drop:
            return piece
        spans = [m.span() for m in _TOKEN.finditer(piece)]
        done, last = [], 0
        for (a, b), h in zip(spans, hashed([piece[a:b] for a, b in spans]).tolist()):
            gone = drop.get(h)
            if gone is None:
                continue
            done.append(piece[last:a])
            last = b
            if gone:
                removed += 1
                if done[-1].endswith(" ") and piece[b : b + 1] in (" ", ""):
                    done[-1] = done[-1][:-1]
            else:
                generalised += 1
                done.append(general(piece[a:b]))
        return "".join([*done, piece[last:]])

    for a, b, kind in found:
        out += [clean(text[at:a]), f"[{kind}]"]
        at = b
    return "".join([*out, clean(text[at:])]), len(found), generalised, removed


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, joint: int = JOINT) -> DataFrame:
    """(doc_id, text, entities, generalised, removed) of every document, in place of its row.

    Protected entities (e-mail and IP addresses, telephone, card, account and social security numbers) become their kinds.
    Terms that co-occur with an entity, anywhere in the text, in joint distinct texts or more disclose it by their pointwise
    mutual information with it over the entity's information, both from all distinct texts. In documents with the entity, terms
    that disclose it from generalise on become [WORD], [NAME] or [NUMBER], from remove on they are removed, all over the text.
    Documents without entities stay as they are.

    Null texts stay null, empty ones empty, with 0 of each. Rows without doc_id are sanitised and counted too. Repeated
    texts are sanitised each and count once. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    once = distinct_texts(docs.select("key", "text"))
    mentions = cut(once.mapInArrow(_mentions, "key long, entities array<long>, terms array<long>"))
    told = disclosures(once, mentions, joint).filter(F.col("disclosure") >= generalise).select("entity", "term", (F.col("disclosure") >= remove).alias("gone"))
    told = cut(told)
    which = mentions.select("key", F.explode("entities").alias("entity")).join(told, "entity").groupBy(F.col("key").alias("__key"), "term").agg(F.max("gone").alias("gone"))
    plan = cut(which.groupBy("__key").agg(F.collect_list("term").alias("terms"), F.collect_list("gone").alias("gone")))
    small = (plan.agg(F.sum(F.size("terms") * 9 + 32)).first()[0] or 0) <= BROADCAST_BYTES
    plan = F.broadcast(plan) if small else plan

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for text, terms, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "terms", "gone"))):
                rows.append((text, 0, 0, 0) if not text else sanitise_text(text, dict(zip(terms, gone)) if terms else {}))
            yield record("doc_id text entities generalised removed", batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))])

    return docs.join(plan, F.col("key") == F.col("__key"), "left").select("doc_id", "text", "terms", "gone").mapInArrow(run, "doc_id long, text string, entities int, generalised int, removed int")
