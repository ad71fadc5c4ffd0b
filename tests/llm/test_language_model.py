import math
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import language_model as lm
from sparkloom.llm.common import Tokens, lowered, record

from .conftest import make, odd_rows, prose


def zipf(seed, words=120):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.zipf(1.3, words) % 300)


def brute(corpus, docs):
    """Scores with exact counts in dictionaries, quantised as the filter does."""
    counts = [Counter() for _ in range(lm.ORDER)]
    split = lambda t: "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else " " for c in (t or "").lower()).split()
    for t in corpus:
        w = split(t)
        for k in range(lm.ORDER):
            counts[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    total, kinds = sum(counts[0].values()), len(counts[0])

    def value(g):
        c = counts[len(g) - 1][g]
        return lm.VALUE[1 + math.floor(math.log(c, lm.BASE) + 1e-9)] if c else 0.0

    out = []
    for t in docs:
        w, score = split(t), 0.0
        for i in range(len(w)):
            p, weight = (value((w[i],)) + lm.FLOOR) / (total + lm.FLOOR * (kinds + 1)), lm.WEIGHTS[0]
            for k in range(1, lm.ORDER):
                if i >= k and (h := value(tuple(w[i - k : i]))):
                    share = lm.WEIGHTS[k] / (lm.WEIGHTS[k] + weight)
                    p = share * min(value(tuple(w[i - k : i + 1])) / max(h, 1), 1) + (1 - share) * p
                    weight += lm.WEIGHTS[k]
            score += math.log10(p)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("limit", [lm.BROADCAST_BYTES, 0])
def test_scores_against_exact_counts(spark, limit):
    texts = [zipf(i) for i in range(60)]
    docs = texts[:20] + [prose(5, 50), zipf(1000)]
    got = {r.doc_id: r for r in lm.score(make(spark, list(enumerate(docs))), make(spark, list(enumerate(texts))), broadcast_bytes=limit).collect()}
    close = 0
    for i, (n, s) in enumerate(brute(texts, docs)):
        assert got[i].n_tokens == n
        close += abs(got[i].log10_prob - s) < 0.02 * abs(s)
        assert got[i].perplexity == pytest.approx(10 ** (-got[i].log10_prob / n))
    assert close >= 0.9 * len(docs)  # the filter's false positives move the rest a little
    assert got[20].perplexity > 5 * got[0].perplexity
    assert got[20].unknown > 0.9 * 50 and got[0].unknown == 0


def test_filter_never_loses_and_seldom_invents(spark):
    texts = [zipf(i, 2000) for i in range(20)]
    table, slices, tokens, kinds = lm.train(make(spark, list(enumerate(texts))))
    f = lm.Filter(slices, [(r.slice, bytes(r.bits)) for r in table.collect()])
    tok = Tokens(*lowered(record("text", texts)))
    assert tokens == len(tok.hash) and kinds == len(np.unique(tok.hash))
    for _, h in lm.ngrams(tok):
        g, c = np.unique(h, return_counts=True)
        want = lm.quantise(c)
        have = f.levels(g)
        assert (have >= want).all()
        assert (have != want).mean() < 0.02
    strange = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)
    assert (f.levels(strange) > 0).mean() < 0.02


def test_slices_make_no_difference(spark, monkeypatch):
    docs = make(spark, [(i, zipf(i)) for i in range(30)])
    one = sorted(map(tuple, lm.score(docs).collect()))
    monkeypatch.setattr(lm, "SLICE_BYTES", 3000)
    many = sorted(map(tuple, lm.score(docs.repartition(5, "n_chars")).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in many]
    assert sum(abs(a[3] - b[3]) < 0.02 * abs(a[3]) for a, b in zip(one, many)) >= 28


@pytest.mark.parametrize("own", [True, False])
def test_sliced_scores_equal_broadcast_ones(spark, monkeypatch, own):
    monkeypatch.setattr(lm, "SLICE_BYTES", 3000)
    docs = make(spark, [(i, zipf(i, 300)) for i in range(40)] + [(None, zipf(3)), (99, prose(3)), (98, None), (97, "")])
    corpus = None if own else make(spark, [(i, zipf(i + 7, 200)) for i in range(60)])
    # Part sizes reach workers with the functions, so they are small in both.
    got = [sorted(lm.score(docs, corpus, broadcast_bytes=limit).collect(), key=repr) for limit in (lm.BROADCAST_BYTES, 0)]
    assert len(got[0]) == 44
    for a, b in zip(*got):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) if a[3] is not None else tuple(a) == tuple(b)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 10_000):
        x = np.sort(rng.integers(0, 1 << 62, n, dtype=np.uint64) >> rng.integers(0, 60, n).astype(np.uint64))
        assert np.array_equal(lm.unpack(lm.pack(x)), x)


def test_what_is_gathered_grows_with_the_corpus(spark):
    sizes = [lm.train(make(spark, [(i, zipf(i, 400)) for i in range(n)]))[0].selectExpr("sum(octet_length(bits))").first()[0] for n in (20, 100)]
    assert sizes[1] > 2 * sizes[0]


@pytest.mark.parametrize("limit", [lm.BROADCAST_BYTES, 0])
def test_odd_rows(spark, odd, empty, limit):
    out = lm.score(odd, broadcast_bytes=limit).collect()
    assert len(out) == len(odd_rows())
    none = [r for r in out if r.n_tokens == 0]
    assert len(none) == 5 and all(r.log10_prob is None and r.perplexity is None for r in none)
    assert len({r.log10_prob for r in out if r.doc_id == 8}) == 2
    assert lm.score(empty, broadcast_bytes=limit).count() == 0
    assert lm.score(odd, empty, broadcast_bytes=limit).count() == len(odd_rows())


def test_ngrams_that_occur_once_are_kept(spark):
    texts = [prose(i, 150) for i in range(20)]
    corpus = make(spark, list(enumerate(texts)))
    table, slices, _, _ = lm.train(corpus)
    f = lm.Filter(slices, [(r.slice, bytes(r.bits)) for r in table.collect()])
    for _, h in lm.ngrams(Tokens(*lowered(record("text", texts)))):
        assert (f.levels(h) >= 1).all()
    got = {r.doc_id: r.log10_prob for r in lm.score(corpus).collect()}
    for i, (n, s) in enumerate(brute(texts, texts)):
        assert abs(got[i] - s) < 0.05 * n  # false positives; without the counts of 1 a token is off by more than 1
