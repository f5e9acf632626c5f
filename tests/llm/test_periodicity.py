import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from costgrain.llm import periodicity


def brute_runs(words):
    """All runs by trying every period: stretches in which words a period apart are the same."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            e = k
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - k >= max(6, 4 * q):
                out.setdefault((k, e + q - k), q)  # periods come in order: the first is the smallest
            k = e + 1
    return sorted((s, n_, q) for (s, n_), q in out.items())


def expected(doc, text):
    words = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    h, n = None if doc is None else zlib.crc32(str(doc).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {k for s, ln, q in found for k in range(s + q, s + ln)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, n, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{ln},{q}\n" for s, ln, q in found)), sha(kept))


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_runs_of_small_alphabets_are_those_of_brute_force():
    draw = random.Random(1)
    texts = [[draw.randrange(k) for _ in range(n)] for k in (1, 2, 2, 2, 3) for n in (0, 1, 2, 5, 6, 7, 30, 64, 200) for _ in range(4)]
    texts += [([0, 1] * 20 + [2]) * 6, [0] * 500, [0, 1, 2] * 50 + [0, 1] * 40, ([0] * 7 + [1]) * 9]
    words = np.array([w for t in texts for w in t])
    sizes = [len(t) for t in texts]
    ends = np.repeat(np.cumsum(sizes), sizes)
    got = list(zip(*(x.tolist() for x in periodicity.runs(words, ends)), strict=True))
    want, base = [], 0
    for t in texts:
        want += sorted(((s + base, n, q) for s, n, q in brute_runs(t)), key=lambda r: (r[0], r[2]))
        base += len(t)
    assert got == want


def test_longest_common_extensions():
    draw = random.Random(2)
    words = np.array([draw.randrange(2) for _ in range(120)])
    ends = np.repeat([50, 120], [50, 70])
    suffixes = periodicity.Suffixes(words, ends)
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120) if ends[a] == ends[b]]
    got = suffixes.lce(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), x in zip(pairs, got.tolist(), strict=True):
        want = 0
        while b + want < ends[b] and words[a + want] == words[b + want]:
            want += 1
        assert x == want, (a, b)


def test_next_smaller_values():
    draw = random.Random(3)
    for n, cut in ((1, 1), (40, 13), (200, 64)):
        values = np.array(draw.sample(range(1000), n))
        ends = np.repeat([cut, n], [cut, n - cut]) if cut < n else np.full(n, n)
        want = [next((k for k in range(i + 1, ends[i]) if values[k] < values[i]), ends[i]) for i in range(n)]
        assert periodicity.next_smaller(values, ends, n).tolist() == want


def test_documents_are_those_of_brute_force(spark, docs, rows):
    planted = [(k, " ".join(random.Random(k).choice(["a", "b", "c d", " e", "f\x0bg"]) for _ in range(60)), "en", "p", 1, *[None] * 6) for k in range(1000, 1120)]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    got = periodicity.periodic_runs(both, F.crc32(F.col("doc_id").cast("string").cast("binary"))).collect()
    want = [expected(r[0], r[1]) for r in [*rows, *planted] if len((r[1] or "").split()) < 5_000]
    long = {r[0] for r in rows if len((r[1] or "").split()) >= 5_000}
    assert in_order(r for r in got if r[0] not in long) == in_order(want)
    assert sum(r.n_runs for r in got) > 10 and {r.doc_id for r in got} >= long


def test_a_long_text_of_one_word(spark):
    row = periodicity.periodic_runs(spark.createDataFrame([(1, "la " * 300_000)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 300_000, 1, 300_000_000)
    assert row.collapsed_sha256 == hashlib.sha256(b"la").hexdigest()


def test_no_rows(empty):
    assert periodicity.periodic_runs(empty).collect() == []
