"""Source divergence, centroid clustering and quality rules against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from spanveil.llm import clustering, divergence, quality

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = r"[^\x20\x09-\x0D]+"


# --- source divergence


def slow_audit(rows, least, most):
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []

    def distance(p, q):
        return (p - q) ** 2 // (p + q)

    for lang in {x for x, _ in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for x, s in count if x == lang]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(-sum(distance(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-distance(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(ranked, 1)]
    return collections.Counter(out)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "日本語", "x1y", "a", "Zoë", "don't", "naïve_", "w" * 300] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), "hot" if rng.random() < 0.3 else rng.choice(["a", "b", None, "", "ä", "c\x00d"])
        rows.append((lang, source, rng.choice([None, "", "?! 12"]) if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(1, 40)))))
    return rows + [("fr", "alone", "seul"), ("it", "x", None), ("it", "y", "")] + [("en", "hot", "the same row")] * 30


@pytest.mark.parametrize("small", [False, True])
def test_divergence_by_brute_force(shared, monkeypatch, small):
    if small:  # many runs, blocks, ranges and chunks of pairs; texts longer than a run
        for name, value in {"BLOCK_TERMS": 3, "RANGE_TERMS": 10, "PAIRS": 7, "_HELD_PAIRS": 5}.items():
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(divergence, "RUN_BYTES", 120)
    rows = texts(400)
    rows += [("en", "long", " ".join(f"the w{chr(97 + i % 26)}a" for i in range(3000))), ("en", "long", "the " * 100)]
    frame = shared.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, size int, item string, term int").repartition(4)
    for least in (10, 1):
        got = collections.Counter(tuple(r) for r in divergence.audit(frame, least, 10).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == slow_audit(rows, least, 10)


def test_divergence_without_kept_terms_and_without_rows(shared):
    frame = shared.createDataFrame([("en", "a", "one"), ("en", "b", "two"), ("en", None, None)], "lang string, source string, text string")
    rows = {(r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(frame).collect()}
    assert rows == {("a", "pair", "", 0, 1), ("a", "pair", "b", 0, 2), ("b", "pair", "", 0, 1), ("b", "pair", "a", 0, 2), ("", "pair", "a", 0, 1), ("", "pair", "b", 0, 2)}
    assert divergence.audit(frame.limit(0)).count() == 0


def test_shares_of_counts_that_would_overflow():
    got = divergence.shares(np.array([10**13 + 2, 2, 5]), np.array([3 * 10**13, 7, 5]))
    assert got.tolist() == [1 + 10**9 * (10**13 + 2) // (3 * 10**13), 1 + 2 * 10**9 // 7, 1 + 10**9]


# --- centroid clustering


def whole(x, scale=1024):
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def slow_clusters(rows, k=8, rounds=10):
    vectors = [(i, tuple(map(whole, v))) for i, v in rows]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in vectors]
        for c in range(len(centroids)):
            members = [v for (_, v), x in zip(vectors, at) if x == c]
            if members:
                centroids[c] = tuple(sum(x) // len(members) for x in zip(*members))
    ends = [(i, *nearest(v)) for i, v in vectors]
    total = sum(d for _, d, _ in ends)
    sizes = collections.Counter()
    for _, d, c in ends:
        sizes[c] += d
    return collections.Counter((i, c, d, sizes[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in ends)


def points(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=64)).tolist()) for i in range(n)]
    return rows + [(5000 + i, centres[0].tolist()) for i in range(20)] + [(0, rows[0][1])] * 3 + [(None, rows[1][1])]


VECTORS = "vec_id long, embedding array<double>, cluster int, block string, data int"


@pytest.mark.parametrize("extra", [[], [[3e6] * 64, [-2.0**40] + [0.5] * 63, [1e250] * 64]])
def test_clusters_by_brute_force(shared, monkeypatch, extra):
    monkeypatch.setattr(clustering, "BLOCK", 50)
    rows = points(500 if not extra else 120) + [(9000 + i, v) for i, v in enumerate(extra)]
    junk = [(1, None), (2, [1.0] * 63), (3, [float("nan")] * 64), (4, [float("inf")] * 64), (6, [None] * 64), (7, [])]
    frame = shared.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + junk], VECTORS).repartition(3)
    got = collections.Counter(tuple(r) for r in clustering.cluster_vectors(frame).collect())
    want = collections.Counter()
    for (i, c, d, inertia, total, digest), n in slow_clusters(rows).items():
        want[i, c, *(x if x < 2**63 else None for x in (d, inertia, total)), digest] += n
    assert got == want
    assert not [t.name for t in shared.catalog.listTables() if t.name.startswith("spanveil_blocks")]


def test_few_vectors(shared):
    frame = shared.createDataFrame([(i, v, 1, "x", 2) for i, v in points(3)[:3]], VECTORS)
    assert collections.Counter(tuple(r) for r in clustering.cluster_vectors(frame).collect()) == slow_clusters(points(3)[:3])
    assert clustering.cluster_vectors(frame.limit(0)).count() == 0


def test_a_sphere_is_never_loosened_too_little():
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(300):
        centre, old = rng.integers(-1000, 1000, (2, 6))
        new = old + rng.integers(-300, 300, 6)
        radius = float(rng.uniform(0, 1500))
        way = rng.normal(size=(400, 6))
        inside = centre + way / np.linalg.norm(way, axis=1, keepdims=True) * radius * rng.uniform(0, 1, (400, 1)) ** 0.2
        nearer = np.linalg.norm(inside - old, axis=1) - np.linalg.norm(inside - new, axis=1)
        bound = clustering.nearer_by(centre.tolist(), radius, old.tolist(), new.tolist())
        drift = np.linalg.norm(new - old)
        assert nearer.max() <= bound + 1e-9 and bound <= drift * (1 + 1e-5)
        tighter += bound < 0.9 * drift
    assert tighter > 100
    assert clustering.nearer_by([0], 1.0, [5], [5]) == 0.0


# --- quality rules


def slow_counts(text):
    words = re.findall(WORD, text or "")
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def slow_verdict(text, rules):
    import zstandard

    def side(raw):
        ratio = len(raw) / len(zstandard.ZstdCompressor(level=rules.level, write_content_size=False).compress(raw))
        _, low, high = [b for b in rules.bands if len(raw) >= b[0]][-1]
        return 1 if ratio > high else -1 if ratio < low else 0

    words, _, _, _, repeated = slow_counts(text)
    if words < rules.least_words:
        return "words"
    if 100 * repeated > rules.repeat_percent * words:
        return "repeated"
    raw, size = text.encode(), rules.chunk_bytes
    chunks = [raw[i : i + size] for i in range(0, len(raw), size)]
    if len(chunks) > 1 and len(chunks[-1]) <= size // 2:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    sides = [side(c) for c in chunks]
    for way, name in ((1, "repetitive"), (-1, "incompressible")):
        if side(raw) == way or sides.count(way) > len(sides) * rules.odd_share:
            return name
    return None


def test_quality_by_brute_force(shared, docs):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(800)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    eight = " ".join(vocabulary[:8])
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(40)) for _ in range(200))
    cases = [
        prose(30), prose(400), prose(5000), eight + " " + eight, " ".join(vocabulary[:9] * 5), prose(100) + "\n" + eight + " x " + eight,
        "same line\n" * 40, "a b\na b\n \n \n\x0b\na  b", "# $ | < > & % * " * 10 + prose(60), "\n".join(w * 60 for w in vocabulary[:60]), noise, prose(2000) + noise,
        prose(900)[:4096], prose(2000)[: 4096 + 2048], prose(2000)[: 4096 + 2049], "\x85\xa0 nel\x85nbsp\xa0" * 12,
    ]
    frame = docs.select("doc_id", "text").union(shared.createDataFrame([(100 + i, t) for i, t in enumerate(cases)], "doc_id long, text string"))
    frame = frame.selectExpr("*", "1 as sizes", "'x' as base", "2 as kept", "3 as doc_id_row")
    rules = quality.Rules()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.reason, r.kept) for r in quality.judged(frame).collect())
    want = collections.Counter()
    reasons = set()
    for r in frame.select("doc_id", "text").collect():
        reason = slow_verdict(r.text, rules)
        reasons.add(reason)
        want[r.doc_id, *slow_counts(r.text), reason in ("words", "repeated"), reason, reason is None] += 1
    assert got == want and reasons == {None, "words", "repeated", "repetitive", "incompressible"}
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and kept.count() == sum(n for k, n in want.items() if k[-1])
    assert quality.judged(frame.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8])
def test_windows_of_any_size(shared, window):
    from pyspark.sql import functions as F

    rng = random.Random(window)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 30))]) for i in range(60)]
    found = shared.createDataFrame(rows, "i int, w array<string>").select("i", quality.repeated_words(F.col("w"), window).alias("n")).collect()
    for r in found:
        words, places = rows[r.i][1], collections.defaultdict(list)
        for i in range(len(words) - window + 1):
            places[tuple(words[i : i + window])].append(i)
        assert r.n == len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + window)})
