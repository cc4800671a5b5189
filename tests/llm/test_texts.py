"""Operators on texts against brute force on small, awkward inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanveil.llm import bpe, line_dedup, packing, pii, simhash, suffix_dedup, token_counts, toxicity

from .conftest import LINE, ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(PATH)


# Byte-pair encoding


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abethin 's.,-\n\téİΣ́½7|<>"), st.characters())))
def test_encode_as_the_library(text):
    enc, library = bpe.encoder(PATH), Tokenizer.from_file(PATH) if "_lib" not in globals() else globals()["_lib"]
    globals()["_lib"] = library
    ids = np.frombuffer(next(enc.encode_many([text])), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    decoder = bpe.Decoder(enc.texts)
    halves = decoder.feed(ids[: len(ids) // 2]) + decoder.feed(ids[len(ids) // 2 :]) + decoder.finish()
    assert halves == library.decode(ids, skip_special_tokens=False)


def test_streaming_equals_merging_at_once(enc):
    random.seed(3)
    for letters in ("ab", "aein th", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(random.choice(letters.replace(" ", "")) for _ in range(6000))
        ids = [enc._inner[b] for b in word.encode()[:-1]] + [enc._final[ord(word[-1])]]
        assert list(enc.merges.stream(ids, buffer=64)) == enc.merges.merge(ids[:])


def test_tokens_before_the_lookahead_never_change(enc):
    random.seed(4)
    far = enc.merges.lookahead
    for _ in range(20):
        head = [random.choice(enc._inner[97:123]) for _ in range(far + 300)]
        cuts = []
        for _ in range(4):
            tail = [random.choice(enc._inner[97:123]) for _ in range(random.randint(0, 40))]
            ends = itertools.accumulate(enc.merges.length[t] for t in enc.merges.merge(head + tail))
            cuts.append([e for e in ends if e <= len(head) - far])
        assert all(c == cuts[0] for c in cuts)


def test_byte_level_decoder_holds_back_unfinished_characters():
    letters = bpe.byte_letters()
    decoder = bpe.Decoder({i: c for i, c in enumerate(letters)}, byte_level=True)
    raw = "aé€\U0001f600z".encode() + b"\xff\xc3"
    assert "".join(decoder.feed([b]) for b in raw) + decoder.finish() == raw.decode("utf-8", "replace")


def test_round_trip_rows(docs, nothing, library):
    rows = bpe.round_trip_digests(docs, PATH).collect()
    want = collections.Counter()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows)) == want
    assert bpe.round_trip_digests(nothing, PATH).count() == 0
    back = bpe.decode_column(bpe.encode_column(docs, PATH), PATH)
    assert back.where("doc_id = 11 and decoded like 'card</w> 4</w> 1</w>%'").count() == 1


# Packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30), st.sampled_from([1, 5, 40, 5000]))
def test_plan_is_gapless_and_close_to_the_bound(counts, groups):
    rows, n = packing.plan_packing(counts, 64, groups)
    sequences, placed = collections.defaultdict(list), collections.Counter()
    for length, start, stop, first, per, offset in rows:
        for rank in range(start, stop):
            j = rank - start
            sequences[first + j // per].append((offset + j % per * length, length))
            placed[length, rank] += 1
    assert placed == collections.Counter({(length, r): 1 for length, c in counts.items() for r in range(c)})
    assert len(sequences) == n
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(k * v for k, v in counts.items())
    assert n <= (2 * -(-total // 64) + 1 if groups >= sum(counts.values()) else sum(counts.values()))


def test_pack_rows(docs, nothing, library):
    rows = packing.pack(docs, PATH).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in dict((i, t) for i, t in ROWS).items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = [(k, k * 2048, np.array(ids[k * 2048 : (k + 1) * 2048], "<u4")) for k in range(-(-len(ids) // 2048))]
        times = sum(j == i for j, _ in ROWS)
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        assert got == sorted([(k, s, len(p), zlib.crc32(p.tobytes())) for k, s, p in pieces] * times)
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])] and sum(parts[-1]) <= 2048
    assert packing.pack(nothing, PATH).count() == 0


# Lines


def brute_lines(rows):
    lines = [(d, n, line.split()) for d, t in {r for r in rows if r[0] is not None} for n, line in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])

    def close(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = collections.defaultdict(list)
    for d, n, w in lines:
        if any((e, m) < (d, n) and close(v, w) for e, m, v in lines):
            gone[d].append(n)
    return dict(gone)


def test_lines_by_brute_force(shared, docs, nothing):
    assert {r.doc_id: r.line_nos for r in line_dedup.repeated_lines(docs).collect()} == brute_lines(ROWS)
    random.seed(5)
    base = [[random.choice("abc") for _ in range(random.randint(7, 11))] for _ in range(12)]
    rows = []
    for d in range(60):
        some = []
        for _ in range(4):
            words = list(random.choice(base))
            for _ in range(random.randint(0, 2)):
                i = random.randrange(len(words))
                words[i : i + random.randint(0, 1)] = random.choice(([], ["a"], ["d"]))
            some.append(" ".join(words))
        rows.append((d, "\n".join(some)))
    frame = shared.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.line_nos for r in line_dedup.repeated_lines(frame).collect()} == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def test_lines_are_taken_out_of_the_text(docs):
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == [*docs.columns, "n_lines", "n_removed"]
    of = collections.defaultdict(set)
    for r in kept.collect():
        of[r.doc_id].add((r.text, r.n_lines, r.n_removed))
    assert of[2] == {("\nsomething else that is short", 4, 2)}
    assert of[9] == {(None, 0, 0)} and of[8] == {("", 1, 0)} and of[None] == {(LINE, 1, 0)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SimHash


def slow_fingerprint(text, words=3):
    parts = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, linked):
    low = dict.fromkeys(ids)
    for i in sorted(ids):
        if low[i] is None:
            low[i], todo = i, [i]
            while todo:
                a = todo.pop()
                for b in ids:
                    if low[b] is None and linked(a, b):
                        low[b] = i
                        todo.append(b)
    return low


def test_simhash_rows(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, t in ROWS if i is not None}
    assert len(rows) == len(ROWS)
    assert all(r.fp & (2**64 - 1) == slow_fingerprint(dict(ROWS)[r.doc_id]) for r in rows)
    low = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == low
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in ROWS if i is not None and low[i] == i)
    assert simhash.near_duplicates(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=120, unique=True), st.integers(0, 2**32))
def test_gray_index_finds_all(codes, seed):
    rng = random.Random(seed)
    codes = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in codes for _ in range(2)})
    arr = np.array(codes, np.uint64)
    query, code = simhash.GrayIndex(arr).search(arr, 3)
    want = {(i, j) for i, a in enumerate(codes) for j, b in enumerate(codes) if (a ^ b).bit_count() <= 3}
    assert set(zip(query.tolist(), code.tolist(), strict=True)) == want and len(query) == len(want)


def test_nodes_meet_across_leading_bits(shared, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_SIZE", 16)
    monkeypatch.setattr(simhash, "BLOCK_SIZE", 16)
    rng = random.Random(8)
    codes = [rng.getrandbits(64) for _ in range(300)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(56, 64), 3)) for c in codes[:100]]
    codes = list(dict.fromkeys(codes))
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    frame = shared.createDataFrame([(c, i) for i, c in enumerate(signed)], "fp long, id long")
    from spanveil.llm.components import connected_components

    found = {r.id: r.component for r in connected_components(simhash.near_links(frame)).collect()}
    low = components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {c: found.get(c, c) for c in signed} == low


# Repeated substrings


def test_repeated_bytes_by_brute_force(shared, docs, nothing):
    extra = [(20, "a" * 300), (21, "b" + "a" * 200), (22, "é" * 60), (23, "x" * 49 + "é" * 60), (24, "ab" * 100), (25, "y" + "ab" * 60 + "퟿")]
    frame = docs.select("doc_id", "text").union(shared.createDataFrame(extra, "doc_id long, text string"))
    texts = {i: (t or "").encode() for i, t in [*ROWS, *extra] if i is not None}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            first.setdefault(texts[d][i : i + 50], d)
    for r in suffix_dedup.repeated_spans(frame).collect():
        raw = texts.get(r.doc_id, LINE.encode())
        mask = bytearray(len(raw))
        for i in range(len(raw) - 49 if r.doc_id is not None else 0):
            if first[raw[i : i + 50]] < r.doc_id:
                mask[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(raw, mask, strict=True) if not m)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), sum(mask), hashlib.sha256(kept).hexdigest())
        assert sum(mask[a:b].count(1) for a, b in zip(r.starts, r.ends, strict=True)) == sum(mask) and len(r.starts) == r.n_spans
    assert suffix_dedup.repeated_spans(nothing).count() == 0


def test_long_texts_are_ranked_in_parts(shared, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 200)
    rng = random.Random(2)
    a, b = ("".join(rng.choice("xyz") for _ in range(3000)) for _ in range(2))
    runs = suffix_dedup.named_runs([a.encode(), (b[:700] + a[500:1700] + b[700:]).encode()])
    covered = collections.defaultdict(int)
    for owner, first, count in zip(*(x.tolist() for x in runs[2:]), strict=True):
        for p in range(first, first + count):
            covered[owner, p] += 1
    assert covered == {(o, p): 1 for o, n in ((0, 3000), (1, 4200)) for p in range(n - 49)}


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_base_spans_by_brute_force(shared, docs, nothing):
    random.seed(6)
    pool = ["+1 (212) 555-0147", "4111 1111 1111 1111", "4111111111111112", "10.0.0.255", "1.2.3.4.5", "300.1.1.1", "a.b@c.de", "a@b.c_d@e.f", "x@y", "é", "😀", " ", ".", "-", "@", "+", "7", "0000255.1.1.1"]
    made = [(100 + i, "".join(random.choice(pool) for _ in range(12))) for i in range(300)]
    made += [(500, "9" * 6000), (501, "1 " * 6000), (502, "a@b" + ".c" * 6000), (503, "+" + "(" * 5000), (504, "a" * 20000)]
    frame = docs.select("doc_id", "text").union(shared.createDataFrame(made, "doc_id long, text string"))
    texts = dict([*ROWS, *made])
    found = pii.report(frame, pii.PiiModel())
    for r in found.collect():
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(joined.encode()).hexdigest(), joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in BASE]
    assert pii.report(nothing, pii.fit(nothing)).count() == 0


def test_trees_add_loose_spellings_and_keep_base_spans(shared):
    random.seed(9)

    def card():
        head = "4" + "".join(random.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if luhn(head + c))

    rows = []
    for i in range(400):
        phone = f"+1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)}"
        rows.append((i, f"text {phone} and {card()} or {'.'.join(str(random.randint(1, 255)) for _ in range(4))} by u{i}@m{i}.org end " + ("4" + card()[1:-1] + "x 12345678 9")))
    frame = shared.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(frame)
    assert set(model.thresholds) >= {"email", "card"}
    new = shared.createDataFrame([(1, "write to bob (at) example (dot) org now"), (2, "pay with 4111.1111.1111.1111 soon"), (3, "plain words only"), (4, None), (5, "card 4111.1111.1111.1112")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(new, model).collect()}
    assert got[1] == "email:9:35" and got[2] == "card:9:28" and got[3] == got[4] == ""
    masked = {r.doc_id: r.text for r in pii.redact(new, model).collect()}
    assert masked[1] == "write to [EMAIL] now" and masked[2] == "pay with [CARD] soon" and masked[4] is None
    first = pii.report(frame, model)
    for r in first.collect():
        assert set(r.spans.split(",")) >= {f"{k}:{a}:{b}" for k, a, b in base_spans(rows[r.doc_id][1])}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Toxicity


def graded(n, seed):
    rng = random.Random(seed)
    texts, grades = [], []
    for _ in range(n):
        g = rng.choice([0, 0, 0, 1, 2])
        words = [f"plain{rng.randint(0, 60)}" for _ in range(30)]
        bad = {0: 0, 1: 2, 2: 8}[g]
        words += [rng.choice(["vileness", "vilest", "rotten", "nasty", "horrid", "awful", "foul", "gross"]) + rng.choice(["", ",", "."]) for _ in range(bad)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    return texts, grades


def test_ordinal_regression_on_held_out_texts():
    model = toxicity.fit_with_cut(*graded(700, 1))
    texts, grades = graded(400, 2)
    scores = np.array([sum(map(model.word_score, toxicity.words_of(t))) for t in texts])
    above = model.exceedance(scores)
    assert model.thresholds == sorted(model.thresholds)
    assert ((above[:, 0] >= model.reject_at) == (np.array(grades) > 0)).mean() > 0.97
    severity = above.sum(axis=1)
    means = [severity[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] + 0.3 < means[1] < means[2] - 0.2


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    score, y, theta = rng.normal(size=20), rng.integers(0, 3, 20), np.array([-0.4, 0.9])

    def loss(s, t):
        edges = np.r_[-np.inf, t, np.inf]
        return -np.log(toxicity._sigmoid(edges[y + 1] - s) - toxicity._sigmoid(edges[y] - s)).sum()

    by_score, by_theta = toxicity._slopes(score, y, theta)
    e = 1e-6
    assert np.allclose(by_score, [(loss(score + e * (np.arange(20) == i), theta) - loss(score - e * (np.arange(20) == i), theta)) / (2 * e) for i in range(20)], atol=1e-4)
    assert np.allclose(by_theta, [(loss(score, theta + e * (np.arange(2) == i)) - loss(score, theta - e * (np.arange(2) == i))) / (2 * e) for i in range(2)], atol=1e-4)


def test_toxic_rows(shared, docs, nothing):
    texts, grades = graded(500, 3)
    labelled = shared.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = shared.createDataFrame([(i, int(g > 0)) for i, g in enumerate(grades)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit_from_labels(labelled, labels)
    found = {r.doc_id: r.rejected for r in toxicity.score(labelled, model).collect()}
    assert np.mean([found[i] == (g > 0) for i, g in enumerate(grades)]) > 0.97
    assert not any(r.rejected for r in toxicity.score(docs, model).collect())
    assert toxicity.drop_toxic(docs, model).count() == len(ROWS) and toxicity.drop_toxic(docs, None).columns == docs.columns
    assert toxicity.fit_from_labels(nothing, labels) is None and toxicity.score(nothing, None).count() == 0


# Token counts


def change(shared, *rows):
    return shared.createDataFrame(list(rows), "doc_id long, version string, action string, source string, lang string, n_tokens long, seq long")


def test_rollup_batches_count_once(shared, tmp_path):
    rollup = token_counts.TokenRollup(shared, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", change(shared, (1, "v", "insert", "s", "en", 10, 1), (2, "v", "insert", "s", None, None, 1), (2, "v", "insert", "s", None, 4, 2), (None, "v", "insert", "s", "en", 9, 1), (3, "v", "delete", None, None, None, 1)))
    second = change(shared, (1, "v", "revise", "t", "en", 7, 1), (2, "v", "delete", None, None, None, 1), (1, "w", "insert", "s", "en", 8, 1))
    assert rollup.commit("b", second) and not rollup.commit("b", second)
    assert sorted(map(tuple, rollup.totals().collect())) == [("s", "en", "w", 1, 8), ("t", "en", "v", 1, 7)]
    again = token_counts.TokenRollup(shared, str(tmp_path / "rollup"))
    assert sorted(again.batches()) == ["a", "b"] and again.documents().count() == 2


def test_a_broken_batch_leaves_no_trace(shared, tmp_path, monkeypatch):
    rollup = token_counts.TokenRollup(shared, str(tmp_path / "broken"))
    rows = change(shared, (1, "v", "insert", "s", "en", 10, 1))
    path = rollup._path
    monkeypatch.setattr(rollup, "_path", lambda name: 1 / 0 if name.startswith("commits/") else path(name))
    with pytest.raises(ZeroDivisionError):
        rollup.commit("a", rows)
    monkeypatch.undo()
    assert rollup.totals().count() == 0 and rollup.commit("a", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 10)]


def test_counts_of_whole_texts(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, "v").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert collections.Counter((r.doc_id, r.n_tokens) for r in rows) == collections.Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert token_counts.count_tokens(nothing, path, public_tokenizers.PATTERN, "v").count() == 0


# Contracts on inputs that once broke them


def test_words_that_only_bytes_tell_apart(enc, library):
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    for texts in ([word, other], [other, word]):
        fresh = bpe.Encoder(PATH)
        got = [np.frombuffer(raw, "<u4").tolist() for raw in fresh.encode_many(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_in_parts_are_the_whole(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    enc = bpe.Encoder(PATH, memo_words=20)
    rng = random.Random(6)
    words = ["the", "é", "don't", "1½", "ΣΑΣ", "x̂", "<|endoftext|>", "日本", "a" * 70, "\n", "\t", "  ", "ee're"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(40)] + ["", None, "x" * 300]
    for text, raw in zip(texts, enc.encode_many(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert b"".join(enc.encode_parts(text or "")) == raw


def test_many_strings_round_one_phrase(shared):
    rng = np.random.default_rng(0)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    raw = letters[rng.integers(0, 26, (400_000, 50))]
    raw[:, 15:35] = np.frombuffer(b"mbwlmkiawjluycjtkrfj", np.uint8)
    rows = pa.table({"doc_id": pa.array(np.arange(len(raw))), "text": pa.array([r.tobytes().decode() for r in raw])})
    found = suffix_dedup.repeated_spans(shared.createDataFrame(rows.to_pandas()))
    assert len({r.tobytes() for r in raw}) == len(raw) and found.where("n_removed > 0").count() == 0


def test_line_dedup_beside_clashing_columns(docs):
    frame = docs.selectExpr("*", "'a' as _gone", "'b' as _gone_id", "array(7) as line_nos", "1 as gone_id", "'c' as n_lines", "'d' as n_removed", "2 as row")
    plain = line_dedup.drop_repeated_lines(docs)
    rich = line_dedup.drop_repeated_lines(frame)
    assert set(rich.columns) == set(frame.columns) and rich.schema["n_lines"].dataType.simpleString() == "bigint"
    columns = ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(str, rich.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert {r._gone for r in rich.collect()} == {"a"}


def test_min_words_of_line_dedup(shared):
    frame = shared.createDataFrame([(1, "one two three four"), (2, "one two three five")], "doc_id long, text string")
    removed = {m: [r.n_removed for r in line_dedup.drop_repeated_lines(frame, min_words=m).orderBy("doc_id").collect()] for m in (4, 5)}
    assert removed == {4: [0, 1], 5: [0, 0]}


def test_positions_asked_for_are_ranked_by_their_own_bytes(monkeypatch):
    """The ranks of a position depend on its 50 bytes alone, and a run's bytes are ranked once for all its positions."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 9000, np.uint8)).decode()
    first, n = np.sort(rng.choice(8900, 4500, False)), rng.integers(1, 32, 4500)
    first[-1], n[-1] = 9000 - 50, 1
    asked = [{"first": int(f), "n": int(k)} for f, k in zip(first, np.minimum(n, 9000 - 49 - first), strict=True)]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 8]), pa.array([5, 6], pa.int32()), pa.array([text, None]), pa.array([asked, None], kind)], names=["doc_id", "tag", "text", "asked"]
    )
    ranked = []
    whole = suffix_dedup._ranks
    monkeypatch.setattr(suffix_dedup, "_ranks", lambda data, *more: ranked.append(len(data)) or whole(data, *more))
    a, b, doc, place = (np.concatenate(x) for x in zip(*suffix_dedup._asked_ranks(batch), strict=True))
    assert sum(ranked) == sum(r["n"] + 49 for r in asked)
    assert (place >> np.uint64(10)).tolist() == [r["first"] + i for r in asked for i in range(r["n"])]
    assert set(doc.tolist()) == {7} and set((place & np.uint64(1023)).tolist()) == {5}
    met: dict[str, set] = {}
    for x, y, p in zip(a.tolist(), b.tolist(), (place >> np.uint64(10)).tolist(), strict=True):
        met.setdefault(text[p : p + 25], set()).add(x)
        met.setdefault(text[p + 25 : p + 50], set()).add(y)
    assert all(len(x) == 1 for x in met.values()) and len({next(iter(x)) for x in met.values()}) == len(met)
