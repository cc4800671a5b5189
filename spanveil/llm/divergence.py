"""Source divergence audit by single-pass in-memory indexing.

How far does each source of a language write from the others? For every language, the terms in enough of its documents
are kept; each source gives each kept term a smoothed share, and two sources are compared term by term.

1. A task fills its memory with a block of documents, indexes the block (term, documents, occurrences by source) and
   sends it on as a run sorted by hash shard and term; then it starts anew. Spark's shuffle is the spill.
2. A shard's runs come in the order of their first terms and are merged on a heap, one range of terms at a time, into
   document frequencies and occurrences. Terms in too few documents end there.
3. Sums by source and language come from the merged table. If no term were in both sources of a pair, their value
   would follow from how often each count occurs in them; that is the base of all pairs. The merged table is then
   streamed once more: each term corrects the pairs of the sources that both hold it, and names its candidates for
   the most distinctive terms.

All arithmetic is on whole numbers. A hot source or term is one entry of each run.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.sources.workspace import small_side, staged

# Bytes of text that a task indexes at once, and of a longer text that it takes at a time.
RUN_BYTES = 16 << 20
# Terms in a block of a run, and terms that a merge holds before it folds a range.
BLOCK_TERMS = 4096
RANGE_TERMS = 400_000
# Hash shards for each shuffle partition, and pairs expanded at a time.
SHARDS = 4
PAIRS = 1 << 20

SCALE = 1_000_000_000
_HELD_PAIRS = 200_000

# Other ASCII characters than letters separate terms; only A-Z are lower-cased.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_RUN = "shard int, lang string, first binary, serial long, terms binary, sizes binary, docs binary, fan binary, source binary, counts binary, names array<string>"
_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]
_MERGED = "lang string, term string, sources array<string>, counts array<long>"


def _segments(text: str) -> Iterator[bytes]:
    """The text's terms as bytes with blanks between, a bounded part at a time; no term is cut."""
    held = b""
    for at in range(0, len(text), RUN_BYTES):
        held += text[at : at + RUN_BYTES].encode("utf-8", "surrogatepass").translate(_TERMS)
        cut = held.rfind(b" ")
        if at + RUN_BYTES < len(text) and cut >= 0:
            yield held[: cut + 1]
            held = held[cut + 1 :]
    if held:
        yield held


def _binary(sizes: np.ndarray, data) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _index(texts: list[bytes], groups: list[tuple[str, str]], shards: int, serial: int | None = None) -> Iterator[dict]:
    """Rows of one run: its terms by shard, language and term, with document counts and occurrences by source."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = np.r_[False, data != 32, False]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    coded = _binary(ends - starts, data[word[1:-1]]).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = len(terms)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends_of, starts, "right")
    names = sorted(set(groups))
    where = {g: i for i, g in enumerate(names)}
    of_doc = np.array([where[g] for g in groups], np.int64)
    langs = sorted({lang for lang, _ in names})
    lang_of = np.array([langs.index(lang) for lang, _ in names], np.int64)

    held, times = np.unique(doc * n + code, return_counts=True)  # each document's different terms
    group, term = of_doc[held // n], held % n
    listed = terms.to_pylist()
    shard = np.fromiter((zlib.crc32(t) % shards for t in listed), np.int64, n)
    place = np.empty(n, np.int64)
    place[np.lexsort((_ranks(terms), shard))] = np.arange(n)
    key = (lang_of[group] * n + place[term]) * len(names) + group
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts, docs = np.add.reduceat(times, first), np.diff(np.r_[first, len(key)])
    entry = key[first]
    posting, source = entry // len(names), entry % len(names)
    head = np.flatnonzero(np.r_[True, posting[1:] != posting[:-1]])
    fan, in_docs = np.diff(np.r_[head, len(posting)]), np.add.reduceat(docs, head)
    posting = posting[head]
    by_place = np.empty(n, np.int64)
    by_place[place] = np.arange(n)
    lang, term = posting // n, by_place[posting % n]
    kind = lang * shards + shard[term]
    cuts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]).tolist()
    entries = np.r_[0, np.cumsum(fan)]
    for start, end in zip(cuts, [*cuts[1:], len(kind)], strict=True):
        for a in range(start, end, BLOCK_TERMS):
            b = min(end, a + BLOCK_TERMS)
            some = [listed[t] for t in term[a:b].tolist()]
            part = slice(entries[a], entries[b])
            used, local = np.unique(source[part], return_inverse=True)
            yield {
                "shard": int(shard[term[a]]), "lang": langs[lang[a]], "first": some[0], "serial": serial, "terms": b"".join(some),
                "sizes": np.fromiter(map(len, some), "<i4", len(some)).tobytes(), "docs": in_docs[a:b].astype("<i4").tobytes() if serial is None else b"",
                "fan": fan[a:b].astype("<i4").tobytes(), "source": local.astype("<i4").tobytes(), "counts": counts[part].astype("<i4").tobytes(),
                "names": [names[i][1] for i in used.tolist()],
            }


def _ranks(terms: pa.Array) -> np.ndarray:
    out = np.empty(len(terms), np.int64)
    out[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    return out


def _runs(shards: int):
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("serial", pa.int64()), *((c, pa.binary()) for c in _RUN_NAMES[4:10]), ("names", pa.list_(pa.string()))])

    def rows(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        some = []
        for row in found:
            some.append(row)
            if len(some) == 256:
                yield pa.RecordBatch.from_pylist(some, schema)
                some = []
        if some:
            yield pa.RecordBatch.from_pylist(some, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, groups, held = [], [], 0
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                group, text = (lang.as_py(), source.as_py()), text.as_py()
                if len(text) > RUN_BYTES:
                    # Its parts are runs of their own that name the document, which counts once for each term.
                    serial += 1
                    for part in _segments(text):
                        yield from rows(_index([part], [group], shards, serial))
                    continue
                texts.append(text.encode("utf-8", "surrogatepass").translate(_TERMS))
                groups.append(group)
                held += len(texts[-1]) + 64
                if held >= RUN_BYTES:
                    yield from rows(_index(texts, groups, shards))
                    texts, groups, held = [], [], 0
        if texts:
            yield from rows(_index(texts, groups, shards))

    return run


@dataclass
class _Block:
    """What is left of one block of a run: sorted terms with their entries."""

    terms: pa.Array
    docs: np.ndarray
    fan: np.ndarray
    source: np.ndarray
    counts: np.ndarray
    serial: int | None

    def below(self, term: bytes) -> tuple[_Block, _Block | None]:
        """The part with smaller terms, and the rest."""
        low, high = 0, len(self.terms)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.terms[mid].as_py() < term else (low, mid)
        at = int(self.fan[:low].sum())
        part = _Block(self.terms[:low], self.docs[:low], self.fan[:low], self.source[:at], self.counts[:at], self.serial)
        rest = _Block(self.terms[low:], self.docs[low:], self.fan[low:], self.source[at:], self.counts[at:], self.serial)
        return part, rest if len(rest.terms) else None


def _fold(lang: str, parts: list[_Block], sources: list[str], least_docs: int) -> pa.RecordBatch | None:
    """The kept terms of a range of terms, all of whose entries are in ``parts``."""
    coded = pa.concat_arrays([p.terms for p in parts]).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    docs = np.zeros(len(terms), np.int64)
    np.add.at(docs, code, np.concatenate([p.docs for p in parts]))
    marks = [np.full(len(p.terms), -1 if p.serial is None else p.serial, np.int64) for p in parts]
    mark = np.concatenate(marks)
    if (mark >= 0).any():
        seen = np.unique(np.stack([code[mark >= 0], mark[mark >= 0]]), axis=1)[0]
        docs += np.bincount(seen, minlength=len(terms))
    kept = docs >= least_docs
    if not kept.any():
        return None
    entry = np.repeat(code, np.concatenate([p.fan for p in parts]))
    source, counts = (np.concatenate([getattr(p, c) for p in parts]) for c in ("source", "counts"))
    on = kept[entry]
    key, counts = entry[on] * len(sources) + source[on], counts[on].astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, counts = key[first], np.add.reduceat(counts, first)
    term, source = key // len(sources), key % len(sources)
    head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    offsets = pa.array(np.r_[head, len(term)].astype(np.int32))
    named = pa.array(sources, pa.string()).take(pa.array(source))
    texts = terms.take(pa.array(term[head])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(head), pa.string()), texts, pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, pa.array(counts))],
        names=["lang", "term", "sources", "counts"],
    )


def _merge(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, heap, sources, held, full, made = None, [], {}, 0, RANGE_TERMS, 0

        def cut(term: bytes | None) -> Iterator[pa.RecordBatch]:
            """Fold everything below ``term``; blocks that reach it stay on the heap with their rest."""
            nonlocal held, made
            parts = []
            while heap and (term is None or heap[0][0] < term):
                _, _, block = heapq.heappop(heap)
                part, rest = (block, None) if term is None else block.below(term)
                parts.append(part)
                held -= len(part.terms)
                if rest is not None:
                    made += 1
                    heapq.heappush(heap, (rest.terms[0].as_py(), made, rest))
            if parts:
                folded = _fold(shard[1], parts, list(sources), least_docs)
                if folded is not None:
                    yield folded

        for batch in batches:
            for row in batch.to_pylist():
                if shard != (row["shard"], row["lang"]):
                    yield from cut(None)
                    shard, sources, full = (row["shard"], row["lang"]), {}, RANGE_TERMS
                elif held >= full:
                    yield from cut(row["first"])
                    full = held + RANGE_TERMS
                ids = np.array([sources.setdefault(s, len(sources)) for s in row["names"]], np.int64)
                numbers = {c: np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("sizes", "docs", "fan", "source", "counts")}
                docs = numbers["docs"] if row["serial"] is None else np.zeros(len(numbers["sizes"]), np.int64)
                made += 1
                heapq.heappush(heap, (row["first"], made, _Block(_binary(numbers["sizes"], row["terms"]), docs, numbers["fan"], ids[numbers["source"]], numbers["counts"], row["serial"])))
                held += len(docs)
        yield from cut(None)

    return run


def term_frequencies(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, sources, counts): the terms in at least ``least_docs`` documents of a language, with occurrences by source."""
    shards = SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("lang", "source", "text").mapInArrow(_runs(shards), _RUN)
    return runs.repartition("shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(_merge(least_docs), _MERGED)


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / sizes), in steps that no long overflows."""
    whole, rest = np.divmod(counts, sizes)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, sizes)
        whole = whole * 1000 + more
    return 1 + whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_PART = "lang string, part string, source string, item string, value long"


def _part_rows(lang: list[str], part: str, source: list[str], item: list[str], value) -> pa.RecordBatch:
    columns = [lang, [part] * len(lang), source, item]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(value, pa.int64())], names=["lang", "part", "source", "item", "value"])


def _corrections(most_terms: int):
    """Streams term rows: what they change in pairs of sources, and the best terms of each source in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, str, str], int] = {}

        def sent() -> pa.RecordBatch:
            keys = list(pairs)
            out = _part_rows([k[0] for k in keys], "pair", [k[1] for k in keys], [k[2] for k in keys], [pairs[k] for k in keys])
            pairs.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            entries = batch.column("entries")
            fan = np.diff(entries.offsets.to_numpy()).astype(np.int64)
            flat = entries.flatten()
            row = np.repeat(np.arange(len(fan)), fan)
            groups, group = _groups(batch.column("lang"), flat.field("source"), row)
            counts, sizes = (flat.field(c).to_numpy().astype(np.int64) for c in ("count", "size"))
            order = np.lexsort((group, row))
            group, p, p0 = group[order], shares(counts + 2, sizes)[order], shares(np.full(len(sizes), 2), sizes)[order]
            yield from _best_terms(batch, row, group, p, groups, most_terms, counts[order])
            starts = np.cumsum(fan) - fan
            cuts = np.searchsorted(np.cumsum(fan * (fan - 1) // 2), np.arange(PAIRS, int((fan * fan).sum()), PAIRS))
            for some in np.split(np.arange(len(fan)), np.unique(cuts)):
                for a, b in _pair_places(starts[some], fan[some]):
                    change = distance(p[a], p[b]) - distance(p[a], p0[b]) - distance(p0[a], p[b]) + distance(p0[a], p0[b])
                    key = group[a] * len(groups) + group[b]
                    by = np.argsort(key, kind="stable")
                    key, change = key[by], change[by]
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    for k, v in zip(key[first].tolist(), np.add.reduceat(change, first).tolist(), strict=True):
                        (lang, x), (_, y) = groups[k // len(groups)], groups[k % len(groups)]
                        pairs[lang, x, y] = pairs.get((lang, x, y), 0) + v
                    if len(pairs) >= _HELD_PAIRS:
                        yield sent()
        if pairs:
            yield sent()

    return run


def _groups(langs: pa.Array, sources: pa.Array, row: np.ndarray) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The (lang, source) of a batch's entries in rising order, and which one each entry has."""
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    many = len(source.dictionary)
    met, which = np.unique(lang.indices.to_numpy().astype(np.int64)[row] * many + source.indices.to_numpy(), return_inverse=True)
    names = [(lang.dictionary[k // many].as_py(), source.dictionary[k % many].as_py()) for k in met.tolist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return [names[i] for i in order], place[which]


def _pair_places(starts: np.ndarray, fan: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs a < b within each term's entries, about PAIRS at a time even where one term has more."""
    first = np.repeat(starts, fan) + np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
    later = np.repeat(starts + fan, fan) - first - 1
    for some in np.split(np.arange(len(first)), np.unique(np.searchsorted(np.cumsum(later), np.arange(PAIRS, int(later.sum()), PAIRS)))):
        n = later[some]
        if n.sum():
            yield np.repeat(first[some], n), np.repeat(first[some], n) + 1 + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _best_terms(batch: pa.RecordBatch, row: np.ndarray, group: np.ndarray, p: np.ndarray, groups: list, most: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The most distinctive terms of each group in this batch. ``row`` is in order, so the sorted entries keep it."""
    q = shares(batch.column("total").to_numpy().astype(np.int64) + 2, batch.column("total_size").to_numpy().astype(np.int64))[row]
    on = np.flatnonzero((p > q) & (counts > 0))
    terms = batch.column("term")
    value, rank = distance(p[on], q[on]), _ranks(terms.cast(pa.binary()))[row[on]]
    order = np.lexsort((rank, -value, group[on]))
    on, value = on[order], value[order]
    of = group[on]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    nth = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
    on, value = on[nth < most], value[nth < most]
    listed = [groups[g] for g in group[on].tolist()]
    yield _part_rows([g[0] for g in listed], "term", [g[1] for g in listed], terms.take(pa.array(row[on])).to_pylist(), value)


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of pairs as if no term were in both, from how often each count occurs in a source."""
    for batch in batches:
        for r in batch.to_pylist():
            others = [(s, n) for s, n in zip(r["others"], r["other_sizes"], strict=True) if s != r["source"]]
            if not others:
                continue
            value = np.zeros(len(others), np.int64)
            if r["size"]:
                own0, rest0 = shares(np.array([2]), np.array([r["size"]])), shares(np.full(len(others), 2), np.array([n for _, n in others]))
                none = distance(own0, rest0)
                # counted once for each pair, by the smaller source
                value = np.where(np.array([r["source"] < s for s, _ in others]), none * r["terms"], 0)
                for h in r["histogram"] or []:
                    value = value + (distance(shares(np.array([h["count"] + 2]), np.array([r["size"]])), rest0) - none) * h["n"]
            names = [s for s, _ in others]
            yield _part_rows([r["lang"]] * len(names), "pair", [min(s, r["source"]) for s in names], [max(s, r["source"]) for s in names], value)


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for every source of every language.

    Part ``pair``: the other sources of the language, all of them, by falling divergence over all kept terms. Part
    ``term``: the ``most_terms`` kept terms that the source uses more than its language does, by falling divergence.
    Ties go to the smaller item in byte order. Null texts, languages and sources count as empty; repeated rows count each;
    a source without terms is compared like any other; a language without kept terms has pairs of value 0; no rows
    for no documents. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = staged(term_frequencies(slim, least_docs), "term-frequencies")
    groups = staged(slim.select("lang", "source").distinct(), "sources")
    entries = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    histogram = staged(entries.groupBy("lang", "source", "count").agg(F.count("*").alias("n")), "count-histogram")
    sums = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("n")).alias("sum"), F.collect_list(F.struct("count", "n")).alias("histogram"))
    terms = found.groupBy("lang").agg(F.count("*").alias("terms"))
    own = (
        groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
        .select("lang", "source", "histogram", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("sum", F.lit(0)).alias("sum"))
        .withColumn("size", F.col("sum") + 2 * F.col("terms"))
    )
    own = staged(own, "source-totals")
    by_lang = own.groupBy("lang").agg(
        F.collect_list(F.struct("source", "size")).alias("all"), (F.sum("sum") + 2 * F.first("terms")).alias("total_size")
    )
    others = by_lang.select("lang", F.col("all.source").alias("others"), F.col("all.size").alias("other_sizes"))
    bases = own.join(others, "lang").select("lang", "source", "size", "terms", "histogram", "others", "other_sizes").mapInArrow(_bases, _PART)

    sizes = small_side(own.join(by_lang.select("lang", "total_size"), "lang").select("lang", "source", "size", "total_size"))
    rows = (
        entries.join(sizes, ["lang", "source"]).groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "count", "size")).alias("entries"), F.sum("count").alias("total"), F.first("total_size").alias("total_size"))
    )
    streamed = staged(rows.mapInArrow(_corrections(most_terms), _PART), "divergence-parts")

    pairs = bases.unionByName(streamed.where("part = 'pair'")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
    pairs = pairs.select("lang", "value", both.alias("of")).select("lang", F.col("of.a").alias("source"), F.lit("pair").alias("part"), F.col("of.b").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = (
        streamed.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
        .select("lang", "source", "part", "item", "value", "rank")
    )
    return pairs.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", "part", "item", "value", "rank").unionByName(best)
