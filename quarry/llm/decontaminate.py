"""Benchmark decontamination by an FM-index for each shard of training text.

A shard is a run of whole documents within one partition.  Its words become symbols (words that no benchmark item
has share symbol 0, which no phrase contains), the suffix array of the symbols gives the Burrows-Wheeler transform,
and a wavelet tree of the transform answers the rank queries of a backward search.  All phrases (13-word windows;
an item of fewer words is one phrase) are searched at once.  Occurrences are located by sampled suffix positions,
then covered spans are merged per document.

Bounds: an index covers ``SHARD_WORDS`` words or one document, whichever is more.  The phrases are broadcast in blocks of
at most ``MAX_PHRASE_WORDS`` words (or one item), one block at a time, each searched in an index of its own alphabet, and the
spans of all blocks are merged per document.

Defined results: null text has no words and hits nothing; null or empty items have no windows; the windows of an item
without an id hit words, but no item is listed for them; repeated rows are each
judged; an empty table gives an empty result (or no hits); extra columns are kept, but one with the name of the added column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

WINDOW = 13
SHARD_WORDS = 400_000
#: Benchmark words broadcast at once.
MAX_PHRASE_WORDS = 1_000_000
SAMPLE = 8


class WaveletTree:
    """Rank over a sequence of small integers: one bit vector for each bit of the symbol, most significant first."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(upto), upto
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one, zeros = self.ones[k], self.zeros[k]
            right = ((symbol >> level) & 1).astype(bool)
            a, b = one[lo], one[hi]
            lo, hi = np.where(right, zeros + a, lo - a), np.where(right, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        lo, at, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for k in range(self.bits):
            one, zeros = self.ones[k], self.zeros[k]
            bit = one[at + 1] - one[at]
            right = bit.astype(bool)
            symbol = 2 * symbol + bit
            lo, at = np.where(right, zeros + one[lo], lo - one[lo]), np.where(right, zeros + one[at], at - one[at])
        return symbol, at - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes whose order is still open are sorted again."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length()) if n else 1
    width = max(1, 62 // bits)
    width = 1 << (width.bit_length() - 1)  # words packed in the first key
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([seq.astype(np.int64) + 0, np.zeros(width, np.int64)])
    for k in range(width):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    # the rank of a suffix is the first place of its group
    place = np.arange(n, dtype=np.int64)
    group = np.maximum.accumulate(np.where(head, place, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    step = width
    while True:
        alone = head & np.append(head[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order
        items = order[open_at]
        behind = np.where(items + step < n, rank[np.minimum(items + step, n - 1)] + 1, 0)
        by = group[open_at] * np.int64(n + 1) + behind
        again = np.argsort(by, kind="stable")
        by, items = by[again], items[again]
        order[open_at] = items
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = by[1:] != by[:-1]
        head[open_at] = fresh
        group[open_at] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        rank[items] = group[open_at]
        step *= 2


class FMIndex:
    """Counts and locates patterns in a sequence of symbols 0..sigma-1."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        # 0 ends the sequence and is smaller than every symbol
        seq = np.append(seq.astype(np.int64) + 1, 0)
        order = suffix_array(seq)
        last = seq[order - 1]
        self.n = len(seq)
        self.tree = WaveletTree(last, sigma + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        kept = order % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: (n, length) symbols; the half-open suffix range of each."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k].astype(np.int64) + 1
            a = self.less[symbol] + self.tree.rank(symbol, lo[live])
            b = self.less[symbol] + self.tree.rank(symbol, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix-array rows: walk back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        at, todo, steps = rows.astype(np.int64).copy(), np.arange(len(rows)), 0
        while len(todo):
            here = at[todo]
            found = self.marked[here + 1] > self.marked[here]
            out[todo[found]] = self.places[self.marked[here[found]]] + steps
            todo = todo[~found]
            symbol, rank = self.tree.access(at[todo])
            at[todo] = self.less[symbol] + rank
            steps += 1
        return out


_SPLIT = bytes(32 if not (c >= 0x80 or chr(c).isalnum()) else (c + 32 if 0x41 <= c <= 0x5A else c) for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case ASCII letters; words are runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def phrases(items: list[tuple], window: int = WINDOW) -> dict:
    """Vocabulary and, for each phrase length, the distinct phrases with the items that have them (from ``first[k]`` to ``first[k + 1]``)."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, list] = {}
    for place, (_, text) in enumerate(items):
        found = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], dtype=np.int32)
        size = min(window, len(found))
        if size:
            rows = np.lib.stride_tricks.sliding_window_view(found, size)
            by_length.setdefault(size, []).append((rows, np.full(len(rows), place, np.int32)))
    packed = []
    for parts in by_length.values():
        table, which = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
        owner = np.unique(np.stack([which.reshape(-1), np.concatenate([p for _, p in parts])], axis=1), axis=0)
        packed.append((table.astype(np.int64), np.searchsorted(owner[:, 0], np.arange(len(table) + 1)), owner[:, 1]))
    return {"vocabulary": vocabulary, "phrases": packed, "items": [i for i, _ in items]}


def search_shard(texts: list[list[bytes]], known: dict) -> list[tuple[np.ndarray, set]]:
    """For each document of the shard: merged hit spans (n, 2) in words, and the items found (those without an id are not listed)."""
    sizes = [len(t) for t in texts]
    first = np.cumsum([0, *(s + 1 for s in sizes)])  # a 0 parts documents
    items: list[set] = [set() for _ in texts]
    depth = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    get = known["vocabulary"].get
    seq = np.zeros(int(first[-1]), dtype=np.int64)
    for t, a in zip(texts, first, strict=False):
        seq[a : a + len(t)] = np.fromiter((get(w, 0) for w in t), dtype=np.int64, count=len(t))
    index = FMIndex(seq, len(known["vocabulary"]) + 1) if len(seq) and known["phrases"] else None
    for table, begin, owner in known["phrases"] if index else ():
        lo, hi = index.search(table)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        count = hi[hit] - lo[hit]
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)
        at = index.locate(rows)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + table.shape[1], -1)
        doc = np.searchsorted(first, at, "right") - 1
        for pair in np.unique(doc * len(table) + np.repeat(hit, count)).tolist():
            p = pair % len(table)
            items[pair // len(table)].update(known["items"][k] for k in owner[begin[p] : begin[p + 1]].tolist())
    cover = np.cumsum(depth) > 0
    out = []
    for k, size in enumerate(sizes):
        part = np.concatenate([[0], cover[first[k] : first[k] + size].astype(np.int8), [0]])
        out.append((np.flatnonzero(np.diff(part)).reshape(-1, 2), items[k] - {None}))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int):
    """Items in blocks of a bounded number of words, fetched one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id), F.col(text)).where(F.length(text) > 0)
    for row in rows.toLocalIterator():
        n = len(words(row[1]))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


SPANS, ITEMS = "array<array<bigint>>", "array<string>"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, most: int = MAX_PHRASE_WORDS, as_column: str = "decon") -> DataFrame:
    """``docs`` with one more column, struct(n_words, spans, items): merged removal spans in words and items found.

    A benchmark of several blocks is searched block by block; between two the documents found so far are checkpointed and
    the earlier block is released, so the driver and each worker hold one block at a time.
    """
    out, blocks = docs.drop(as_column), _blocks(benchmark, item_id, item_text, most)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(phrases(block, window))
        out = _searched(out, shared, text, as_column)
        if following is None:
            return out
        out = common.checkpoint(out)
        shared.unpersist(blocking=True)
        block = following


def _searched(docs: DataFrame, shared, text: str, as_column: str) -> DataFrame:
    """One block searched; what earlier blocks found is in the column, if it is there."""
    at, again = docs.columns.index(text), as_column in docs.columns

    def run(batches):
        known = shared.value
        for batch in batches:
            shard, size, done = [], 0, 0
            body = batch.column(at)
            for k in range(batch.num_rows):
                shard.append(words(body[k].as_py()))
                size += len(shard[-1]) + 1
                if size >= SHARD_WORDS or k + 1 == batch.num_rows:
                    part = batch.slice(done, len(shard))
                    before = part.column(part.schema.get_field_index(as_column)).to_pylist() if again else None
                    yield _rows(part, shard, known, before, as_column)
                    shard, size, done = [], 0, k + 1

    if again:
        return docs.mapInArrow(run, docs.schema)
    kind = f"struct<n_words:bigint,spans:{SPANS},items:{ITEMS}>"
    return docs.mapInArrow(run, docs.limit(0).withColumn(as_column, F.lit(None).cast(kind)).schema)


def merged(a: list, b: list) -> list:
    """The union of two lists of spans, as spans that do not touch."""
    out: list = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def _rows(part: pa.RecordBatch, shard: list, known: dict, before: list | None, as_column: str) -> pa.RecordBatch:
    found = [(s.tolist(), set(map(str, i))) for s, i in search_shard(shard, known)]
    if before is not None:
        found = [(merged(s, was["spans"]), i | set(was["items"])) for (s, i), was in zip(found, before, strict=True)]
    out = pa.StructArray.from_arrays([
        pa.array([len(t) for t in shard], pa.int64()), pa.array([s for s, _ in found], pa.list_(pa.list_(pa.int64()))),
        pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))], names=["n_words", "spans", "items"])
    names = [n for n in part.schema.names if n != as_column]
    return pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], out], names=[*names, as_column])


def hits(found):
    """Document words inside removal spans, from the column that ``find`` adds."""
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def contaminated(found):
    """Some word is hit, and at least one in twenty."""
    return (hits(found) > 0) & (20 * hits(found) >= found["n_words"])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found, decon = find(docs, common.table(spark, sf_dir, "benchmark")), F.col("decon")
    return found.select(
        "doc_id", decon["n_words"].alias("n_words"), hits(decon).alias("n_hit"), F.size(decon["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(decon["items"], ","), 256).alias("items_sha256"), contaminated(decon).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows in DuckDB, by joining the windows.
ORACLE_SQL = f"""WITH i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 p AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS a FROM i)),
 d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT DISTINCT k FROM i),
 v AS (SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS phrase FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS a FROM d, s WHERE len(w) >= k)),
 o AS (SELECT v.doc_id, v.a, v.k, p.item_id FROM v JOIN p ON p.k = v.k AND p.phrase = v.phrase),
 h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(a, a + k - 1)) AS x FROM o) GROUP BY doc_id),
 m AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM o GROUP BY doc_id)
 SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.listed, '')) AS items_sha256,
 coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""
