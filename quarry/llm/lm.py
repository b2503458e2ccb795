"""Language-model scoring by a weighted backoff automaton.

States are contexts: the root, and every run of up to ``order - 1`` tokens that occurs in training.  With counts c and a
prior weight m for each length, a token w after the context h has the probability (c(h w) + m p(w after h')) / (c(h) + m),
where h' is h without its first token; the root discounts each known word by ``DISCOUNT`` and gives what that frees to unknown
words.  So an arc of h is an n-gram of training with that weight, and leads to the longest state that ends what was read;
the failure arc of h leads to h' with the weight m / (c(h) + m), which is what is left to tokens without an arc.  All
probabilities after a state sum to one.  A text starts in the state of the text's beginning and is read once from left to
right: each token takes failure arcs until there is an arc, and the log10 weights are added up.

The automaton of a corpus is too large for one machine, so it is never gathered.  The rows of a partition are cut into
batches of bounded size, which are kept compressed.  A batch asks for its distinct words and n-grams (hashes), with its training counts, in ranges of the hash; a range
task sums the counts of all batches and answers each in the order asked.  The batch then builds the part of the
automaton that its texts can reach, and reads them.  Long texts are read in pieces side by side, each beginning early
enough to be in the right state.

Bounds: a batch has about ``BATCH_BYTES`` of text (or one text), a range the arcs of
about ``RANGE_BYTES``.  A batch sends one row per range that it has arcs in, so rows grow with the batches alone up to
``RANGES`` ranges, and are never more than distinct arcs.

Defined results: null and empty texts are one end token; texts whose id is null are not held out; repeated rows each
count and are each scored; with no training rows every token is unknown and the score is that of unknown words;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

MOD, HELD_OUT = 7, 2
#: Text bytes in a batch, and for each hash range beyond the first ``RANGES``.
BATCH_BYTES, RANGE_BYTES, RANGES = 10_000_000, 8_000_000, 8
#: Text bytes below which a batch is not cut, however many tasks there are.
LEAST_BYTES = 1_000_000
ORDER = 3
#: Prior weights of contexts of one token, of two, and of all longer ones.
PRIORS, DISCOUNT = (300.0, 10.0), 0.75
END = np.uint64(0x51ED270B9D3A1F27)
START = np.uint64(0x2545F4914F6CDD1D)
#: Bits of an n-gram's hash (words have 64), and tokens that one lane of a traversal reads.
GRAM_BITS, LANE = 52, 512


def _tokens(column):
    """Hashes of all tokens of a column, an end token after each text, and each text's first token."""
    data, bounds = common.utf8(column)
    parts, sizes = [], []
    for a, b in common.chunks(bounds):
        part, edge = common.LOWER[data[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]
        starts, ends, first = common.word_spans(part, edge, common.NONSPACE)
        own = np.diff(first) + 1
        out = np.full(int(own.sum()), END, dtype=np.uint64)
        last = np.cumsum(own) - 1
        keep = np.ones(len(out), dtype=bool)
        keep[last] = False
        out[keep] = common.hash_spans(part, starts, ends)
        parts.append(out)
        sizes.append(own)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Bytes by significance, which compresses sorted hashes and small counts."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1) if len(x) else b""


def _unpack(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def _delta(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _counted(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of less than 64 bits, sorted, and how often each has ``own`` set."""
    if not len(keys):
        return keys, np.zeros(0, np.uint32)
    both = np.sort((keys << np.uint64(1)) | own.astype(np.uint64))
    keys = both >> np.uint64(1)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(both & np.uint64(1), head).astype(np.uint32)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the distinct sorted keys, and a place of each distinct key."""
    if not len(keys):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    # the leading bits are sorted together with the place; few keys that differ have equal ones
    bits = max(1, int(len(keys) - 1).bit_length())
    spare = np.uint64(max(0, int(keys.max()).bit_length() + bits - 64))
    both = np.sort(((keys >> spare) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64))
    order = (both & np.uint64((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
    both >>= np.uint64(bits)
    ranked = keys[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    mixed = np.flatnonzero(head[1:] & (both[1:] == both[:-1]))
    if len(mixed):
        lead = np.unique(both[mixed])
        for a, b in zip(np.searchsorted(both, lead, "left").tolist(), np.searchsorted(both, lead, "right").tolist(), strict=True):
            order[a:b] = order[a:b][np.argsort(keys[order[a:b]])]
            ranked[a:b] = keys[order[a:b]]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    del both, ranked
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return out, order[head]


class Batch:
    """Texts as tokens: ``words`` are the hashes of the tokens, ``grams(k)`` those of the k tokens up to each."""

    def __init__(self, column, order: int):
        self.words, self.first = _tokens(column)
        self.n, self.order = len(self.first) - 1, order
        self.begin = np.arange(len(self.words), dtype=np.int32)  # tokens of the same text before each
        self.begin -= np.repeat(self.first[:-1].astype(np.int32), np.diff(self.first))

    def grams(self):
        """For k = 2 up to the order: (k, tokens that have k - 1 before them, counting the text's beginning (None: all), hashes there)."""
        shift, whole = np.uint64(64 - GRAM_BITS), np.full(len(self.words), START, np.uint64)
        inside = self.begin > 0
        whole[inside] = self.words[np.flatnonzero(inside) - 1]
        key = common.join_hash(whole, self.words) if len(self.words) else whole
        del whole, inside
        yield 2, None, key >> shift
        for k in range(3, self.order + 1):
            at = np.flatnonzero(self.begin >= k - 2)
            part = common.join_hash(key[at - 1], self.words[at])
            if k < self.order:
                key = np.zeros(len(self.words), np.uint64)
                key[at] = part
            yield k, at, part >> shift

    def arcs(self, own: np.ndarray):
        """Distinct words (with the text's beginning) and n-grams, each with its training counts."""
        trained = np.repeat(own, np.diff(self.first))
        place, rep = _places(np.append(self.words, START))
        words = np.append(self.words, START)[rep]
        counts = np.bincount(place, weights=np.append(trained, own.sum()), minlength=len(words)).astype(np.uint32)
        found = [(g, trained if at is None else trained[at]) for _, at, g in self.grams()]
        return words, counts, *_counted(np.concatenate([g for g, _ in found]), np.concatenate([t for _, t in found]))


def _edges(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each hash range begins among the sorted keys."""
    return np.append(np.searchsorted(keys, np.array([k * (2**bits // n) for k in range(n)], dtype=np.uint64)), len(keys))


class Automaton:
    """The part of the automaton that a batch can reach; states are numbered: the root, then words, then n-grams."""

    def __init__(self, batch: Batch, word_counts: np.ndarray, gram_counts: np.ndarray, total: int, vocabulary: int, priors=PRIORS, discount: float = DISCOUNT):
        self.batch = batch
        place, _ = _places(np.append(batch.words, START))
        self.word, self.start = place[:-1], int(place[-1]) if len(place) else 0
        tokens, keys = [], []  # of the n-grams of each length
        for _, at, g in batch.grams():
            tokens.append(at)
            keys.append(g)
        offsets = np.cumsum([0, *map(len, keys)])
        keys = np.concatenate(keys)
        place, rep = _places(keys)
        del keys
        c1, c = word_counts.astype(np.float64), gram_counts.astype(np.float64)
        if len(c1) != int(max(self.word.max(initial=0), self.start)) + 1 or len(c) != len(rep):
            raise ValueError("the answers do not fit the arcs asked for")
        self.known = c1 > 0
        # at[k]: for each token, its arc for a context of k tokens (-1: none)
        self.at: list[np.ndarray] = [self.word, place[: offsets[1]]]
        for at, a, b in zip(tokens[1:], offsets[1:-1], offsets[2:], strict=True):
            arc = np.full(len(batch.words), -1, np.int32)
            arc[at] = place[a:b]
            self.at.append(arc)
        kind = (np.searchsorted(offsets, rep, "right") + 1).astype(np.int8)  # of each distinct n-gram: its length, and a token that it ends at
        token = rep.astype(np.int64)
        for k, at in enumerate(tokens[1:], 3):
            token[kind == k] = at[token[kind == k] - offsets[k - 2]]
        del tokens, rep
        words = len(c1)
        root = np.where(self.known, (c1 - discount) / max(total, 1), discount * vocabulary / total if total else 1.0)
        self.weight, self.failure, self.fails_to = [np.log10(root)], np.zeros(1 + words + len(c)), np.zeros(1 + words + len(c), np.int32)
        self.failure[1 : 1 + words] = np.log10(priors[0] / (c1 + priors[0]))
        self.state_of_word = np.where(self.known, 1 + np.arange(words), 0).astype(np.int32)
        p = np.zeros(len(c))  # probabilities of the n-grams that are arcs
        for k in range(2, batch.order + 1):
            of = np.flatnonzero((kind == k) & (c > 0))
            t = token[of]
            if k == 2:
                lower = root[self.word[t]]
                context = c1[np.where(batch.begin[t] > 0, self.word[t - 1], self.start)]
            else:
                lower, context = p[self.at[k - 2][t]], c[self.at[k - 2][t - 1]]
            m = priors[min(k - 2, len(priors) - 1)]
            p[of] = (c[of] + m * lower) / (context + m)
            if k < batch.order:  # such an n-gram is a state too
                more = priors[min(k - 1, len(priors) - 1)]
                self.failure[1 + words + of] = np.log10(more / (c[of] + more))
                self.fails_to[1 + words + of] = 1 + (self.word[t] if k == 2 else words + self.at[k - 2][t])
        self.arc = c > 0
        self.weight.append(np.log10(p, out=np.zeros(len(p)), where=self.arc))
        #: where the arc of an n-gram leads: to itself if it is a state, else to its longest end that is one
        leads = np.arange(1 + words, 1 + words + len(c), dtype=np.int32)
        top = np.flatnonzero(kind == batch.order)
        leads[top] = self.state_of_word[self.word[token[top]]] if batch.order == 2 else 1 + words + self.at[batch.order - 2][token[top]]
        self.leads = leads
        self.levels = np.concatenate([[0], np.ones(words, np.int8), kind]).astype(np.int8)

    def read(self) -> np.ndarray:
        """The log10 probability of every token, in one pass from left to right; many lanes read side by side."""
        batch, context = self.batch, self.batch.order - 1
        size = np.diff(batch.first)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(batch.n), lanes)
        piece = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = batch.first[text] + piece * LANE
        end = np.minimum(own + LANE, batch.first[text + 1])
        begin = np.maximum(own - context, batch.first[text])  # the state is known after as many tokens as a context has
        order = np.argsort(begin - end, kind="stable")
        own, end, begin = own[order], end[order], begin[order]
        state = np.where(begin == batch.first[text[order]], self.state_of_word[self.start], 0).astype(np.int32)
        out = np.zeros(len(batch.words))
        longest = end - begin
        for step in range(int(longest.max(initial=0))):
            live = int(np.searchsorted(-longest, -step, "left"))  # lanes that still have a token
            t, now = begin[:live] + step, state[:live]
            score, then, open_ = np.zeros(live), self.state_of_word[self.word[t]], np.ones(live, bool)
            for level in range(context, 0, -1):
                at = np.flatnonzero(open_ & (self.levels[now] == level))
                arc = self.at[level][t[at]]
                has = (arc >= 0) & self.arc[arc]
                took, arc = at[has], arc[has]
                score[took] += self.weight[1][arc]
                then[took] = self.leads[arc]
                open_[took] = False
                failed = at[~has]
                score[failed] += self.failure[now[failed]]
                now[failed] = self.fails_to[now[failed]]
            at = np.flatnonzero(open_)
            score[at] += self.weight[0][self.word[t[at]]]
            mine = t >= own[:live]
            out[t[mine]] = score[mine]
            state[:live] = then
        return out


def _packed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Training flags with texts, (batch, raw) with the compressed rows of each batch, and the numbers of tasks and of ranges.

    A batch is a run of rows of one input partition, so equal rows and hot keys are cut like any others.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = common.partitions(spark, -(-size // BATCH_BYTES))
    most = max(LEAST_BYTES, min(BATCH_BYTES, -(-size // tasks)))
    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).withColumn(
        "train", F.coalesce(common.crc_mod("doc", MOD) != HELD_OUT, F.lit(True)))

    def pack(parts):
        rows, held = [], 0

        def made():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in rows:
                    stream.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["raw"])

        for part in parts:
            _, bounds = common.utf8(part.column("body"))
            for a, b in common.chunks(bounds, max(1, min(most, common.CHUNK_BYTES))):
                more = int(bounds[b] - bounds[a])
                if rows and held + more > most:
                    yield made()
                    rows, held = [], 0
                rows.append(part.slice(a, b - a))
                held += more
        if rows:
            yield made()

    # sorted, so that a task that is run again cuts the same batches, in whatever order its rows arrive
    packed = base.sortWithinPartitions("doc", "body").mapInArrow(pack, "raw binary").withColumn("batch", F.monotonically_increasing_id())
    return base, packed, tasks, max(RANGES, -(-size // RANGE_BYTES))


def _unpacked(table: pa.Table) -> pa.Table:
    """The rows of a batch."""
    return pa.concat_tables([pa.ipc.open_stream(raw.as_buffer()).read_all() for raw in table.column("raw")])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, priors=PRIORS, discount: float = DISCOUNT) -> DataFrame:
    """One row per row of ``docs`` with the columns of the contract; ``order`` is 2 or more."""
    base, packed, tasks, ranges = _packed(docs, doc_id, text)

    def count(parts):
        """Distinct trained words of a part of a partition, with their counts."""
        for part in parts:
            token, first = _tokens(part.column("body"))
            token = token[np.repeat(np.array(part.column("train").to_pylist(), dtype=bool), np.diff(first))]
            keys, n = np.unique(token, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    words = base.select("body", "train").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total, vocabulary = words.agg(F.sum("n"), F.count("*")).first()
    total, vocabulary = int(total or 0), int(vocabulary)
    width = np.uint32 if total < 2**32 else np.uint64

    def ask(key, table):
        table = _unpacked(table)
        batch = Batch(table.column("body"), order)
        words, n, grams, m = batch.arcs(np.array(table.column("train").to_pylist(), dtype=bool))
        u, v = _edges(words, ranges, 64), _edges(grams, ranges, GRAM_BITS)
        full = [k for k in range(ranges) if u[k + 1] > u[k] or v[k + 1] > v[k]]
        cut = lambda x, e, k: x[e[k] : e[k + 1]]
        kinds = {"batch": pa.array([key[0].as_py()] * len(full), pa.int64()), "range": pa.array(full, pa.int32())}
        kinds |= {name: pa.array([_pack(f(cut(x, e, k))) for k in full], pa.binary()) for name, x, e, f in (
            ("words", words, u, _delta), ("word_n", n, u, lambda x: x), ("grams", grams, v, _delta), ("gram_n", m, v, lambda x: x))}
        return pa.table(kinds)

    def summed(table, keys: str, counts: str) -> list[bytes]:
        """The sums over all rows, for each row in the order of its keys."""
        asked = [(np.cumsum(_unpack(k, np.uint64), dtype=np.uint64), _unpack(c, np.uint32)) for k, c in zip(table.column(keys).to_pylist(), table.column(counts).to_pylist(), strict=True)]
        where, rep = _places(np.concatenate([k for k, _ in asked]))
        sums = np.bincount(where, weights=np.concatenate([c for _, c in asked]), minlength=len(rep)).astype(width)
        ends = np.cumsum([len(k) for k, _ in asked])
        return [_pack(sums[part]) for part in np.split(where, ends[:-1])]

    def answer(key, table):
        return pa.table({"batch": table.column("batch"), "range": table.column("range"), "words": pa.array(summed(table, "words", "word_n"), pa.binary()),
                         "grams": pa.array(summed(table, "grams", "gram_n"), pa.binary())})

    def walk(key, left, right):
        left = _unpacked(left)
        batch = Batch(left.column("body"), order)
        told = sorted(zip(right.column("range").to_pylist(), right.column("words").to_pylist(), right.column("grams").to_pylist(), strict=True))
        known = [np.concatenate([_unpack(row[k], width) for row in told] or [np.zeros(0, width)]) for k in (1, 2)]
        automaton = Automaton(batch, *known, total, vocabulary, priors, discount)
        word = known[0][automaton.word].astype(np.float64)
        sums = lambda x: np.add.reduceat(x, batch.first[:-1]) if batch.n else np.zeros(0)
        base_score = sums(np.log10((word + 1) / (total + vocabulary + 1)))
        train = np.array(left.column("train").to_pylist(), dtype=bool)
        return pa.table({"doc_id": left.column("doc"), "held_out": pa.array(~train), "n_tokens": pa.array(np.diff(batch.first)), "n_known": pa.array(sums((word > 0).astype(np.int64))),
                         "train_tokens": pa.array(np.full(batch.n, total, np.int64)), "base_score": pa.array(base_score), "score": pa.array(sums(automaton.read()))})

    dealt = packed.repartition(tasks, "batch")
    asked = dealt.groupBy("batch").applyInArrow(ask, "batch long, range int, words binary, word_n binary, grams binary, gram_n binary")
    told = asked.groupBy("range").applyInArrow(answer, "batch long, range int, words binary, grams binary")
    kind = docs.schema[doc_id].dataType.simpleString()
    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
