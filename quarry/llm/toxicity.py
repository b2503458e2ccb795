"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers have states, input, output and weights, and each reads what the one before it wrote.  Two lexical ones read words
and write insults and threats with learned weights; one marks those that a negation goes before, one those that are reported,
before or after, one those of a clause that has a target.  What lies ahead is guessed: a path whose guess fails ends nowhere, so a
clause has one path, whose weight is the clause's.  The composition is made as its states are met.  A logistic regression over a
text's clauses gives the score, so clauses are judged, not lone words.

Insult and threat words and word beginnings are learned: their support is the number of different contexts (previous and next
word) in toxic training texts, so copies of one text don't count as evidence, set against their frequency in other texts; those that mostly
stand between a word of intent and a target are threats.  The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hashes
of their id, which bounds the learned words too; every text is then scored.  No text comes to the driver: it gets the learned words, and
nine numbers for each row of the fit.

Defined results: null and empty texts have no matches and get the score of a text without matches; with no toxic or no
other training rows the score is the rate of toxic rows (0 without any); several labels of one id count as toxic if
any is; null labels are not used; repeated rows are each scored; extra columns are kept by ``scored``,
but one with the name of the added column is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Labelled rows that the fit uses at most, and words and beginnings that are broadcast to be counted (more are counted all).
SAMPLE, SENT = 20_000, 300_000
THRESHOLD = 0.3
MOD, HELD_OUT = 4, 2

#: Parts of a symbol: what a word is, and the marks that transducers write on matches.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, NEGATED, REPORTED, TARGETED = (1 << k for k in range(10))
MATCH = INSULT | THREAT
#: Words between a match and what is said of it, and what the marks weigh.
NEGATION_REACH, REPORT_REACH = 3, 8
WEIGHTS = {NEGATED: -1.0, REPORTED: -0.5, TARGETED: 0.5}
#: Closed word classes of the grammar; the threats are seeds, beside which others are learned; words of intent.
WORDS = {
    THREAT: "kill hurt destroy punish strangle stab shoot töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours he she they him her them his their du dich dein ihr euch er sie tu te vous il elle ils elles tú te usted ustedes él ella ellos ellas",
    NEGATION: "not no never none neither nor nicht kein keine niemals ne pas jamais non nunca jamás ni",
    REPORT: "said says say told called quoted reported wrote sagte sagt schrieb dit disait écrit dijo dice escribió",
}
INTENT = frozenset("will shall gonna ll werde werden wirst wird vais va allons vont voy va vamos van".split())
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”„«»]")
PREFIXES = (4, 5, 6)
FEATURES = 9


class Transducer:
    """step(state, symbol) gives the arcs: (output symbol, weight, next state); a path counts if it ends in a final state."""

    def __init__(self, start, step, final):
        self.start, self._step, self.final = start, step, final
        self.known: dict = {}

    def step(self, state, symbol: int) -> list[tuple[int, float, object]]:
        found = self.known.get((state, symbol))
        if found is None:
            found = self.known[state, symbol] = list(self._step(state, symbol))
        return found

    def best(self, symbols: list[tuple[int, float]]) -> tuple[float, list[int]] | None:
        """The weight of the best path and its marked matches; what a symbol brings along is added."""
        paths = {self.start: (0.0, None)}
        for symbol, given in symbols:
            ahead: dict = {}
            for state, (total, marked) in paths.items():
                for out, weight, then in self.step(state, symbol):
                    if then not in ahead or total + weight + given > ahead[then][0]:
                        ahead[then] = (total + weight + given, (marked, out) if out & MATCH else marked)
            paths = ahead
        ends = [found for state, found in paths.items() if self.final(state)]
        if not ends:
            return None
        total, marked = max(ends, key=lambda e: e[0])
        matches = []
        while marked:
            marked, out = marked
            matches.append(out)
        return total, matches[::-1]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """``second`` reads what ``first`` writes."""

    def step(state, symbol):
        for out, weight, then in first.step(state[0], symbol):
            for out2, weight2, then2 in second.step(state[1], out):
                yield out2, weight + weight2, (then, then2)

    return Transducer((first.start, second.start), step, lambda state: first.final(state[0]) and second.final(state[1]))


def _lexical(bit: int, lexicon: dict[str, float]):
    """A transducer of one state that reads a word with its symbol and writes ``bit`` into the symbol of one that it knows, with its weight."""
    def read(word: str, symbol: int) -> tuple[int, float]:
        weight = max(lexicon.get(f, 0.0) for f in features_of(word))
        return (symbol | bit, weight) if weight > 0 else (symbol, 0.0)

    return read


def _negation() -> Transducer:
    """State: in how many words a negation ends."""
    def step(left, x):
        out = x & ~NEGATION
        marked = x & MATCH and left
        yield (out | NEGATED, WEIGHTS[NEGATED], left - 1) if marked else (out, 0.0, NEGATION_REACH if x & NEGATION else max(0, left - 1))

    return Transducer(0, step, lambda left: True)


def _reported() -> Transducer:
    """State: words that earlier speech still reaches, words in which none may follow, words within which it must (0: need not)."""
    def step(state, x):
        before, never, must = state
        out = x & ~(REPORT | QUOTE)
        if x & REPORT:
            if never:
                return  # it was guessed that none follows
            must = 0
        elif must:
            must -= 1
            if not must:
                return  # it was guessed that one follows
        never = max(0, never - 1)
        now = REPORT_REACH if x & (REPORT | QUOTE) else max(0, before - 1)
        if not x & MATCH:
            yield out, 0.0, (now, never, must)
        elif before or x & REPORT:
            yield out | REPORTED, WEIGHTS[REPORTED], (now, never, must)
        else:
            if not must:
                yield out, 0.0, (now, REPORT_REACH, 0)
            if (must or REPORT_REACH) > never:
                yield out | REPORTED, WEIGHTS[REPORTED], (now, never, must or REPORT_REACH)

    return Transducer((0, 0, 0), step, lambda state: not state[2])


def _targeted() -> Transducer:
    """State: nothing read; no target in the clause; one that is still to come; one that came."""
    def step(state, x):
        out = x & ~TARGET
        if state in ("", "none") and not x & TARGET:
            yield out, 0.0, "none"
        if state != "none":
            there = "came" if x & TARGET or state == "came" else "comes"
            yield (out | TARGETED, WEIGHTS[TARGETED], there) if x & MATCH else (out, 0.0, there)

    return Transducer("", step, lambda state: state != "comes")


class Grammar:
    """The lexical transducers of learned insults and threats (word or beginning -> weight), and the composition of the others."""

    def __init__(self, lexicon: dict[str, float], threats: dict[str, float] | None = None):
        self.lexicon, self.threats = lexicon, threats or {}
        self.insult = _lexical(INSULT, self.lexicon)
        self.threat = _lexical(THREAT, self.threats | dict.fromkeys(WORDS[THREAT].split(), 1e-9))
        self.clauses = compose(compose(_negation(), _reported()), _targeted())
        self.closed: dict[str, int] = {}
        for bit, listed in WORDS.items():
            for w in listed.split() if bit != THREAT else ():
                self.closed[w] = self.closed.get(w, 0) | bit
        self.cache = _Cache(self)

    def look(self, word: str) -> tuple[int, float]:
        """What the lexical transducers write of a word: the second reads what the first wrote."""
        if not word[0].isalpha():
            return (END if word in ".!?;\n" else QUOTE), 0.0
        symbol, one = self.insult(word, self.closed.get(word, 0))
        symbol, two = self.threat(word, symbol)
        return symbol, one + two

    def matches(self, text: str | None) -> tuple[np.ndarray, int]:
        """Matched clauses: weight, insult, threat, target, negated, reported; and the number of words."""
        words = TOKEN.findall((text or "").lower())
        found = [self.cache[w] for w in words]
        out = []
        hits = [k for k, (x, _) in enumerate(found) if x & MATCH]
        k = 0
        while k < len(hits):
            first = last = hits[k]
            while first and found[first - 1][0] != END:
                first -= 1
            while last < len(found) and found[last][0] != END:
                last += 1
            weight, marked = self.clauses.best(found[first:last])
            said = 0
            for x in marked:
                said |= x
            out.append((max(weight, 0.0), bool(said & INSULT), bool(said & THREAT), bool(said & TARGETED), bool(said & NEGATED), bool(said & REPORTED)))
            while k < len(hits) and hits[k] < last:
                k += 1
        return np.array(out, dtype=np.float64).reshape(-1, 6), len(words)

    def vector(self, text: str | None) -> np.ndarray:
        """What the regression sees of a text."""
        m, n = self.matches(text)
        if not len(m):
            return np.zeros(FEATURES)
        plain = (m[:, 4] == 0) & (m[:, 5] == 0)
        insult = m[:, 1] * m[:, 0]
        return np.array([
            math.log1p((insult * plain).sum()), math.log1p((insult * m[:, 3] * plain).sum()), math.log1p((insult * m[:, 4]).sum()),
            math.log1p((insult * m[:, 5]).sum()), math.log1p(insult.max()), math.log1p((m[:, 2] * m[:, 3] * plain).sum()),
            math.log1p((m[:, 2] * (1 - m[:, 3])).sum()), 1.0 if (insult > 0).sum() > 1 else 0.0,
            insult.sum() / math.sqrt(n + 1)])


class _Cache(dict):
    """Classes of the words seen; cleared when large."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        found = self[word] = self.grammar.look(word)
        return found


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def learn(train: DataFrame, pos: int, neg: int) -> tuple[dict[str, float], dict[str, float]]:
    """Insults and threats: words and beginnings that only toxic texts explain, with weights, from train (row, y, body).

    Contexts and frequencies are counted in tasks; only features with enough support are sent around, if they are few
    enough, and only those that pass the test come to the driver.  Threats are those of which at least half of the rows have them
    between a word of intent and a target.
    """
    spark, targets = train.sparkSession, frozenset(WORDS[TARGET].split())

    def contexts(batches):
        for batch in batches:
            found = set()
            for row, t in zip(batch.column("row").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = ["", *[w for w in TOKEN.findall((t or "").lower()) if w[0].isalpha()], ""]
                for k in range(1, len(words) - 1):
                    around = int.from_bytes(hashlib.blake2b(f"{words[k - 1]} {words[k + 1]}".encode(), digest_size=8).digest(), "little", signed=True)
                    aims = words[k - 1] in INTENT and not targets.isdisjoint(words[k + 1 : k + 3]) or words[k - 1] in targets and not INTENT.isdisjoint(words[max(0, k - 3) : k])
                    found.update((f, around, row, aims) for f in features_of(words[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)], pa.array([x[3] for x in found], pa.bool_())],
                                             names=["f", "around", "row", "aims"])

    toxic = train.where("y = 1").select("row", "body").mapInArrow(contexts, "f string, around long, row long, aims boolean")
    support = toxic.groupBy("f").agg(F.least(F.count_distinct("around"), F.count_distinct("row")).alias("pos"), F.count_distinct("row").alias("rows"), F.count_distinct(F.when(F.col("aims"), F.col("row"))).alias("aimed")).where("pos >= 3")
    support = common.checkpoint(support)
    wanted = {r.f for r in support.select("f").toLocalIterator()} if support.count() <= SENT else None
    shared = spark.sparkContext.broadcast(wanted)

    def count(batches):
        wanted, total = shared.value, Counter()
        for batch in batches:
            for t in batch.column("body").to_pylist():
                total.update({f for w in set(TOKEN.findall((t or "").lower())) if w[0].isalpha() for f in features_of(w) if wanted is None or f in wanted})
            if len(total) > 500_000:
                yield rows(total)
                total = Counter()
        yield rows(total)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["f", "n"])

    seen = train.where("y = 0").select("body").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("neg"))
    rate = pos / (pos + neg)
    table = support.join(seen, "f", "left").select("f", "pos", (2 * F.col("aimed") >= F.col("rows")).alias("threat"), F.coalesce("neg", F.lit(0)).alias("neg")).withColumn("share", F.col("pos") / (F.col("pos") + F.col("neg")))
    # evidence against the base rate, as the exponent of the large-deviation bound
    less = F.when(F.col("neg") > 0, (1 - F.col("share")) * F.log((1 - F.col("share")) / (1 - rate))).otherwise(0.0)
    bound = (F.col("pos") + F.col("neg")) * (F.col("share") * F.log(F.col("share") / rate) + less)
    good = table.where(F.col("share") > max(0.5, 2 * rate)).withColumn("bound", bound).where("bound >= 14")
    weight = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5)) - math.log(rate / (1 - rate))
    found = good.select("f", weight.alias("w"), "threat").orderBy("f").collect()
    return {r.f: r.w for r in found if not r.threat}, {r.f: r.w for r in found if r.threat}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE):
    """A grammar and regression weights, from labelled rows that are not held out."""
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (common.crc_mod(doc_id, MOD) != HELD_OUT)).groupBy(
        F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    ids = common.checkpoint(ids.orderBy(F.xxhash64("id"), "id").limit(sample))
    train = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(ids), "id").select(F.monotonically_increasing_id().alias("row"), "y", "body")
    train = common.checkpoint(train)
    counts = dict(train.groupBy("y").count().collect())
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Grammar({}), np.append(np.zeros(FEATURES), 20.0 if pos else -20.0)
    learned = learn(train, pos, neg)
    shared = spark.sparkContext.broadcast(learned)

    def vectors(batches):
        grammar = Grammar(*shared.value)
        for batch in batches:
            v = [grammar.vector(t).tolist() for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(v, pa.list_(pa.float64()))], names=["y", "v"])

    rows = train.mapInArrow(vectors, "y int, v array<double>").toPandas()
    x, y = np.array(rows["v"].tolist(), dtype=np.float64).reshape(-1, FEATURES), rows["y"].to_numpy(dtype=np.float64)
    return Grammar(*learned), logistic(x, y)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", as_column: str = "toxicity", **kw) -> DataFrame:
    """``docs`` with the score in one more column."""
    grammar, weights = fit(docs, labels, doc_id=doc_id, text=text, **kw)
    shared = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.threats, weights))
    docs = docs.drop(as_column)
    at = docs.columns.index(text)

    def run(batches):
        lexicon, threats, w = shared.value
        grammar = Grammar(lexicon, threats)
        for batch in batches:
            z = [float(grammar.vector(t.as_py()) @ w[:-1] + w[-1]) for t in batch.column(at)]
            score = [1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in z]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, as_column])

    return docs.mapInArrow(run, docs.limit(0).withColumn(as_column, F.lit(0.0)).schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(common.crc_mod("doc_id", MOD) == HELD_OUT, F.lit(False)).alias("held_out"),
                        F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
