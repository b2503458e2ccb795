"""URL filters: rules first, else logistic regression on hashed character n-grams of host and path.

The regression is trained from the small labelled table ``LABELLED`` (url, block), which can be replaced by any other.
An n-gram's feature is the CRC-32 of its field and characters, modulo ``SIZE``; vectors are scaled to length one.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is judged by the
regression (its intercept); repeated rows are each judged; an empty table gives an empty result; extra columns are kept
by ``judged``, but one with the name of the added column is replaced.  Rules of equal length that fit are taken in the order given; without a labelled table of both kinds the
regression allows everything.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.toxicity import logistic

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
SIZE, GRAMS, THRESHOLD, RIDGE = 16384, (3, 4, 5), 0.5, 0.05


#: The words of the labelled table: names of ordinary sites, and words of link farms, doubtful shops and traps.
GOOD = """river stone harbour times atlas field guide city library garden club university museum wood work home cook math world book binder slow train north coast chess story history science
 review lake therapy farm house pillar adult learning freedom press county essex print printer manual download winter loan bank credit union health clinic pharmacy hospital school college
 sports football stadium theatre music radio weather travel hotel camping kitchen recipe bakery bread coffee tea wine flower plant animal bird horse dog cat fish water energy solar engine
 motor car bike bus rail bridge road street park forest mountain island beach ocean paper letter mail post office law court police fire safety child family parent youth senior church
 temple peace news daily weekly journal magazine article blog forum wiki archive document data code software linux python open source project research lab institute foundation charity
 win window winery winner prize award poker casino-history free shipping quick start medical medicine discount-store click watch maker replica-model game board video lecture sexton""".split()
BAD = """spam casino viagra cialis pills pill payday jackpot lottery escort webcam porn xxx sexy singles hookup hot-girls crack keygen warez nulled torrent-free malware phishing trojan virus-alert
 link-farm linkfarm seo-links backlinks buy-links cheap-meds cheap-rx no-prescription replica-watches fake-id counterfeit get-rich quick-cash easy-money earn-fast bitcoin-double free-spins
 slots betting bonus-win free-iphone free-gift-card you-won claim-prize winner-alert adult-cams adult-chat nude milf steroids weight-loss-miracle miracle-cure diet-pills forex-signals
 pump-dump account-verify login-verify secure-update bank-alert password-reset-now clickbait spam-offers mass-mailer cracked serial-key""".split()


def _labelled() -> list[tuple[str, int]]:
    """A small table (url, block): each word alone and with others of its kind, in the same hosts, paths and domains for both kinds."""
    forms = ("{0}.org/{1}/12", "www.{0}{1}.net/840", "{0}-{1}.com/page.html", "blog.{0}.org/{1}/77", "m.{0}{1}.net/5", "{0}.example.com/{1}", "{1}-{0}.info/index.php", "the{0}.biz/{1}", "{0}.co.uk/a/{1}?id=3", "{0}{1}.ru/")
    neutral = ("en", "de", "about", "news", "notes", "article", "x", "view", "claim", "shop", "buy", "free", "win", "best", "online", "2019/04")
    # names that mean nothing are ordinary ones
    parts = "ba re to lin mor ste wen tal ith ond er an ing sha pel dro kin vas lo mer bur ton ham ley ford wick ath est ric ul".split()
    made = ["".join(parts[(5 * k + 11 * j * j + 3 * j) % len(parts)] for j in range(2 + k % 3)) for k in range(200)]
    rows = [("", 0)]
    for block, words, each in ((0, GOOD, 3), (0, made, 2), (1, BAD, 5)):
        for k, word in enumerate(words):
            for j in range(each):
                other = words[(7 * k + 13 * j + 5) % len(words)] if j % 2 else neutral[(k + 3 * j) % len(neutral)]
                rows.append(("http://" + forms[(k + j) % len(forms)].format(word, other), block))
    return rows


LABELLED = _labelled()


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    stop = next((k for k, c in enumerate(path) if c in "?#"), len(path))
    host = rest[:cut].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower is ASCII only
    return host, path[:stop]


def features(host: str, path: str) -> np.ndarray:
    """Distinct feature numbers."""
    found = set()
    for field, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode("utf-8", "surrogatepass")
        for n in GRAMS:
            found.update(zlib.crc32(field.encode() + raw[k : k + n]) % SIZE for k in range(len(raw) - n + 1))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


def train(labelled=None) -> np.ndarray:
    """Weights and intercept."""
    labelled = LABELLED if labelled is None else labelled
    y = np.array([b for _, b in labelled], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(SIZE), -1.0)
    x = np.zeros((len(y), SIZE))
    for row, (url, _) in zip(x, labelled, strict=True):
        at = features(*split_url(url))
        row[at] = 1 / np.sqrt(max(1, len(at)))
    # a ridge fit does not change with a rotation: as many coordinates as rows suffice
    spread, turn = np.linalg.eigh(x @ x.T)
    kept = spread > 1e-9 * spread[-1]
    spread, turn = np.sqrt(spread[kept]), turn[:, kept]
    fitted = logistic(turn * spread, y, ridge=RIDGE)
    return np.append(x.T @ (turn @ (fitted[:-1] / spread)), fitted[-1])


def probability(host: str, path: str, weights: np.ndarray) -> float:
    at = features(host, path)
    z = weights[at].sum() / np.sqrt(max(1, len(at))) + weights[-1]
    return float(1 / (1 + np.exp(-z)))


class Rules:
    """Rules by host suffix; the longest that fits wins."""

    def __init__(self, rules):
        self.by_host: dict[str, list] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str):
        labels, best = host.split("."), None
        for k in range(len(labels)):
            for prefix, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


def judged(pages: DataFrame, url: str = "url", rules=None, labelled=None, threshold: float = THRESHOLD, as_column: str = "judged") -> DataFrame:
    """``pages`` with struct(host, path, rule, verdict, score) in one more column."""
    shared = pages.sparkSession.sparkContext.broadcast((RULES if rules is None else list(rules), train(labelled)))
    pages = pages.drop(as_column)
    at = pages.columns.index(url)

    def run(batches):
        listed, weights = shared.value
        table = Rules(listed)
        for batch in batches:
            rows = []
            for u in batch.column(at).to_pylist():
                host, path = split_url(u)
                rule, verdict = table.find(host, path) or (None, None)
                score = probability(host, path, weights)
                rows.append({"host": host, "path": path, "rule": rule, "verdict": verdict or ("block" if score >= threshold else "allow"), "score": score})
            kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, as_column])

    kind = "struct<host:string,path:string,rule:string,verdict:string,score:double>"
    return pages.mapInArrow(run, pages.limit(0).withColumn(as_column, F.lit(None).cast(kind)).schema)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    found = judged(common.table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
