"""Fill-in-middle transformation over a run-length class encoding.

A text is stored as its maximal runs of one character class (white space or not), each with its first code point, its
length and the units before it.  A unit is a token, white space with the word after it or the white space that ends a
text, or one character.  Where a cut after k units falls is found by a binary search in the cumulative counts for the
run that holds the cut; its place is the run's first code point plus whole units times the length of a unit there.  The
runs of all texts of a batch are one array, so all cuts of a batch are one search.

Two draws give the cuts, one whether a text is transformed, one its form: ``psm`` (prefix, suffix, middle) or ``spm``
(suffix, prefix, middle).  All come from the SHA-256 of a seed and the id, so a rerun gives the same rows.

Defined results: a null or empty text and one that holds a marker stay as they are (form ``plain``); a null id is drawn
like an empty one; rows that repeat an id get equal draws and are each transformed; texts are whole, of any length; a
text of white space alone is one token; an empty table gives an empty result; extra columns are kept, but one with the
name of the added column is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, PERCENT_SPM = 42, 50, 80
FOUND = "struct<form:string,n:bigint,prefix_chars:bigint,middle_chars:bigint,output:string>"


class Runs:
    """Runs of the texts between ``bounds`` of UTF-8 ``data``, in code points, with cumulative counts of units."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str = "token"):
        word = common.NONSPACE[data]
        begins = np.zeros(len(data), bool)
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        begins[1:] |= word[1:] != word[:-1]
        at = np.flatnonzero(begins)
        chars = np.zeros(len(data) + 1, np.int64)  # code points before each byte
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        self.begin = chars[bounds]
        self.first = np.searchsorted(at, bounds)  # the first run of each text
        self.start = chars[at]
        self.size = np.diff(self.start, append=chars[-1])
        last = np.zeros(len(at), bool)
        last[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = True
        self.units = self.size if unit == "character" else (word[at] | last).astype(np.int64)
        self.upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.units, out=self.upto[1:])

    def count(self) -> np.ndarray:
        """Units of every text."""
        return np.diff(self.upto[self.first])

    def offset(self, k: np.ndarray) -> np.ndarray:
        """Code points of every text before the end of its first k units."""
        goal = self.upto[self.first[:-1]] + k
        out = np.zeros(len(k), np.int64)
        cut = np.flatnonzero(k > 0)
        run = np.searchsorted(self.upto[1:], goal[cut])  # the first run that brings the count to the cut
        step = self.size[run] // self.units[run]
        out[cut] = self.start[run] + (goal[cut] - self.upto[run]) * step - self.begin[:-1][cut]
        return out


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers of 32 bits from the seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12)]


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, percent: int = PERCENT,
                percent_spm: int = PERCENT_SPM, unit: str = "token", as_column: str = "fim") -> DataFrame:
    """``docs`` with one more column, struct(form, n, prefix_chars, middle_chars, output)."""
    docs = docs.drop(as_column)
    id_at, text_at = docs.columns.index(doc_id), docs.columns.index(text)
    kind = pa.struct([("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def rows(ids, texts, runs):
        h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
        n = runs.count()
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        a, b = runs.offset(np.minimum(one, two)).tolist(), runs.offset(np.maximum(one, two)).tolist()
        for k, t in enumerate(texts):
            t = t or ""
            if not t or h[k, 2] % 100 >= percent or PREFIX in t or SUFFIX in t or MIDDLE in t:
                yield {"form": "plain", "n": int(n[k]), "output": t}
                continue
            form = "spm" if h[k, 3] % 100 < percent_spm else "psm"
            yield {"form": form, "n": int(n[k]), "prefix_chars": a[k], "middle_chars": b[k] - a[k], "output": arranged(form, t[: a[k]], t[a[k] : b[k]], t[b[k] :])}

    def run(batches):
        for batch in batches:
            data, bounds = common.utf8(batch.column(text_at))
            for a, b in common.chunks(bounds):
                part = batch.slice(a, b - a)
                runs = Runs(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], unit)
                found = pa.array(rows(part.column(id_at).to_pylist(), part.column(text_at).to_pylist(), runs), kind)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, as_column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(as_column, T.StructType.fromDDL(FOUND.removeprefix("struct<").removesuffix(">")))]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>")  # a text that is not plain holds no marker
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = transformed(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_SPACE = r"[\x20\x09-\x0D]"
#: The same rows in DuckDB, from lists of tokens.
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
  regexp_extract_all(coalesce(text, ''), '{_SPACE}*[^{_SPACE[1:]}+|{_SPACE}+') AS u FROM documents),
 k AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PERCENT} THEN 'plain' WHEN h4 % 100 < {PERCENT_SPM} THEN 'spm' ELSE 'psm' END AS form FROM k),
 p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(t) AS restored_sha256,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256 FROM p"""
