"""Secret scans over an incremental blob ledger (operator 7).

Every historical version of a path is addressed by the SHA-256 of its text. The ledger, a Parquet folder in the
shared store, holds one row for each blob and rule version that was scanned. A scan takes the distinct blobs,
drops the pairs that the ledger has, scans the rest, appends them in one Spark commit, and joins the findings
back to all paths, those of a blob that many paths hold by broadcast. A run that dies before its commit leaves the
ledger as it was.

Defined results: a null text is the empty blob, which has no findings; equal texts, repeated rows and ties are one
blob, scanned once, and every row gets its findings back; null keys stay; an empty table adds nothing and returns
no rows; only the named columns are read, so others may have any name; texts are scanned whole. A key that is
named like a column of the findings is refused (ValueError).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import HOT, check_keys, lookup, map_arrow, slices, text_or_empty
from tramline.store import exists

#: Rule kinds in the order in which spans of one start are listed; the first three are the base rules.
KINDS = ("assign", "access", "hex", "pem", "forge")
BASE = KINDS[:3]
RULE_VERSION = "2024.2"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A maximal run that is too short is dropped in any case, so the length may stand in the pattern.
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
# A body without its END line: header lines, then words of base64, broken by white space or written-out line ends.
# Words that could be prose (short, of letters only) are not of the body, but for its last one.
_BODY = re.compile(r"(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z-]+: [^\r\n\\]*)*(?:(?:\s|\\[rn])*(?:[A-Za-z0-9+/=]{16,}|[A-Za-z]*[0-9+/=][A-Za-z0-9+/=]*))*(?:(?:\s|\\[rn])*[A-Za-z0-9+/=]+)?", re.ASCII)
_FORGE = re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{36,}")

FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string, redacted string"


def _pem(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of private keys: through the END line of the same name, or the base64 run where that is missing."""
    heads = list(_PEM.finditer(text))
    for i, m in enumerate(heads):
        bound = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        end = f"-----END {m[1]}-----"
        at = text.find(end, m.end(), bound)
        yield m.start(), at + len(end) if at >= 0 else _BODY.match(text, m.end(), bound).end()


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all spans in code points, sorted."""
    found = []
    lower = text.lower()
    if any(k in lower for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(start, 3, end) for start, end in _pem(text)]
    if "gh" in text or "github_pat_" in text:
        found += [(m.start(), 4, m.end()) for m in _FORGE.finditer(text)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]], kinds: int = len(KINDS)) -> str:
    """kind:start:end, joined by commas, of the first `kinds` kinds."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < kinds)


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at, i = [], 0, 0
    while i < len(found):
        start, _, end = found[i]
        while i + 1 < len(found) and found[i + 1][0] < end:
            i += 1
            end = max(end, found[i][2])
        out += [text[at:start], mark]
        at = end
        i += 1
    return "".join([*out, text[at:]])


def _scan(rule_version: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [find(t) for t in texts]
            counts = [pa.array([sum(k == n for _, k, _ in f) for f in found], pa.int64()) for n in range(3)]
            clean = [redact(t, f) if f and with_text else None for t, f in zip(texts, found, strict=True)]
            strings = [[joined(f, len(BASE)) for f in found], [joined(f) for f in found], clean]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([rule_version] * len(texts), pa.string()), *counts, *(pa.array(s, pa.string()) for s in strings)],
                ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted"],
            )

    return run


def ledger(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """The findings that a ledger has for a rule version, one row a blob; none if there is no ledger yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], FINDINGS)
    # Two runs at once may have scanned one blob twice, with equal findings.
    return spark.read.schema(FINDINGS).parquet(path).where(F.col("rule_version") == rule_version).dropDuplicates(["blob", "rule_version"])


def unseen(versions: DataFrame, path: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """blob and text of every distinct text that the ledger does not have under this rule version."""
    spark = versions.sparkSession
    blobs = versions.select(F.sha2(text_or_empty(text), 256).alias("blob"), text_or_empty(text).alias("text"))
    # Partial aggregation keeps one row of a blob in each map task, so a group of copies does not meet in one task.
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if not exists(spark, path):
        return once
    return once.join(spark.read.schema(FINDINGS).parquet(path).where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")


def scan(versions: DataFrame, path: str, keys: Sequence[str], text: str = "text", rule_version: str = RULE_VERSION, with_text: bool = False) -> DataFrame:
    """Scan what the ledger at path has not seen, commit it, and return keys with the findings of every row.

    Returned beside the keys: blob, n_assign, n_access, n_hex, base_spans, spans, redacted (the text without its
    secrets, only with with_text and only where there are any).
    """
    spark = versions.sparkSession
    check_keys(keys, [c.split()[0] for c in FINDINGS.split(", ")])
    map_arrow(unseen(versions, path, text, rule_version), _scan(rule_version, with_text), FINDINGS).write.mode("append").parquet(path)
    rows = versions.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.sha2(text_or_empty(text), 256).alias("blob"))
    # Sums by task come before the shuffle; fewer than HOT blobs are left.
    counts = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") * HOT > versions.count()).select("blob")
    found = lookup(rows, ledger(spark, path, rule_version).drop("rule_version"), "blob", hot, [f"_key{i}" for i in range(len(keys))] or ["blob"])
    return found.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "blob", "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted")
