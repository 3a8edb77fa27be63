"""What the operators of this subpackage share: table access, lineage cuts, numpy hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termforge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there, and a lost executor costs only the reading task: the
    files are outside every executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (bigint) and ``text``: other columns, whatever their names, can't clash later."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h + _GOLD
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True
_BASE = 0x100000001B3
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k : k + 1] = [np.cumprod(p)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and where each text's words end.

    Words are runs of letters, digits and underscores; all non-ASCII characters
    count as letters. A word's hash is a polynomial in its UTF-8 bytes, taken from one prefix
    sum over the whole batch.
    """
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])
    inside = _WORD[raw]
    edge = np.diff(inside.view(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start]), np.searchsorted(start, ends)


def slices(texts: list[str], most: int = 1 << 20) -> list[slice]:
    """Runs of texts of about ``most`` characters together, so numpy's buffers stay small."""
    out, begin, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append(slice(begin, k))
            begin, size = k, 0
        size += len(t) + 1
    return [*out, slice(begin, len(texts))] if texts else []
