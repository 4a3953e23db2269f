"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Documents per Arrow batch: long texts must not add up to more than a task can hold.
BATCH_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of text rows small. Plans are lazy, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def words(text: str | None) -> list[str]:
    """Runs of anything but ASCII white space."""
    if not text:
        return []
    # str.split also cuts at white space beyond ASCII, so it may only be used without any.
    return WORD.findall(text) if not text.isascii() and ODD_SPACE.search(text) or _controls(text) else text.split()


def _controls(text: str) -> bool:
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def lower_ascii(text: str) -> str:
    # bytes.lower changes A-Z only, which UTF-8 uses for nothing else
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a missing id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def per_process(owner: str, key: str, make):
    """What ``make`` builds, once per Python process and key. Functions travel to the
    executors by value, so a module's own globals would be new in every task. Processes
    live on, so one operator's objects go when another (``owner``) comes."""
    store = sys.modules.setdefault("_panelcast_llm_store", types.ModuleType("_panelcast_llm_store")).__dict__
    if store.get("owner") != owner:
        store["owner"], store["held"] = owner, {}
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)
    held = store["held"]
    if key not in held:
        held[key] = make()
    return held[key]


class RowStore:
    """Rows written once to the shared folder, so that each is known by its file and place
    whatever its values. Columns but doc_id and text are stored under numbers, so any names will do."""

    def __init__(self, docs: DataFrame, name: str):
        self.spark, self.path = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/panelcast/{name}-{uuid.uuid4().hex}"
        self.names = {c if c in ("doc_id", "text") else f"other{i}": c for i, c in enumerate(docs.columns)}
        stored = docs.select(*[F.col(_quoted(c)).alias(n) for n, c in self.names.items()])
        self.schema = stored.schema
        stored.write.option("compression", "zstd").parquet(self.path)

    def rows(self) -> DataFrame:
        """The stored columns, ``file`` and ``row``."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def keep(self, places: DataFrame) -> DataFrame:
        """The rows at ``places`` (file and row), under their own names."""
        kept = self.rows().join(places.select("file", "row"), ["file", "row"], "left_semi")
        return kept.select(*[F.col(n).alias(c) for n, c in self.names.items()])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
