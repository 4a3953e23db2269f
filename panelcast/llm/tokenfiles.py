"""Token ids in Arrow files of equal-length sequences.

A shard is one Arrow IPC file (the stream format with a footer, so that any batch is
found without reading those before it) of record batches with two fixed-size-list
columns: ``ids`` (L ids of the shard's id stream) and ``mask`` (false where the last
sequence is padded). A second Arrow file per shard lists its documents. Readers map
the files and slice: no copy, no decoding.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import shared_folder
from .subwords import encoder, tokenizer_path
from .text import text_batches

LENGTH = 2048
#: Sequences in one record batch.
BATCH = 256
END_ID = 1
SHARD = "shard int, ids_uri string, docs_uri string, n_tokens bigint, n_docs bigint, n_sequences bigint"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, sink, length: int, batch: int, kind: str):
        import pyarrow as pa

        self.pa, self.length, self.rows, self.kind = pa, length, batch, np.dtype(kind)
        self.schema = pa.schema(
            [pa.field("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), pa.field("mask", pa.list_(pa.bool_(), length))]
        )
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        pa, step = self.pa, self.length * self.rows
        held = np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        end = len(held) if last else len(held) - len(held) % step
        for a in range(0, end, step):
            own = held[a : min(a + step, end)]
            pad = -len(own) % self.length
            mask = np.ones(len(own) + pad, bool)
            if pad:
                mask[len(own) :] = False
                own = np.append(own, np.zeros(pad, self.kind))
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (own, mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
            self.sequences += len(own) // self.length
        self.parts, self.held = [held[end:]], len(held) - end

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class ShardReader:
    """Random access to the ids of a shard; local files are mapped, not read."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        where, path = _fs(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.flat = -1, None
        self.step = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 0

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of one record batch, by sequence."""
        b = self.file.get_batch(k)
        ids = b.column("ids").flatten().to_numpy(zero_copy_only=True)
        mask = b.column("mask").flatten().to_numpy(zero_copy_only=False)
        return ids.reshape(-1, self.length), mask.reshape(-1, self.length)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.step // self.length
        ids, mask = self.batch(k // rows)
        return ids[k % rows], mask[k % rows]

    def ids(self, start: int, n: int) -> np.ndarray:
        """A run of the shard's ids: a view if it lies in one batch."""
        out = []
        while n > 0:
            k, at = divmod(start, self.step)
            if k != self.at:
                self.at, self.flat = k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
            out.append(self.flat[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def write_tokens(
    docs: DataFrame, folder: str | None = None, *, path: str | None = None, length: int = LENGTH, batch: int = BATCH,
    end_id: int = END_ID, kind: str | None = None, shards: int | None = None,
) -> DataFrame:
    """Write all documents in ascending order of id and return the manifest (one row per
    shard, stored beside the shards). Null texts count as empty, so each document has at
    least its end id. Null ids come first; rows that share an id follow the order of their
    texts. An empty table gives no shards. ``kind`` is the ids' type, by default the
    smallest unsigned one that holds the vocabulary."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    folder = folder or f"{shared_folder(spark)}/panelcast/tokens-{uuid.uuid4().hex}"
    if kind is None:
        from tokenizers import Tokenizer

        size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
        kind = "uint16" if size <= 1 << 16 else "uint32"
    text_batches(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(n, "doc_id", tie)
        .sortWithinPartitions("doc_id", tie, "text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        from pyspark import TaskContext

        code, shard, writer = encoder(path), TaskContext.get().partitionId(), None
        where, top = _fs(folder)
        for frame in batches:
            if not len(frame):
                continue
            if writer is None:
                # An attempt writes under names of its own; the last step moves both files into place.
                where.create_dir(top, recursive=True)
                mark = f"{top}/.{shard:06d}-{uuid.uuid4().hex}"
                sinks = [where.open_output_stream(f"{mark}.{x}") for x in ("ids", "docs")]
                writer = ShardWriter(sinks[0], length, batch, kind)
                index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                lister, n_docs = pa.ipc.new_file(sinks[1], index), 0
            ids, at = code.encode(frame["text"].tolist())
            # one end id behind each document
            ends = at[1:]
            ids = np.insert(ids, ends, end_id)
            counts = np.diff(at) + 1
            starts = writer.total + np.cumsum(counts) - counts
            writer.add(ids)
            columns = [pa.array(frame["doc_id"], pa.int64(), from_pandas=True), pa.array(starts), pa.array(counts)]
            lister.write_batch(pa.record_batch(columns, schema=index))
            n_docs += len(frame)
        if writer is not None:
            writer.close()
            lister.close()
            for s in sinks:
                s.close()
            names = [f"{top}/{shard:06d}.ids.arrow", f"{top}/{shard:06d}.docs.arrow"]
            for x, name in zip(("ids", "docs"), names):
                where.move(f"{mark}.{x}", name)
            uris = [f"{folder}/{name.rpartition('/')[2]}" for name in names]
            yield pd.DataFrame([(shard, *uris, writer.total, n_docs, writer.sequences)], columns=[x.split()[0] for x in SHARD.split(", ")])

    ordered.mapInPandas(run, SHARD).write.parquet(f"{folder}/manifest")
    return spark.read.schema(SHARD).parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents as the files have them: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32."""
    spark: SparkSession = manifest.sparkSession
    # one row per shard; their number is set when writing
    shards = sorted(manifest.select("shard", "ids_uri", "docs_uri", "n_tokens").collect())
    if not shards:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    base, rows = 0, []
    for s in shards:
        rows.append((s["shard"], s["ids_uri"], s["docs_uri"], base))
        base += s["n_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for frame in batches:
            for ids_uri, docs_uri, first in zip(frame["ids_uri"], frame["docs_uri"], frame["base"]):
                shard = ShardReader(ids_uri)
                where, name = _fs(docs_uri)
                with where.open_input_file(name) as f:
                    listing = pa.ipc.open_file(f)
                    for k in range(listing.num_record_batches):
                        b = listing.get_batch(k)
                        starts, counts = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(shard.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), counts.tolist())]
                        yield pd.DataFrame({"doc_id": b.column("doc_id").to_pandas(integer_object_nulls=True), "start": starts + first, "n_tokens": counts, "ids_crc32": crc})

    listed = spark.createDataFrame(rows, "shard int, ids_uri string, docs_uri string, base bigint").repartitionByRange(len(rows), "shard")
    return listed.mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
