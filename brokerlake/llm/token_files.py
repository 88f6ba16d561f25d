"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id, so shard k holds only ids below those of shard k + 1. A task
writes three files per shard: ``.bin`` (the ids of its documents in a row, unsigned 16 or 32 bit),
``.off`` (n + 1 unsigned 64-bit offsets into it, in ids) and ``.doc`` (document ids, signed 64-bit,
then one byte each that is 1 where the id is NULL). The manifest has one row per shard; the prefix
sum of its counts is the shard's base, so a document's place in the whole corpus is base + offset.

A retried task writes new names and only the names of the attempt that succeeded reach the
manifest. Rereading maps the files into memory and touches one document at a time.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored, work_folder

_MANIFEST = "shard int, path string, documents long, ids long, width int"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None,
                 end_id: int = 0, spaces: bool = True) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the manifest, with the ``base`` of each shard.

    Ids follow ascending doc_id, NULL first; rows with equal ids are kept, in an order fixed by
    their place in the input. A NULL or empty text is its ``end_id`` alone. An empty table gives
    an empty manifest. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or work_folder(spark, "tokens")

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from brokerlake.llm.files import create
        from brokerlake.llm.tokens import encoder

        encode = encoder(tokenizer, spaces)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        shard = TaskContext.get().partitionId()
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
        ids, lengths = [], []
        out = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                out = create(path + ".bin")
            found = [one + end for one in encode.encode(batch.column("text"))]
            out.write(np.frombuffer(b"".join(found), "<u4").astype(f"<u{width}").tobytes())
            lengths.append(np.fromiter((len(one) // 4 for one in found), "<u8", len(found)))
            ids.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(lengths))])
        with create(path + ".off") as file:
            file.write(offsets.astype("<u8").tobytes())
        names = pa.chunked_array(ids)
        with create(path + ".doc") as file:
            file.write(names.fill_null(0).to_numpy().astype("<i8").tobytes())
            file.write(names.is_null().to_numpy().astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "path": [path],
            "documents": [len(offsets) - 1], "ids": [int(offsets[-1])],
            "width": pa.array([width], pa.int32()),
        })

    rows = docs.select(
        F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("_row")
    )
    # the row number keeps many rows of one id from being one range
    ranged = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    manifest = stored(ranged.select("doc_id", "text").mapInArrow(write, _MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Each document of the files: its id, first position, number of ids and their CRC-32."""

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from brokerlake.llm.files import mapped

        for batch in batches:
            for shard in batch.to_pylist():
                flat = np.frombuffer(mapped(shard["path"] + ".bin"), f"<u{shard['width']}")
                offsets = np.frombuffer(mapped(shard["path"] + ".off"), "<u8").astype("i8")
                count = shard["documents"]
                names = mapped(shard["path"] + ".doc")
                known = np.frombuffer(names, "<i8", count)
                absent = np.frombuffer(names, "u1", count, offset=8 * count) == 1
                for at in range(0, count, 4096):
                    to = min(count, at + 4096)
                    checks = [
                        zlib.crc32(flat[offsets[i] : offsets[i + 1]].astype("<u4").tobytes())
                        for i in range(at, to)
                    ]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(known[at:to], mask=absent[at:to]),
                        pa.array(offsets[at:to] + shard["base"]),
                        pa.array(np.diff(offsets[at : to + 1])),
                        pa.array(checks, pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = prepare(manifest.sparkSession)
    # one shard a task: the rows are names, the work is behind them
    spread = manifest.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, _DOCUMENTS)
