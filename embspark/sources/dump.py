"""Reader and writer of the binary dump of one dim's records.

A header, then rows of an id and its floats, then a trailer with the number of rows. The
number is taken from the trailer or the file's length, never from bytes inside the rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format, little-endian: magic, version, kinds of dump, header and trailer layouts.
MAGIC = 0x434B4558
VERSION = 1
FULL, DELTA = 1, 2
HEADER = struct.Struct("<IIIQIIQQI")
TRAILER = struct.Struct("<IQ")

NAME = re.compile(r"g(\d+)_d(\d+)_(\d+)\.dump")
ROWS = "generation long, base_gen long, kind int, feat_id long, dim int, embedding array<float>"
SCHEMA = pa.schema([("generation", pa.int64()), ("base_gen", pa.int64()), ("kind", pa.int32()), ("feat_id", pa.int64()), ("dim", pa.int32()), ("embedding", pa.list_(pa.float32()))])


def encode(ids: np.ndarray, vectors: np.ndarray, generation: int, base_gen: int = 0, kind: int = FULL) -> bytes:
    """One dump; the header holds the number of rows and its checksum."""
    n, dim = vectors.shape
    row = np.zeros(n, np.dtype([("id", "<u8"), ("v", "<f4", (dim,))]))
    row["id"], row["v"] = ids.astype(np.int64).view(np.uint64), vectors
    head = HEADER.pack(MAGIC, VERSION, kind, generation, dim, 4 * dim, n, base_gen, 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(head)) + row.tobytes() + TRAILER.pack(MAGIC, n)


def decode(data: bytes, limit: int | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
    """Header fields, ids (signed) and vectors; a missing trailer or a zero count or checksum is accepted."""
    if len(data) < HEADER.size:
        raise ValueError("shorter than a header")
    magic, version, kind, generation, dim, size, _, base_gen, checksum = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or kind not in (FULL, DELTA) or not dim or size != 4 * dim:
        raise ValueError("not a dump")
    if checksum and checksum != zlib.crc32(data[: HEADER.size - 4]):
        raise ValueError("checksum of the header")
    row = np.dtype([("id", "<u8"), ("v", "<f4", (dim,))])
    body = len(data) - HEADER.size
    n = body // row.itemsize
    if body >= TRAILER.size and (body - TRAILER.size) % row.itemsize == 0:
        mark, count = TRAILER.unpack_from(data, len(data) - TRAILER.size)
        if mark == MAGIC and count == (body - TRAILER.size) // row.itemsize:
            n = count
    rows = np.frombuffer(data, row, n if limit is None else min(n, limit), HEADER.size)
    return {"generation": generation, "base_gen": base_gen, "kind": kind, "dim": dim}, rows["id"].view(np.int64), rows["v"]


def decoded(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of the dumps in ``files(content)``, in batches; ``limit`` rows of each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                head, ids, vectors = decode(data.as_py(), limit)
                for at in range(0, len(ids), 10_000):
                    i, v = ids[at : at + 10_000], vectors[at : at + 10_000]
                    same = lambda x, k=len(i): [x] * k
                    lists = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * head["dim"], np.ascontiguousarray(v).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(same(head["generation"]), pa.int64()), pa.array(same(head["base_gen"]), pa.int64()), pa.array(same(head["kind"]), pa.int32()), pa.array(np.ascontiguousarray(i)), pa.array(same(head["dim"]), pa.int32()), lists], schema=SCHEMA)

    return files.select("content").mapInArrow(run, ROWS)


def file_facts(name: str) -> tuple[int, int, int] | None:
    """Generation, dim and part of a dump file's name, None if it is no such name."""
    m = NAME.fullmatch(name)
    return tuple(map(int, m.groups())) if m else None


def read_dumps(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows of all dumps at ``path``; one file (2 GB at most) is one task's. ``limit`` rows of each at most."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.dump").option("recursiveFileLookup", "true").load(path), limit)


def dump_table(rows: DataFrame, generation: int, base_gen: int = 0, kind: int = FULL, rows_per_file: int = 100_000) -> DataFrame:
    """``dim, part, content``: ``rows(feat_id, dim, embedding)`` as dumps of about ``rows_per_file`` rows of one dim."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"))
    parts = F.pmod(F.xxhash64("feat_id"), F.ceil(F.col("n") / rows_per_file)).cast("int")
    dealt = rows.join(F.broadcast(counts), "dim").withColumn("part", parts)

    def run(key, table):
        dim, part = (k.as_py() for k in key)
        ids = table.column("feat_id").to_numpy()
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(ids.view(np.uint64), kind="stable")
        data = encode(ids[order], vectors[order], generation, base_gen, kind)
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32()), "content": pa.array([data], pa.binary())})

    return dealt.groupBy("dim", "part").applyInArrow(run, "dim int, part int, content binary")


def write_dumps(rows: DataFrame, path: str, generation: int, **options) -> int:
    """Write dump files, each from the task that has its rows and under a temporary name first; the number of files.

    Tasks write through Arrow's file systems (local and shared folders, HDFS, object
    stores). Where these do not know the path, files go one by one through the driver
    and the path's Hadoop file system, each ``rows_per_file`` rows at most.
    """
    from pyarrow import fs as arrow_fs

    spark, hadoop = rows.sparkSession, rows.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(path))
    table = dump_table(rows, generation, **options)
    name = F.format_string("g%06d_d%d_%05d.dump", F.lit(generation), "dim", "part").alias("name")
    files = table.select(name, "content")
    try:
        arrow_fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        n = 0
        for r in files.toLocalIterator(prefetchPartitions=True):
            tmp = hadoop(f"{path}/.{r['name']}")
            out = fs.create(tmp, True)
            out.write(bytearray(r["content"]))
            out.close()
            fs.rename(tmp, hadoop(f"{path}/{r['name']}"))
            n += 1
        return n

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as arrow_fs

        system, top = arrow_fs.FileSystem.from_uri(path)
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                tmp = f"{top}/.{uuid.uuid4().hex}"  # of this attempt alone
                with system.open_output_stream(tmp) as out:
                    out.write(data.as_buffer())
                system.move(tmp, f"{top}/{name}")
            yield b.select(["name"])

    return files.mapInArrow(put, "name string").count()
