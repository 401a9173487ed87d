"""A versioned store of records: Parquet by dim and bucket, a manifest for every version.

Data files are written first and a manifest last, so a version is there as a whole or
not at all, and a reader stays with the manifest it opened. Manifests go through
the file system of the path, whatever it is.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embspark.config import Status, StoreConfig
from embspark.operators import semantics
from embspark.schema import LOG, MUTATION, RECORD
from embspark.sources import dump


class StoreError(RuntimeError):
    def __init__(self, status: Status, message: str):
        super().__init__(f"{status.name}: {message}")
        self.status = status


class Lookup:
    """A batch lookup under way. Its Spark jobs bear a tag of their own, by which they are cancelled."""

    def __init__(self, store: "Store", requests: DataFrame):
        self.store, self.tag = store, f"lookup-{uuid.uuid4().hex}"
        self.future = store.pool.submit(self._run, requests)

    def _run(self, requests: DataFrame):
        spark = self.store.spark
        spark.addTag(self.tag)
        try:
            return self.store.get(requests).toArrow()
        finally:
            spark.removeTag(self.tag)

    def poll(self) -> Status:
        """AGAIN while it runs, OK when its result is there, NOT_FOUND once cancelled, IO if it failed."""
        if self.future.cancelled():
            return Status.NOT_FOUND
        if not self.future.done():
            return Status.AGAIN
        return Status.OK if self.future.exception() is None else Status.IO

    def result(self, timeout: float | None = None):
        return self.future.result(timeout)

    def cancel(self) -> bool:
        """Stop it; False if its result was there already."""
        if self.future.done():
            return False
        if not self.future.cancel():
            self.store.spark.interruptTag(self.tag)
        return True


class Store:
    """Single writer, many readers. Put and delete collect a log; ``flush`` commits it, ``checkpoint`` also ends the generation."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.lock, self.pool = threading.Lock(), ThreadPoolExecutor(max_workers=2)
        self.pending: list[DataFrame] = []
        self.pending_rows = self.seq = self.epoch = 0
        self.manifest = self._newest() or {"version": 0, "generation": 0, "dims": sorted(config.dims), "base": None, "logs": [], "checkpoints": [], "next_seq": 0}
        self.seq = self.manifest["next_seq"]

    # files

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _newest(self) -> dict | None:
        fs, path = self._fs()
        at = path(f"{self.path}/manifests")
        if not fs.exists(at):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        text = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]
        try:
            return json.loads(text)
        except ValueError as e:
            raise StoreError(Status.CORRUPT, names[-1]) from e

    def _publish(self, manifest: dict) -> None:
        fs, path = self._fs()
        manifest = manifest | {"version": self.manifest["version"] + 1}
        fs.mkdirs(path(f"{self.path}/manifests"))
        tmp, final = path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), path(f"{self.path}/manifests/m-{manifest['version']:012d}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise StoreError(Status.BUSY, "another writer has committed")
        self.manifest = manifest

    def _writable(self) -> None:
        if self.config.mode == "r":
            raise StoreError(Status.INVALID, "the store is open for reading")

    # writes

    def put(self, rows: DataFrame) -> DataFrame:
        """``rows(pos, feat_id, dim, embedding)``; gives back each row's status. The batch's accepted rows are pending."""
        self._writable()
        batch = semantics.accepted(rows, "embedding").select(F.col("pos").cast("long").alias("pos"), "feat_id", "dim", "embedding")
        if self.config.batch_limit and batch.limit(self.config.batch_limit + 1).count() > self.config.batch_limit:
            raise StoreError(Status.INVALID, f"a batch holds {self.config.batch_limit} rows at most")
        known = self._dims(batch)
        live = self._live(batch.select("feat_id").distinct(), ("dim",))
        status = self._stored(semantics.put_batch_status(batch, live, known))
        self._log(status.where("status = 'OK'").select("pos", F.lit("P").alias("op"), "feat_id", "dim", "embedding"), known)
        return status.select("pos", "feat_id", "dim", "status")

    def _dims(self, rows: DataFrame) -> list[int]:
        """Registered dims, with those of ``rows`` where new ones are registered on first use."""
        known = self.manifest["dims"]
        if self.config.auto_create:
            known = sorted({*known, *(r["dim"] for r in rows.where("dim is not null").select("dim").distinct().collect())})
        return known

    def apply(self, log: DataFrame) -> None:
        """Mutations (``seq, op, feat_id, dim, embedding``), each by itself in order of ``seq``; the outcome is pending."""
        self._writable()
        log = log.select("seq", "op", "feat_id", "dim", "embedding").where("op = 'D' or embedding is not null")
        known = self._dims(log.where("op = 'P'"))
        log = log.where((F.col("op") == "D") | F.col("dim").isin(known))
        live = self._live(log.select("feat_id").distinct(), ("dim",))
        changes = self._stored(semantics.settled_changes(log, live).select(F.lit(0).cast("long").alias("pos"), "op", "feat_id", "dim", "embedding"))
        self._log(changes, known)

    def delete(self, ids: DataFrame) -> None:
        """Ids (``feat_id``); missing ones are ignored."""
        self._writable()
        rows = ids.where("feat_id <> 0").select("feat_id").distinct()
        rows = rows.select(F.lit(0).cast("long").alias("pos"), F.lit("D").alias("op"), "feat_id", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("array<float>").alias("embedding"))
        self._log(self._stored(rows), self.manifest["dims"])

    def _stored(self, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.parquet(at)

    def _log(self, rows: DataFrame, dims: list[int]) -> None:
        with self.lock:
            # an id occurs once for each (dim, pos) of a batch; later places win
            last = semantics.last_write(rows, ["pos"])
            self.pending.append(last.select(F.lit(self.seq).cast("long").alias("seq"), "op", "feat_id", "dim", "embedding"))
            self.pending_rows += rows.count()
            self.seq += 1
            self.manifest = self.manifest | {"dims": list(dims)}

    def flush_needed(self) -> bool:
        return self.pending_rows >= self.config.pending_limit * 3 // 4

    def flush(self) -> None:
        """Commit what is pending as one log file of the generation to come; each row bears its checksum."""
        self._writable()
        with self.lock:
            if not self.pending:
                return
            rows = self.pending[0]
            for r in self.pending[1:]:
                rows = rows.unionByName(r)
            g = self.manifest["generation"] + 1
            name = f"log/g={g}/{uuid.uuid4().hex}"
            semantics.row_checksums(rows).write.parquet(f"{self.path}/{name}")
            self._publish(self.manifest | {"logs": [*self.manifest["logs"], [g, name]], "next_seq": self.seq})
            self.pending, self.pending_rows = [], 0

    def verify(self) -> DataFrame:
        """Committed log rows whose contents do not give their checksum."""
        return semantics.corrupt_rows(self._log_files(self.manifest["logs"]))

    def flush_async(self) -> Future:
        return self.pool.submit(self.flush)

    def checkpoint(self) -> int:
        """End the generation; after ``full_every`` of them the logs are folded into a new base."""
        self.flush()
        with self.lock:
            g = self.manifest["generation"] + 1
            self.epoch += 1
            self._publish(self.manifest | {"generation": g, "checkpoints": [*self.manifest["checkpoints"], g]})
        full = (self.manifest["base"] or [0])[0]
        if g - full >= self.config.full_every:
            self.compact()
        return g

    def compact(self) -> None:
        """A full base of the state at the last generation; logs that it covers are dropped from the manifest."""
        if not self.checkpoint_in_progress:
            self.checkpoint_begin()
        self.checkpoint_step(self.config.buckets)

    @property
    def checkpoint_in_progress(self) -> bool:
        return bool(self.manifest.get("phase"))

    def checkpoint_begin(self) -> None:
        """Start folding the state at the last generation into a new base; the store goes on serving and taking writes meanwhile."""
        self._writable()
        with self.lock:
            if self.manifest.get("phase"):
                raise StoreError(Status.BUSY, "a checkpoint is in progress")
            g = self.manifest["generation"]
            self._publish(self.manifest | {"phase": {"generation": g, "name": f"base/g={g}-{uuid.uuid4().hex}", "done": 0}})

    def checkpoint_step(self, buckets: int = 1) -> Status:
        """Write the next ``buckets`` of the new base: AGAIN while there are more, OK once it is published, INVALID if none is in progress."""
        self._writable()
        phase = self.manifest.get("phase")
        if not phase:
            return Status.INVALID
        g, lo = phase["generation"], phase["done"]
        hi = min(self.config.buckets, lo + buckets)
        rows = self._state(self.log(upto=g), lambda t: t.withColumn("bucket", self._bucket()).where(F.col("bucket").between(lo, hi - 1)).drop("bucket"), buckets=list(range(lo, hi)))
        rows = rows.withColumn("bucket", self._bucket())
        rows.repartition("dim", "bucket").write.mode("append").partitionBy("bucket", "dim").parquet(f"{self.path}/{phase['name']}")
        with self.lock:
            if hi < self.config.buckets:
                self._publish(self.manifest | {"phase": phase | {"done": hi}})
                return Status.AGAIN
            self._publish(self.manifest | {"phase": None, "base": [g, phase["name"]], "logs": [x for x in self.manifest["logs"] if x[0] > g]})
        return Status.OK

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("feat_id"), F.lit(self.config.buckets)).cast("int")

    def purge(self, keep_versions: int = 2) -> int:
        """Delete data files, staged ones too, that none of the newest ``keep_versions`` manifests names; how many went.

        Older manifests go with them. For times when nothing is pending: staged rows of other writers would be lost.
        """
        self._writable()
        if self.pending:
            raise StoreError(Status.BUSY, "flush first")
        fs, path = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/manifests")) if s.getPath().getName().endswith(".json"))
        used: set[str] = set()
        for name in names[-keep_versions:]:
            m = json.loads(self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).first()[0])
            used |= {x[1] for x in m["logs"]} | ({m["base"][1]} if m["base"] else set()) | ({m["phase"]["name"]} if m.get("phase") else set())
        gone = 0
        for top in ("base", "log", "staged"):
            if not fs.exists(path(f"{self.path}/{top}")):
                continue
            for s in fs.listStatus(path(f"{self.path}/{top}")):
                name = s.getPath().getName()
                below = [f"{top}/{name}/{x.getPath().getName()}" for x in fs.listStatus(s.getPath())] if top == "log" else [f"{top}/{name}"]
                for x in below:
                    if x not in used:
                        gone += bool(fs.delete(path(f"{self.path}/{x}"), True))
        for name in names[:-keep_versions]:
            fs.delete(path(f"{self.path}/manifests/{name}"), False)
        return gone

    def close(self) -> None:
        if self.config.mode == "rw":
            self.flush()
        self.pool.shutdown()

    # reads

    def _base(self) -> DataFrame:
        if not self.manifest["base"]:
            return self.spark.createDataFrame([], f"{RECORD}, bucket int")
        return self.spark.read.schema(f"{RECORD}, bucket int").parquet(f"{self.path}/{self.manifest['base'][1]}").select("feat_id", "dim", "embedding", "bucket")

    def _log_files(self, files: list) -> DataFrame:
        """One scan of all log files, whatever their number; the generation is part of their path."""
        if not files:
            return self.spark.createDataFrame([], f"{LOG}, checksum string")
        rows = self.spark.read.schema(f"{MUTATION}, checksum string, g bigint").option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/{name}" for _, name in files))
        return rows.withColumnRenamed("g", "generation").select("seq", "op", "feat_id", "dim", "embedding", "generation", "checksum")

    def log(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Committed mutations of generations after .. upto, with ``generation``; deltas hold deletes too."""
        upto = self.manifest["generation"] + 1 if upto is None else upto
        return self._log_files([x for x in self.manifest["logs"] if after < x[0] <= upto]).drop("checksum")

    def _state(self, logs: DataFrame, only: Callable[[DataFrame], DataFrame] = lambda rows: rows, columns: Sequence[str] = ("dim", "embedding"), buckets: list[int] | None = None) -> DataFrame:
        """The live rows; ``only`` narrows base and logs before anything is folded."""
        base = self._base()
        if buckets is not None:
            base = base.where(F.col("bucket").isin(buckets))
        base = only(base.select(F.lit(-1).cast("long").alias("seq"), F.lit("P").alias("op"), "feat_id", *columns))
        # statuses were settled when the rows came in, so the last operation decides
        return semantics.latest_live(base.unionByName(only(logs.select(*base.columns)))).select("feat_id", *columns)

    def snapshot(self, generation: int) -> DataFrame:
        """The state at the end of a generation that is not older than the base."""
        if generation < (self.manifest["base"] or [0])[0]:
            raise StoreError(Status.NOT_FOUND, f"generation {generation} was folded into a later base")
        return self._state(self.log(upto=generation))

    def _logs(self) -> DataFrame:
        logs = self.log()
        for r in self.pending:
            logs = logs.unionByName(r.withColumn("generation", F.lit(self.manifest["generation"] + 1).cast("long")))
        return logs

    def live(self) -> DataFrame:
        return self._state(self._logs())

    def _live(self, ids: DataFrame, columns: Sequence[str] = ("dim", "embedding")) -> DataFrame:
        """The live rows of ``ids(feat_id)`` (distinct): base and logs are reduced to them, and to their buckets, before the fold."""
        buckets = None
        if self.manifest["base"]:
            buckets = [r[0] for r in ids.select(self._bucket()).distinct().collect()]
        return self._state(self._logs(), lambda rows: rows.join(ids, "feat_id", "left_semi"), columns, buckets)

    def get(self, requests: DataFrame) -> DataFrame:
        ids = requests.where(F.col("feat_id") != semantics.RESERVED).select("feat_id").distinct()
        return semantics.batch_get(requests, self._live(ids))

    def probe(self, requests: DataFrame) -> DataFrame:
        """Dims of the requested ids; no vector is read."""
        ids = requests.where(F.col("feat_id") != semantics.RESERVED).select("feat_id").distinct()
        return semantics.probe(requests, self._live(ids, ("dim",)))

    def get_async(self, requests: DataFrame) -> "Lookup":
        """A lookup in the background, to be polled, waited for or cancelled."""
        return Lookup(self, requests)

    def get_stream(self, requests: DataFrame, chunk: int = 64) -> Iterator[list]:
        """Answers in order of ``pos``, ``chunk`` rows at a time, as partitions come in."""
        rows: list = []
        for r in self.get(requests).orderBy("pos").toLocalIterator(prefetchPartitions=True):
            rows.append(r)
            if len(rows) == chunk:
                yield rows
                rows = []
        if rows:
            yield rows

    def export(self, path: str, base_gen: int | None = None, also_full: bool = False) -> None:
        """Dump files of the last generation at ``path``: all live rows, or with ``base_gen`` the rows that changed since then.

        A delta holds the live rows of ids touched after ``base_gen``; ``also_full`` writes the full dump beside it.
        """
        g = self.manifest["generation"]
        if base_gen is None or also_full:
            dump.write_dumps(self.snapshot(g), path, g)
        if base_gen is not None:
            touched = self.log(base_gen, g).select("feat_id").distinct()
            rows = self._state(self.log(upto=g), lambda t: t.join(touched, "feat_id", "left_semi"))
            dump.write_dumps(rows, path, g, base_gen=base_gen, kind=dump.DELTA)

    def import_dumps(self, path: str, allow_redim: bool = False) -> DataFrame:
        """Merge the dump files at ``path``: of an id in several, the one of the newest generation; outcomes by id."""
        rows = semantics.last_write(dump.read_dumps(self.spark, path).select("feat_id", "dim", "embedding", "generation", "kind"), ["generation", "kind"])
        return self.import_rows(rows.select("feat_id", "dim", "embedding"), allow_redim)

    def stats(self) -> DataFrame:
        live = self.live().agg(F.count("*").alias("total_features"), F.countDistinct("dim").alias("n_dims"), F.coalesce(F.sum(F.col("dim") * 4), F.lit(0)).cast("long").alias("bytes"))
        return live.withColumn("checkpoint_generation", F.lit(self.manifest["generation"]).cast("long")).withColumn("pending_rows", F.lit(self.pending_rows).cast("long"))

    def import_rows(self, rows: DataFrame, allow_redim: bool = False) -> DataFrame:
        """Upsert ``rows(feat_id, dim, embedding)``, the later of equal ids first decided by the caller; outcomes by id."""
        self._writable()
        rows = rows.where("feat_id <> 0")
        outcome = self._stored(semantics.import_outcome(rows, self._live(rows.select("feat_id").distinct(), ("dim",))))
        if allow_redim:
            self.delete(outcome.where("outcome = 'reject'"))
        keep = outcome if allow_redim else outcome.where("outcome <> 'reject'")
        self._log(keep.select(F.lit(0).cast("long").alias("pos"), F.lit("P").alias("op"), "feat_id", "dim", "embedding"), sorted({*self.manifest["dims"], *(r["dim"] for r in keep.select("dim").distinct().collect())}))
        return outcome.select("feat_id", "dim", "outcome")
