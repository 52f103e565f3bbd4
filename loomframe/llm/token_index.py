"""Token ids in binary shards with a minimal perfect hash index over document keys.

Texts are dealt to the shards' tasks by ranges of their keys and tokenized there: ids take about as much room as text,
and ids made before the shuffle would have to be written once more.

Shard file: the ids of its documents one after another, raw and little-endian, 2 bytes each where the vocabulary
allows it (`width`), no header. Documents are in ascending key order over all shards (shards are numbered); there are
as many shards as `shard_bytes` needs, spark.sql.shuffle.partitions at least. A shard is written while its documents
come in; a task holds one Arrow batch of them.

Index: keys are dealt by hash to buckets of about BUCKET keys; a bucket's file holds a minimal perfect hash (a
3-partite hypergraph peeled in rounds; two bits per vertex, ranks by checkpoints) and, at each key's position, a
fingerprint (32 bits), the shard, the offset and the length in ids and the number of records with the key. A lookup
hashes the key once, reads three vertices, and compares one fingerprint: constant time, whatever the corpus' size.

Files go to the shared folder by pyarrow's file systems (local, hdfs, s3, gs ...) under a name of the task attempt
and are then renamed, so a repeated or lost task leaves the same file.

Defined results: a null text is empty and holds the end id only; a null key sorts first and is stored, but has no
index entry: `expand` gives such records with `nulls`; records of a repeated key stay in a row (by their text's hash,
then by their place in the input) and the index gives the first and their number; records of one key may stand in
several shards; an empty table makes no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import lean, new_path, tune
from ._text import mix
from ._tokens import MEMORY, Encoder

BUCKET = 100_000
#: Bytes of a shard that are read at once.
RUN = 4 << 20
_CHECK = 256
U64 = np.uint64


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Output:
    """A file under the task attempt's own name until all is written."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        task = TaskContext.get()
        self.own = f"{self.path}.{task.taskAttemptId() if task else 0}.part"

    def __enter__(self) -> pa.NativeFile:
        self.file = self.fs.open_output_stream(self.own)
        return self.file

    def __exit__(self, kind: object, *_: object) -> None:
        self.file.close()
        if kind is not None:
            self.fs.delete_file(self.own)
            return
        try:
            self.fs.move(self.own, self.path)
        except OSError:  # another attempt of the task was first: its file has the same bytes
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.own)


def _write(path: str, what: bytes) -> None:
    with _Output(path) as f:
        f.write(what)


def _read(path: str) -> bytes:
    fs, p = _fs(path)
    with fs.open_input_stream(p) as f:
        return f.read()


# --- minimal perfect hash ------------------------------------------------------------------------------------


def _key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + U64((seed * 0xD1B54A32D192ED03 + 1) % 2**64))


def _vertices(h: np.ndarray, third: int) -> np.ndarray:
    """Three vertices per key, one in each third."""
    out = np.empty((3, len(h)), np.int64)
    for k in range(3):
        out[k] = mix(h + U64((k + 1) * 0xA0761D6478BD642F % 2**64)) % U64(third) + U64(k * third)
    return out


class PerfectHash:
    """position(keys): a bijection of the keys it was made for onto 0..n-1; any number below n for other keys."""

    def __init__(self, seed: int, third: int, choice: np.ndarray):
        self.seed, self.third, self.choice = seed, third, choice
        used = choice != 3
        self.ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(used, np.arange(0, len(used), _CHECK)))))[:-1] if len(used) else np.zeros(1, np.int64)
        self.used = used

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        third = max(2, int(np.ceil(1.25 * n / 3)) + 1)
        for seed in range(1000):
            v = _vertices(_key_hash(keys, seed), third)
            if (rounds := cls._peel(v, 3 * third)) is not None:
                break
        else:
            raise ValueError("keys are not distinct")
        choice = np.full(3 * third, 3, np.int8)
        for edge, side in reversed(rounds):  # an edge's own vertex is free when its turn comes
            g = np.where(choice[v[:, edge]] == 3, 0, choice[v[:, edge]]).astype(np.int64)
            g[side, np.arange(len(edge))] = 0
            choice[v[side, edge]] = (side - g.sum(0)) % 3
        return cls(seed, third, choice)

    @staticmethod
    def _peel(v: np.ndarray, n_vertices: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = v.shape[1]
        degree = np.bincount(v.ravel(), minlength=n_vertices)
        held = np.zeros(n_vertices, np.int64)  # sum of the edges at a vertex: the edge itself at degree 1
        for k in range(3):
            np.add.at(held, v[k], np.arange(n))
        rounds, gone = [], np.zeros(n, bool)
        at = np.flatnonzero(degree == 1)
        while len(at):
            edge, pick = np.unique(held[at], return_index=True)
            side = at[pick] // (n_vertices // 3)
            rounds.append((edge, side))
            gone[edge] = True
            touched = v[:, edge].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(held, touched, np.tile(edge, 3))
            touched = np.unique(touched)
            at = touched[degree[touched] == 1]
        return rounds if gone.all() else None

    def position(self, keys: np.ndarray) -> np.ndarray:
        v = _vertices(_key_hash(keys, self.seed), self.third)
        g = self.choice[v].astype(np.int64) % 3
        at = v[g.sum(0) % 3, np.arange(len(keys))]
        block = at // _CHECK
        inside = np.array([self.used[b * _CHECK : a].sum() for a, b in zip(at.tolist(), block.tolist(), strict=True)], np.int64) if len(at) < 64 else (np.cumsum(self.used) - self.used)[at] - self.ranks[block]
        return np.minimum(self.ranks[block] + inside, max(int(self.used.sum()) - 1, 0))


_ENTRY = np.dtype([("print", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8"), ("records", "<i4")])


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_key_hash(keys, 1 << 20) >> U64(32)).astype(np.uint32)


def bucket_bytes(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray, records: np.ndarray) -> bytes:
    """A bucket's file: a JSON line, the vertices' choices, four to a byte, the entries."""
    ph = PerfectHash.build(keys)
    rows = np.zeros(len(keys), _ENTRY)
    at = ph.position(keys)
    for name, values in (("print", _fingerprint(keys)), ("shard", shard), ("offset", offset), ("length", length), ("records", records)):
        rows[name][at] = values
    c = np.concatenate((ph.choice, np.zeros(-len(ph.choice) % 4, np.int8))).astype(np.uint8).reshape(-1, 4)
    packed = (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8)
    return json.dumps({"seed": ph.seed, "third": ph.third, "keys": len(keys)}).encode() + b"\n" + packed.tobytes() + rows.tobytes()


class Bucket:
    def __init__(self, raw: bytes):
        head, _, body = raw.partition(b"\n")
        meta = json.loads(head)
        n = 3 * meta["third"]
        packed = np.frombuffer(body, np.uint8, -(-n // 4))
        choice = np.stack([packed >> k & 3 for k in (0, 2, 4, 6)], 1).ravel()[:n].astype(np.int8)
        self.hash = PerfectHash(meta["seed"], meta["third"], choice)
        self.rows = np.frombuffer(body, _ENTRY, meta["keys"], len(packed))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mask of keys that are there, their entries): a key that isn't there passes with a chance of 2^-32."""
        rows = self.rows[self.hash.position(keys)]
        ok = rows["print"] == _fingerprint(keys)
        return ok, rows[ok]


# --- writing and reading -------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", end_id: int = 2, width: int = 2, path: str | None = None, memory: int = MEMORY, shard_bytes: int = 1 << 30) -> str:
    """Write shards and index; returns the folder. width: bytes of an id (2 up to 65,536 ids, else 4)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-index")
    tune(spark)
    dtype = {2: "<u2", 4: "<u4"}[width]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, me, at = Encoder.of(tokenizer, end_id, memory), TaskContext.get().partitionId(), 0
        with _Output(f"{path}/shards/{me:06d}.bin") as out:
            for batch in batches:
                found = enc.ids(["" if t is None else t for t in batch.column("text").to_pylist()])
                length = np.array([len(b) // 4 for b in found], np.int64)
                ids = np.frombuffer(b"".join(found), "<u4")
                if width == 2 and ids.max(initial=0) > 65535:
                    raise ValueError("ids need width=4")
                out.write(ids.astype(dtype))
                ends = at + np.cumsum(length)
                at = int(ends[-1]) if len(ends) else at
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.full(len(length), me)), pa.array(ends - length), pa.array(length)], ["k", "shard", "offset", "length"])

    order = ("k", "x", "row")  # the row's number lets equal rows stand in several shards
    keyed = docs.select(F.col(key).cast("long").alias("k"), "text", F.xxhash64("text").alias("x"), F.monotonically_increasing_id().alias("row"))
    rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("k", "text").mapInArrow(lean(shard, encodes=True), "k long, shard long, offset long, length long")
    rows.write.parquet(f"{path}/records")
    records = spark.read.parquet(f"{path}/records")
    totals = {r.shard: r.n for r in records.groupBy("shard").agg(F.sum("length").alias("n")).collect()}  # one row per shard
    keys = records.where(F.col("k").isNotNull()).groupBy("k").agg(F.min(F.struct("shard", "offset", "length")).alias("r"), F.count(F.lit(1)).alias("records"))
    n_buckets = max(1, -(-records.count() // BUCKET))
    _put_manifest(path, {"width": width, "buckets": n_buckets, "shards": {str(k): v for k, v in sorted(totals.items())}})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = []
        last = None
        done: list[int] = []

        def flush() -> None:
            k = [np.concatenate(c) for c in zip(*cols, strict=True)]
            _write(f"{path}/index/{last:06d}.mph", bucket_bytes(*k))
            done.append(last)

        for batch in batches:
            got = [batch.column(c).to_numpy() for c in ("b", "k", "shard", "offset", "length", "records")]
            edges = np.flatnonzero(np.diff(got[0])) + 1
            for part in zip(*(np.split(g, edges) for g in got), strict=True):
                if not len(part[0]):
                    continue
                if last is not None and part[0][0] != last:
                    flush()
                    cols = []
                last = int(part[0][0])
                cols.append(list(part[1:]))
        if last is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["b"])

    dealt = keys.select(_bucket(F.col("k"), n_buckets).alias("b"), "k", "r.shard", "r.offset", "r.length", "records")
    dealt.repartition(min(n_buckets, n), "b").sortWithinPartitions("b").mapInArrow(lean(index), "b long").count()
    return path


def _bucket(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n))


def _put_manifest(path: str, what: dict) -> None:
    _write(f"{path}/manifest.json", json.dumps(what).encode())


def lookup(spark: SparkSession, path: str, keys: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Find keys by the index: key, shard, offset, length, records; keys that aren't stored give no row."""
    meta = json.loads(_read(f"{path}/manifest.json"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for batch in batches:
            b, k = batch.column("b").to_numpy(), batch.column("k").to_numpy()
            edges = np.flatnonzero(np.diff(b)) + 1
            for which, ks in zip(np.split(b, edges), np.split(k, edges), strict=True):
                if not len(ks):
                    continue
                if which[0] != last:
                    last, name = which[0], f"{path}/index/{which[0]:06d}.mph"
                    fs, p = _fs(name)
                    bucket = Bucket(_read(name)) if fs.get_file_info(p).type == pafs.FileType.File else None
                if bucket is None:
                    continue
                ok, rows = bucket.find(ks)
                yield pa.RecordBatch.from_arrays([pa.array(ks[ok]), *(pa.array(rows[c].astype(np.int64)) for c in ("shard", "offset", "length", "records"))], ["k", "shard", "offset", "length", "records"])

    want = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").withColumn("b", _bucket(F.col("k"), meta["buckets"]))
    dealt = want.repartition(min(meta["buckets"], n), "b").sortWithinPartitions("b")
    return dealt.mapInArrow(lean(find), "k long, shard long, offset long, length long, records long").withColumnRenamed("k", key)


def read(spark: SparkSession, path: str, found: DataFrame, *, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Read found records from their shards: key, start (ids of all records before it), n_tokens, ids_crc32 (and ids)."""
    meta = json.loads(_read(f"{path}/manifest.json"))
    width, first, at = meta["width"], {}, 0
    for k, v in meta["shards"].items():
        first[int(k)] = at
        at += v
    shared = spark.sparkContext.broadcast(first)
    dtype = {2: "<u2", 4: "<u4"}[width]
    names = ["k", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        for batch in batches:
            k, shard, offset, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "shard", "offset", "length"))
            if not len(shard):
                continue
            # Neighbours in a shard are read at once, RUN bytes at most (or one record).
            start, stop = offset * width, (offset + length) * width
            at = 0
            while at < len(shard):
                to = at + 1
                while to < len(shard) and shard[to] == shard[at] and start[to] == stop[to - 1] and stop[to] - start[at] <= RUN:
                    to += 1
                if shard[at] != last:
                    if f is not None:
                        f.close()
                    last, (fs, p) = shard[at], _fs(f"{path}/shards/{shard[at]:06d}.bin")
                    f = fs.open_input_file(p)
                f.seek(int(start[at]))
                raw = f.read(int(stop[to - 1] - start[at]))
                ids = [np.frombuffer(raw[a:b], dtype).astype("<u4").tobytes() for a, b in zip((start[at:to] - start[at]).tolist(), (stop[at:to] - start[at]).tolist(), strict=True)]
                cols = [batch.column("k").slice(at, to - at), pa.array(offset[at:to] + shared.value[int(shard[at])]), pa.array(length[at:to]), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] * keep_ids)], names)
                at = to
        if f is not None:
            f.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = found.withColumnRenamed(key, "k").repartition(max(n, len(first)), "shard").sortWithinPartitions("shard", "offset")
    return by.mapInArrow(lean(fetch), "k long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids).withColumnRenamed("k", key)


def expand(found: DataFrame, path: str, *, key: str = "doc_id", nulls: bool = False) -> DataFrame:
    """Every record of the keys found, those after a repeated key's first too, by their order in the shards; with
    `nulls` the records without a key, too."""
    spark = found.sparkSession
    records = spark.read.parquet(f"{path}/records").withColumnRenamed("k", key)
    out = found.where("records = 1").select(key, "shard", "offset", "length")
    more = found.where("records > 1").select(key).distinct()
    out = out.unionByName(records.join(more, key, "left_semi").select(key, "shard", "offset", "length"))
    return out.unionByName(records.where(F.col(key).isNull()).select(key, "shard", "offset", "length")) if nulls else out
