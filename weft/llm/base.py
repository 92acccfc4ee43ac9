"""What the operators of this subpackage share: input tables, the shared folder, packed arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python or back: long texts make small batches, so a worker's memory is bounded.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, after setting the session's limit on the bytes of an Arrow batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session that runs on this machine alone gets a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() has written for df, once nothing reads it any more."""
    if path := getattr(df, "_weft_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at.getParent(), True)


def power_of_two(n: float) -> int:
    """The smallest power of two that is n at least, from 1."""
    return 1 << max(0, int(np.ceil(n)) - 1).bit_length()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length in one compressed blob, byte plane by byte plane, so that sorted or small values shrink."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of pack(), of these numpy types."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for k in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of the runs of equal values; none for an empty array."""
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return head, np.append(head, len(x))[1:]


def in_order(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order by key, then by the further arrays; those are only looked at where keys tie."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else np.zeros(0, np.int64)
    at = order[tied]
    order[tied] = at[np.lexsort((*(m[at] for m in reversed(more)), key[at]))]
    return order


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0..n-1 and the edges a-b, the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label
