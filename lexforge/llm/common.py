"""Helpers shared by the corpus operators: shared-folder materialisation, connected components, prefix
sums and vectorised word hashing over Arrow text columns."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space and 0x09-0x0D).
WORD = r"[^\x20\x09-\x0D]+"

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its freed memory stays with the worker
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where that is unset, a fresh one in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexforge-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexforge_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_lexforge_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: bytes of a broadcast table whose rows have a variable size
SMALL_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, max_rows: int, size: Column | None = None) -> DataFrame:
    """Hint a broadcast only where a count proves the table small; otherwise it stays a shuffle join.

    Rows of fixed width are counted; with size, their bytes, the sum over all rows is held against SMALL_BYTES too.
    """
    if size is None:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
    rows, total = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and total <= SMALL_BYTES else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of edges (u, v) with the smallest node of their component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), so the edge count never grows and a
    hub is handled by an aggregate plus a join instead of one task's list. Each round is a table in the
    shared folder. Rows with a null end or u = v are no edges. Returns (node, component) for nodes with an
    edge; the order of u and v must be total (longs, strings).
    """
    e = materialize(edges.where("u <> v").select("u", "v").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(small)
        now = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        discard(e)
        e = nxt
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, n_rows: int, leaf: int = 512) -> DataFrame:
    """Exclusive running sum of value within keys, without ever sorting one whole key in a task.

    The running order is that of the order columns' 64-bit hash, then of the columns: the same for any n_rows and
    leaf. Rows are dealt into buckets of about leaf rows by the hash's leading bits; sums within a bucket and over the
    buckets before it nest, so a key with a third of all rows costs many small windows. Bucket totals are dealt
    again by fewer leading bits while there are more than leaf of them.
    """
    d = df.withColumn("_order", F.xxhash64(*order))
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / leaf)))
    same = lambda names: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]
    if not bits:
        w = Window.partitionBy(*keys).orderBy("_order", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return d.withColumn(out, F.sum(value).over(w) - F.col(value)).select(*df.columns, out)

    def starts(totals: DataFrame, bits: int) -> DataFrame:
        """(keys, _bucket, _start) of totals (keys, _bucket, _total), _bucket being the hash's first bits."""
        up = min(bits, max(1, int(math.log2(leaf))))
        rest = bits - up
        t = totals.withColumn("_up", F.shiftright("_bucket", up))
        w = Window.partitionBy(*keys, "_up").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumn("_start", F.sum("_total").over(w) - F.col("_total"))
        if not rest:
            return t.select(*keys, "_bucket", "_start")
        above = starts(totals.groupBy(*keys, F.shiftright("_bucket", up).alias("_bucket")).agg(F.sum("_total").alias("_total")), rest)
        both = t.select(*keys, F.col("_up"), "_bucket", "_start").alias("a").join(above.select(*keys, F.col("_bucket").alias("_up"), F.col("_start").alias("_above")).alias("b"), same([*keys, "_up"]))
        return both.select(*[F.col(f"a.{k}") for k in keys], F.col("a._bucket"), (F.col("a._start") + F.col("b._above")).alias("_start"))

    # the leading bits of the hash with its sign flipped, so that buckets rise with the (signed) hash
    d = d.withColumn("_bucket", F.shiftrightunsigned(F.col("_order").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_order", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = d.withColumn("_in", F.sum(value).over(w) - F.col(value))
    begin = starts(d.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total")), bits)
    joined = inner.alias("a").join(begin.alias("b"), same([*keys, "_bucket"]))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._in") + F.col("b._start")).alias(out))


# -- vectorised words over Arrow text ---------------------------------------------------------------

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_RINV = _U(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(1, 257, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: powers are kept up to here (16 bytes each); a longer text has its own worked out and dropped
_KEPT_POWERS = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows[0]) >= n:
        return _pows[0], _pows[1]
    new = []
    for base in (_R, _RINV):
        steps = np.full(1 << max(16, (n - 1).bit_length()) if n <= _KEPT_POWERS else n, base, np.uint64)
        steps[0] = 1
        new.append(np.cumprod(steps, dtype=np.uint64))
    if n <= _KEPT_POWERS:
        _pows[:] = new
    return new[0], new[1]


def release() -> None:
    """Give freed memory back to the system: Python workers are kept for later tasks, and so is all that they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: Spark's own bound of an Arrow batch, and ours: a task holds a batch several times over, in the JVM and in Python
_DEFAULT_BATCH, ARROW_BYTES = "67108864b", 8 << 20


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with batches of ARROW_BYTES at most (one longer row excepted).

    The bound is a session setting that counts when the plan runs; it is set unless someone has chosen one.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) == _DEFAULT_BATCH:
        conf.set(key, str(ARROW_BYTES))
    return df.mapInArrow(f, schema)


def slices(column: pa.Array, max_bytes: int = 500_000):
    """Yield (first row, last row + 1) runs of a string column of at most max_bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, "right")) - 1)
        b = min(b, len(column))
        yield a, b
        a = b


#: bytes of text whose words are hashed at a time
SPAN_BYTES = 1 << 20


class Words:
    """Words of every text in a string column: byte spans, 64-bit hashes and the row that each belongs to."""

    def __init__(self, column: pa.Array, lower: bool):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        self.rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.rows + 1]
        buf = column.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and self.rows else np.zeros(0, np.uint8)
        self.data, self.offsets = data, offsets - offsets[0]
        n = len(data)
        space = _SPACE[data]
        brk = np.ones(n + 1, bool)
        brk[1:n] = space[:-1]
        inner = self.offsets[self.offsets < n]
        brk[inner] = True
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after[(inner - 1)[inner > 0]] = True
        self.start = np.flatnonzero(~space & brk[:n])
        self.end = np.flatnonzero(~space & after) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.hash = np.zeros(len(self.start), np.uint64)
        # a very long text takes its words in spans, so that only what is kept grows with it
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + SPAN_BYTES, "right")))
            low, high = int(self.start[at]), int(self.end[to - 1])
            power, inverse = _powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((_LOWER if lower else _SAME)[data[low:high]] * power[: high - low], out=sums[1:])
            x, y = self.start[at:to] - low, self.end[at:to] - low
            self.hash[at:to] = mix64((sums[y] - sums[x]) * inverse[x] + (y - x).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
            at = to
        #: first word of each row, and one more
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie within one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total += self.hash[i : n - k + 1 + i] * _MULT[i % 5] * _U(2 * (i // 5) + 1)
        valid = np.zeros(n, bool)
        valid[: n - k + 1] = self.row[: n - k + 1] == self.row[k - 1 :]
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix64(total)
        return out, valid

    def shingle_sets(self, k: int = 5) -> list[np.ndarray]:
        """For each row its sorted distinct shingle hashes; a row of 1 to k-1 words has its whole sequence as one."""
        s, valid = self.shingles(k)
        out = []
        for r in range(self.rows):
            a, b = self.first[r], self.first[r + 1]
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                h = self.hash[a:b] * _MULT[: b - a]
                out.append(mix64(h.sum(keepdims=True, dtype=np.uint64) + _U(int(b - a)) * _U(0x2545F4914F6CDD1D)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
