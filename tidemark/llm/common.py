"""Shared pieces of the training-data operators: staging, hashing of words and shingles, id filters."""

from __future__ import annotations

import atexit
import ctypes
import gc
import glob
import hashlib
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20
BATCH_ROWS = 2000
ROWS_A_FILE = 400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table, for a registered query. Where the session has not set how many rows an Arrow batch to Python holds, it is
    set to BATCH_ROWS, as texts may be long; operators called with frames of one's own leave the session as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session that is one process (tests) may leave it
    unset and gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str, rows: int | None = None, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. Removed when the driver ends.
    rows: where given, about how many there are, so that few rows do not become many files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // rows_a_file)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def cleaned(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now: it does so only once the driver has collected the frames that made
    them, and a job of many steps would keep those of all its steps on the executors' disks till then. The driver's JVM then hands
    back what its compiler and others freed outside the heap."""
    gc.collect()
    spark._jvm.System.gc()
    _trim_jvm(spark)


def _trim_jvm(spark: SparkSession) -> None:
    """malloc_trim in the driver's JVM, by its diagnostic command: else its allocator keeps freed pages, some 180 MB after a join of
    many jobs. Called by reflection, as the server's own class is not exported. JVMs without the command are left as they are."""
    from py4j.protocol import Py4JError

    gateway, lang, of = spark.sparkContext._gateway, spark._jvm.java.lang, spark._jvm.java.lang.Class.forName

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    kinds = array(lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    try:
        call = of("javax.management.MBeanServer").getMethod("invoke", kinds)
        name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        call.invoke(server, array(lang.Object, name, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JError:
        pass


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._staged_at)


def held(df: DataFrame) -> DataFrame:
    """df on the executors' disks while several jobs read it; what a lost executor held is computed again. For results of a few
    steps only: longer lineages are cut by tables. Ends with unpersist()."""
    return df.persist(StorageLevel.DISK_ONLY)


def settled(df: DataFrame, name: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """df as a staged table of as few files as its rows need, computed by as many tasks as it has before; `rows` of it tells how many."""
    kept = held(df)
    n = kept.count()
    out = staged(kept, name, n, rows_a_file)
    kept.unpersist()
    out.rows = n
    return out


def small(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """df to be broadcast where its counted rows are few; else left to Spark, whose sorted joins split hot keys."""
    return F.broadcast(df) if rows <= most else df


def freed() -> None:
    """Hands memory that a worker no longer needs back to the system, as the worker lives on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def drawn(rows: DataFrame, n: int | dict, seed: int, by: str | None = None, most_bytes: int = 16 << 20) -> DataFrame:
    """At most n rows (n[g] rows) of each group of the column by (None: of all rows), and about most_bytes of text each: those
    least by a hash of id and text, so the same rows whatever the partitions, and null or repeated ids are no more likely than others.
    rows: doc_id, text and other columns. Texts over most_bytes / 64 are not drawn. The number of groups is that of labels."""
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text")
    marked = rows.filter(size <= most_bytes // 64).withColumns({"_group": group, "_place": place})
    most = lambda g: n.get(g, 0) if isinstance(n, dict) else n
    shares = {r[0]: min(1.0, 1.5 * most(r[0]) / r[1], most_bytes / max(1, r[2])) for r in marked.groupBy("_group").agg(F.count("*"), F.sum(size)).collect()}
    if not shares:
        return rows.limit(0)
    table = lambda of: F.create_map(*[F.lit(x) for g in shares for x in (g, of(g))])[F.col("_group")]
    few = marked.filter(F.col("_place") / F.lit(2.0**64) + 0.5 <= table(lambda g: float(shares[g])))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_place"))  # of the few alone
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= table(lambda g: int(most(g)))).drop("_group", "_place", "_rank")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_quietly_remove, spark, path)


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have gone first
        pass


def one_blas_thread() -> None:
    """Small matrix products gain nothing from threads, which then fight with other tasks' for the cores."""
    for lib in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(lib), name)(1)
                break
            except (AttributeError, OSError):
                continue


def held_out(fold: int) -> F.Column:
    """crc32 of the id as text, modulo 5, equals fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == fold


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def kept_rows(docs: DataFrame, decider) -> DataFrame:
    """The rows of docs, all columns as they are, whose text decider() accepts; it is made once a task and maps texts to flags."""

    def run(batches):
        decide = decider()
        for batch in batches:
            flags = decide(texts_of(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(np.asarray(flags, bool)))
        del decide
        freed()

    return docs.mapInArrow(run, docs.schema)


class WordIndex(dict):
    """Numbers words in order of first sight: one dict access a word, and a Python call only for new ones."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def of(self, words: list) -> list[int]:
        return list(map(self.__getitem__, words))


# ---- word and shingle hashes -------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    found = []
    for base in (_ODD, _INVERSE):
        x = np.full(max(n, 2 * SLICE_BYTES + 4096), base, np.uint64)
        x[0] = 1
        found.append(np.multiply.accumulate(x))
    if n <= 4 * SLICE_BYTES:  # those of a single huge word are not kept
        _powers[:] = found
    return found[0], found[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def slices(texts: list[bytes]):
    """Runs of texts of about SLICE_BYTES together: (first, last) pairs. A longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if len(t) > SLICE_BYTES and i > start:
            yield start, i
            start, size = i, 0
        size += len(t)
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: ASCII characters other than letters and digits.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[bytes], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and each text's first index (one more at the end).
    With marks, ASCII punctuation parts words too. Long texts are hashed in pieces of about SLICE_BYTES, cut between words."""
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
        parts = [_word_hashes([p], marks)[0] for p in _pieces(texts[0], marks)]
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    return _word_hashes(texts, marks)


def _pieces(text: bytes, marks: bool):
    """text in order, cut at white space (with marks also at ASCII punctuation) about every SLICE_BYTES; a longer word stays whole."""
    apart = re.compile(rb"[\x00-/:-@\[-`{-\x7f]" if marks else rb"[ \t\n\x0b\x0c\r]")
    at = 0
    while at < len(text):
        cut = apart.search(text, at + SLICE_BYTES)
        to = cut.end() if cut else len(text)
        yield text[at:to]
        at = to


def _word_hashes(texts: list[bytes], marks: bool) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~(_IS_MARK if marks else _IS_SPACE)[buf]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers_to(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    hashes = _mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(first, begins)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's k-word shingles in order of place, as hashes; a text of fewer words is one shingle, none without words."""
    mult = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(k).integers(1, 1 << 62, k)]
    n = len(words)
    if n >= k:
        rolled = words[: n - k + 1] * mult[0]
        for j in range(1, k):
            rolled += words[j : n - k + 1 + j] * mult[j]
        rolled = _mixed(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(rolled[a : b - k + 1])
        elif b > a:
            x = np.uint64(b - a)
            for j in range(b - a):
                x += words[a + j] * mult[j]
            out.append(_mixed(np.array([x ^ _ODD])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes], k: int):
    """Each text's distinct shingle hashes, sorted."""
    with np.errstate(over="ignore"):
        for a, b in slices(texts):
            for x in shingle_hashes(*word_hashes(texts[a:b]), k):
                yield np.unique(x)


def digest(sorted_set: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()


# ---- a bounded filter for ids -------------------------------------------------------------------------------------

FILTER_WORDS, MOST_FILTER_WORDS = 1 << 17, 1 << 21


def filter_words(n: int) -> int:
    """64-bit words of a filter for n ids: sixteen bits an id between 1 MB and 16 MB."""
    return min(MOST_FILTER_WORDS, max(FILTER_WORDS, 1 << max(0, (n // 4)).bit_length()))


def id_filter(ids: DataFrame, column: str, words: int = FILTER_WORDS) -> np.ndarray:
    """A bitmap in which the bit of each id is set, of at most 16 MB whatever the input. Built on the executors by bit_or; at
    most `words` rows reach the driver. It only thins what a join reads afterwards."""
    rows = (
        ids.select(spot_column(column, words).alias("spot"))
        .select(F.expr("spot div 64").alias("w"), F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(words, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def spot_column(column: str, words: int = FILTER_WORDS) -> F.Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(words * 64))


def in_filter(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    s = spots.astype(np.uint64)
    return (bits[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) != 0
