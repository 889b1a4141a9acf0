"""What the operators of this subpackage share: a folder that all executors see, written tables, hashes of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Row groups for rows of large binaries: Spark's reader holds up to 4,096 rows of a row group at once.
BLOB_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "8"}


def stash(rows: DataFrame, tag: str, blobs: bool = False) -> DataFrame:
    """Writes rows to the shared folder and reads them again: cuts lineage, survives lost executors. blobs: rows are large."""
    path = new_path(rows.sparkSession, tag)
    rows.write.options(**(BLOB_GROUPS if blobs else {})).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(rows: DataFrame, megabytes: int = 64) -> int:
    """Buckets for what is made of rows: the shuffle partitions, or as many as the scan has parts of so many megabytes, if Spark knows."""
    size, least = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), shuffle_partitions(rows.sparkSession)
    return max(least, size // (megabytes << 20)) if size < 1 << 55 else least  # of unknown sizes Spark says 2^63


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB, unless the session says otherwise: long texts then need little memory."""
    for key, value in (("maxBytesPerBatch", "4194304"), ("maxRecordsPerBatch", "2000")):
        key = f"spark.sql.execution.arrow.{key}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def _odd_inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Words:
    """64-bit hashes of all words of a list of texts at once, in numpy.

    A word's hash is a polynomial of random values of its bytes, taken from running sums over the joined texts, so
    no word becomes a Python object. There are long words for which any such polynomial modulo 2^64 is the same, so words
    of more than ``LONG`` bytes are hashed by xxh3. With ``lower``, A-Z hash as a-z.
    """

    POINT = 0x9E3779B97F4A7C15
    LONG = 64

    def __init__(self, lower: bool, part_letters: bool = False):
        """part_letters: a boundary of letters and ASCII punctuation (but for the apostrophe) ends a word, too."""
        self.part_letters, self.lower = part_letters, lower
        r = np.random.default_rng(20)
        self.value = r.integers(1, 1 << 63, 256, dtype=np.uint64)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[list(SPACE)] = True
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(2 * len(self.up), n, 1 << 20)
            for name, base in (("up", self.POINT), ("down", _odd_inverse(self.POINT))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    @staticmethod
    def _letter_edges(blob: np.ndarray) -> np.ndarray:
        """Where ASCII or Latin letters and digits (to U+027F) meet ASCII punctuation."""
        ascii_kind = np.zeros(256, np.uint8)
        ascii_kind[33:127] = 2
        ascii_kind[39] = 0
        for a, b in ((48, 58), (65, 91), (97, 123)):
            ascii_kind[a:b] = 1
        kind = ascii_kind[blob]
        lead = (blob >= 0xC3) & (blob <= 0xC9)
        lead[:-1] &= ~((blob[:-1] == 0xC3) & ((blob[1:] == 0x97) | (blob[1:] == 0xB7)))  # multiplication and division signs
        lead[:-1] &= ~((blob[:-1] == 0xC4) & (blob[1:] == 0xB0))  # capital i with a dot, whose lower case has a mark
        first = (kind == 1) | lead
        last = kind == 1
        last[1:] |= lead[:-1]
        return np.flatnonzero((last[:-1] & (kind[1:] == 2)) | ((kind[:-1] == 2) & first[1:])) + 1

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text's begin (one more, for the end)."""
        return self.spans(texts)[:2]

    def spans(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """As cut(); also the joined texts and where in them words start and end."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        blob = np.frombuffer(joined, np.uint8)
        gap = self.gap[blob]
        edge = np.flatnonzero(np.concatenate([[True], gap[:-1]]) != gap)
        starts, ends = edge[0::2], edge[1::2]
        if self.part_letters and len(starts):
            inner = self._letter_edges(blob)
            starts, ends = (np.sort(np.concatenate([x, inner])) for x in (starts, ends))
        self._powers(len(blob))
        sums = np.zeros(len(blob) + 1, np.uint64)
        np.cumsum(self.value[blob] * self.up[: len(blob)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > self.LONG).tolist():
            word = joined[starts[k] : ends[k]]
            hashes[k] = xxhash.xxh3_64_intdigest(word.lower() if self.lower else word)  # lower() of bytes takes A-Z alone
        offsets = np.cumsum([0, *[len(x) + 1 for x in raw]])
        return hashes, np.searchsorted(starts, offsets), joined, starts, ends


def text_slices(batch, columns: list[str], most_chars: int = 1_000_000):
    """Slices of an Arrow batch whose first column's texts have about most_chars characters together."""
    import pyarrow.compute as pc

    lengths = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(columns[0])), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, before + most_chars, "right")))
        yield [batch.column(c).slice(start, end - start).to_pylist() for c in columns]
        start = end


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser for uint64 arrays."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def signed(value: int) -> int:
    """An unsigned 64-bit integer as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value


def split_by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray]):
    """An Arrow batch with one row for each bucket that occurs; each column's values lie in one binary, in order."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([cuts[1:], [len(bucket)]]).astype(np.int64)
    arrays = [pa.array(bucket[cuts].astype(np.int32))]
    for values in columns.values():
        values = values[order] if len(values) else values  # a column that these rows do not have
        arrays.append(pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def by_bucket(batches, kinds: dict[str, type]):
    """Of rows that lie together by bucket: each bucket and its arrays."""
    held: dict[str, list[bytes]] = {c: [] for c in kinds}
    now = None
    done = lambda: (now, {c: np.frombuffer(b"".join(x), kinds[c]) for c, x in held.items()})
    for batch in batches:
        buckets = batch.column("bucket").to_pylist()
        columns = {c: batch.column(c) for c in kinds}
        for k, bucket in enumerate(buckets):
            if bucket != now:
                if now is not None:
                    yield done()
                now, held = bucket, {c: [] for c in kinds}
            for c, column in columns.items():
                held[c].append(column[k].as_py())
    if now is not None:
        yield done()


def exchange(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of split_by_bucket, each bucket in one task; a bucket's number is its partition's, so none gets two while others get none."""
    return rows.repartitionById(buckets or shuffle_partitions(rows.sparkSession), F.col("bucket")).sortWithinPartitions("bucket")
