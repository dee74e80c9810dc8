"""What the training-data operators share: scratch tables, Arrow slices, words, labelled samples."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one Arrow slice holds at most, in bytes; a single longer document is a slice of its own.
SLICE_BYTES = 2_000_000
#: Rows that Spark hands to a Python worker at once, in bytes, where `small_batches` says so; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def crc_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark).rstrip('/')}/gridweave-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables for as long as a `with` block: what is read from them must be written elsewhere, or collected, before it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def publish(spark: SparkSession, name: str, payload: bytes) -> str:
    """Ship a file of bounded size to every executor; returns the name for `SparkFiles.get`."""
    name = f"{hashlib.sha256(payload).hexdigest()[:16]}-{name}"
    path = f"{scratch_root(spark).rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        out = files.create(at, True)
        for i in range(0, len(payload), 1 << 20):
            out.write(bytearray(payload[i : i + (1 << 20)]))
        out.close()
        files.deleteOnExit(at)
    spark.sparkContext.addFile(files.makeQualified(at).toString())
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES: JVM and worker both hold a batch for each running task, of up to 64 MB by default.

    The setting stays, as plans are run after they are made; it tells how rows are cut, not which.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice take about `most` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(docs: DataFrame, columns: list[Column | str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], most: int = SLICE_BYTES, text: str = "text") -> DataFrame:
    """Map slices of `columns` (one named as `text` says) of `most` bytes of text to columns of `schema`. `make` runs once a task and returns the function."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    names = kind.names

    def run(batches):
        # Arrow is told the declared types, so that nulls and empty slices keep them.
        out = to_arrow_schema(kind)
        function = make()
        for part in text_slices(batches, text, most):
            got = function(part)
            yield pa.RecordBatch.from_arrays([got[n].cast(out.field(n).type) if isinstance(got[n], pa.Array) else pa.array(got[n], type=out.field(n).type) for n in names], schema=out)

    return docs.select(*columns).mapInArrow(run, kind)


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row: the optimiser puts a plain column's expression into the lambda functions that use it, to be computed for every element, but moves none through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts; null is the empty text."""
    return [t or "" for t in column_list(batch, "text")]


def lower_words(text: str) -> list[bytes]:
    """Words as UTF-8 with A-Z in lower case. bytes.lower() and bytes.split() know ASCII only, as the contracts do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text as `lower_words` gives them, without an object for each: Arrow's ASCII kernels know the same six spaces."""
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    ends, words = lists.offsets.to_numpy(), lists.flatten().cast(pa.binary())
    ends = ends - ends[0]
    full = pa.compute.greater(pa.compute.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # spaces at an edge of a text leave an empty word
        ends, words = np.concatenate([[0], np.cumsum(full)])[ends], words.filter(pa.array(full))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)


def distinct(words: pa.BinaryArray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word its place among them."""
    coded = words.dictionary_encode()
    own = coded.dictionary
    _, ends, text = own.buffers()
    ends = np.frombuffer(ends, np.int32)[own.offset : own.offset + len(own) + 1].tolist() if len(own) else [0]
    text = text.to_pybytes() if text else b""
    return [text[a:b] for a, b in pairwise(ends)], coded.indices.to_numpy()


def count_words(docs: DataFrame, flush: int = 400_000, documents: bool = False) -> DataFrame:
    """(word, n) over all `docs`: A-Z in lower case, null texts have none. `documents` adds a null word that each document has once.

    Each task adds up its own words and gives them out whenever it holds `flush` of them; the sum over the tasks is
    one shuffle of pre-aggregated rows, so that a very common word is a row a task, not a row an occurrence.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return got

        for part in text_slices(batches):
            if documents:
                held[None] += part.num_rows
            for text in texts_of(part):
                held.update(lower_words(text))
            if len(held) > flush:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """At most `bound` labelled documents (doc_id, text, label), picked by a hash of the id.

    `train` says which ids may be learnt from. Ids and labels that are null do not count; an id with more than one
    label takes the largest. Only ids cross the network: the sample is a bounded broadcast against the documents.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
