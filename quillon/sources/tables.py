"""Files in and out: chunk and gold tables as JSON lines, markdown trees, stored indexes with their state."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown
from ..functions.text import humanised_stem, keep_path, strip
from ..operators import bm25
from ..operators.evaluation import require_valid
from ..schemas import CHUNK, DOCUMENT, FAITHFULNESS, GOLD

#: the address of a page: language, slug
URL = "https://kubernetes.io/%s/docs/%s/"


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are none, a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, CHUNK)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return require_valid(read_lines(spark, path, GOLD))


def read_faithfulness(spark: SparkSession, path: str) -> DataFrame:
    items = read_lines(spark, path, FAITHFULNESS)
    twice = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice.id}: duplicate id")
    return items


def read_markdown(spark: SparkSession, root: str, langs=("en", "ja"), commit_sha: str = "", include_reference: bool = False) -> DataFrame:
    """Pages under ``root``/content/<lang> that belong to the corpus, one row each; files are read whole."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{root}/content")
    place = F.regexp_extract("path", r"/content/([^/]+)/(.+)$", 1), F.regexp_extract("path", r"/content/([^/]+)/(.+)$", 2)
    got = raw.select(place[0].alias("lang"), F.url_decode(F.replace(place[1], F.lit("+"), F.lit("%2B"))).alias("parallel_id"), F.decode("content", "UTF-8").alias("body"))
    got = got.where(F.col("lang").isin(*langs) & keep_path(F.col("parallel_id"), include_reference))
    title = strip(F.coalesce(markdown.front_matter_title(F.col("body")), humanised_stem(F.col("parallel_id"))))
    slug = F.regexp_replace(F.regexp_replace("parallel_id", "^docs/", ""), r"\.md$", "")
    return got.select("parallel_id", "lang", title.alias("title"), F.format_string(URL, "lang", slug).alias("url"), "body", F.lit(commit_sha).alias("commit_sha")).to(DOCUMENT)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a local run without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = getattr(spark, "_quillon_tables", None) or "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark._quillon_tables = at
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder and read back, so that it is worked out once."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan has fewer splits than that: a file of one row group is read by one task.

    A scan of many splits, which large tables have, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 2 * cores else df.repartition(cores)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def changed_at(spark: SparkSession, path: str) -> int:
    """When the newest file of a source was written, in milliseconds."""
    fs, p = _fs(spark, path)
    return max((f.getModificationTime() for f in [fs.getFileStatus(p), *fs.listStatus(p)]), default=0)


def source_state(spark: SparkSession, path: str) -> dict:
    """The resolved place of a source and its bytes, which tell whether an index is current."""
    fs, p = _fs(spark, path)
    return {"source": fs.resolvePath(p).toString(), "bytes": fs.getContentSummary(p).getLength()}


class Versions:
    """Numbered versions of a stored thing under one folder.

    A version is a folder whose state file is written last: it is there for readers from then
    on, and never changed.  Readers take the newest; who began with an older one goes on
    reading it until ``forget`` removes it.  Two writers cannot finish the same version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.root = _fs(spark, self.path)

    def _numbers(self, finished: bool = True) -> list[int]:
        if not self.fs.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [n for n in found if self.fs.exists(_fs(self.spark, self._state(n))[1])] if finished else found

    def folder(self, n: int) -> str:
        return f"{self.path}/v{n:08d}"

    def _state(self, n: int) -> str:
        return f"{self.folder(n)}/state.json"

    def newest(self) -> tuple[int, dict] | None:
        """The newest finished version and its state."""
        numbers = self._numbers()
        return (numbers[-1], self.state(numbers[-1])) if numbers else None

    def state(self, n: int) -> dict:
        return json.loads(self.spark.read.text(self._state(n), wholetext=True).first().value)

    def begin(self) -> int:
        """A number that no version has, finished or not; its folder is made at once."""
        n = max(self._numbers(finished=False), default=0) + 1
        while not self._claim(n):
            n += 1
        return n

    def _claim(self, n: int) -> bool:
        p = _fs(self.spark, f"{self.folder(n)}/.claim")[1]
        try:
            self.fs.create(p, False).close()
        except Exception:
            if self.fs.exists(p):
                return False
            raise
        return True

    def finish(self, n: int, state: dict) -> None:
        out = self.fs.create(_fs(self.spark, self._state(n))[1], False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def forget(self, keep: int = 2) -> None:
        """Removes all but the ``keep`` newest versions and those whose parts they name; nothing may read the others any more."""
        numbers = self._numbers()
        stay = set(numbers[-keep:] if keep else [])
        stay |= {v for n in stay for v in self.state(n).get("written", {}).values()}
        for n in numbers:
            if n not in stay:
                self.fs.delete(_fs(self.spark, self.folder(n))[1], True)


PARTS = ("postings", "doc_stats", "term_idf", "corpus_stats")
#: postings of one file of a stored index, about
FILE_POSTINGS = 1 << 22


def is_current(spark: SparkSession, path: str, state: dict) -> bool:
    """Whether the newest version of the index was made from that state."""
    have = Versions(spark, path).newest()
    return have is not None and have[1] == state


def save_index(index: bm25.Bm25Index, path: str, state: dict) -> int:
    """A new version of a stored index: four Parquet tables, which readers see once all are written.

    Postings are ranges of (term, chunk), so that a search skips files and row groups, and those of
    a term that most chunks hold are as many files as their number asks for.
    """
    spark = index.postings.sparkSession
    versions = Versions(spark, path)
    n = versions.begin()
    at = versions.folder(n)
    files = max(spark.sparkContext.defaultParallelism, -(-index.postings.count() // FILE_POSTINGS))
    index.postings.repartitionByRange(files, "term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{at}/postings")
    for part in PARTS[1:]:
        getattr(index, part).write.parquet(f"{at}/{part}")
    versions.finish(n, state)
    return n


def current_index(spark: SparkSession, path: str, state: dict, build: Callable[[], bm25.Bm25Index], **cutting) -> bm25.Bm25Index:
    """The stored index that was made from ``state``, which ``build`` makes and ``save_index`` stores where there is none."""
    if not is_current(spark, path, state):
        save_index(build(), path, state)
    return load_index(spark, path, **cutting)


def load_index(spark: SparkSession, path: str, version: int | None = None, **cutting) -> bm25.Bm25Index:
    """A saved index, the newest version unless one is named; ``cutting``: its cut and segmenter, if not the usual ones."""
    versions = Versions(spark, path)
    have = versions.newest()
    if version is None and have is None:
        raise FileNotFoundError(f"no finished index at {path}")
    at = versions.folder(version or have[0])
    return bm25.Bm25Index(*(spark.read.parquet(f"{at}/{p}") for p in PARTS), **cutting)


def build_or_load(spark: SparkSession, chunks_path: str, index_path: str, **cutting) -> bm25.Bm25Index:
    """The stored index if its source has the same place and size and the segmenter is the same, else a new version."""
    state = source_state(spark, chunks_path)
    if "segmenter" in cutting:
        state["segmenter"] = cutting["segmenter"]
    return current_index(spark, index_path, state, lambda: bm25.build_index(read_chunks(spark, chunks_path), **cutting), **cutting)


#: buckets of a new vector collection
BUCKETS = 64


def upsert_vectors(chunks: DataFrame, embedder, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Chunks with their points and vectors, one for each chunk id, in place of those of the same id.

    A collection is hash buckets of chunk ids; its state lists the version in which each bucket was
    last written.  Only buckets that hold a changed id are read and written again, and the state
    that names them comes last, so readers see the old collection until the new one is whole.  Of
    rows with one id in ``chunks`` the one with the greatest text stays; rows without an id are
    passed over.  An existing collection of another dimension or embedder is refused; ``buckets``
    counts for a new one.
    """
    from ..functions.text import for_embedding, point_id

    spark, versions = chunks.sparkSession, Versions(spark=chunks.sparkSession, path=path)
    have = versions.newest()
    state = have[1] if have else {"embedder": embedder.name, "dim": embedder.dim, "buckets": buckets, "written": {}}
    if state["dim"] != embedder.dim:
        raise ValueError(f"the collection holds vectors of {state['dim']} numbers, the embedder gives {embedder.dim}")
    if state["embedder"] != embedder.name:
        raise ValueError(f"the collection was made with {state['embedder']}, not {embedder.name}")
    once = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in chunks.columns if c != "chunk_id"]), F.coalesce("text", F.lit(""))).alias("row"))
    new = once.select("chunk_id", "row.*").select(*chunks.columns).withColumn("point_id", point_id(F.col("chunk_id")))
    new = new.withColumn("embedding", embedder.embed_passages(for_embedding(F.col("title"), F.col("section_path"), F.col("text"))))
    new = kept(new.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(state["buckets"])).cast("int")))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched and have:
        return read_vectors(spark, path)
    old = [_bucket(versions, state, b) for b in touched if str(b) in state["written"]]
    rows = new
    if old:
        before = spark.read.option("mergeSchema", True).parquet(*old).join(new.select("chunk_id"), "chunk_id", "left_anti")
        rows = before.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(state["buckets"])).cast("int")).unionByName(new)
    n = versions.begin()
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{versions.folder(n)}/data")
    versions.finish(n, state | {"written": state["written"] | {str(b): n for b in touched}, "schema": new.drop("bucket").schema.json()})
    return read_vectors(spark, path)


def _bucket(versions: Versions, state: dict, bucket: int) -> str:
    return f"{versions.folder(state['written'][str(bucket)])}/data/bucket={bucket}"


def collection_state(spark: SparkSession, path: str) -> dict | None:
    have = Versions(spark, path).newest()
    return have[1] if have else None


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of a collection: the last version of each of its buckets."""
    versions, state = Versions(spark, path), collection_state(spark, path)
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    places = [_bucket(versions, state, b) for b in state["written"]]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def compact_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All buckets in one new version, after which older ones may be removed with ``Versions.forget``."""
    versions, state = Versions(spark, path), collection_state(spark, path)
    n = versions.begin()
    rows = read_vectors(spark, path).withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(state["buckets"])).cast("int"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{versions.folder(n)}/data")
    versions.finish(n, state | {"written": {b: n for b in state["written"]}})
    return read_vectors(spark, path)
