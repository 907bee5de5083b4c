"""Line dedup: levelled sorted runs of line hashes, compacted periodically; a batch merge-anti-joins the runs.

A line's key is the line without white space at both ends and with A-Z in lower case; only keys of `min_chars` code
points or more take part. A run is a table of key hashes (128 bits), bucketed and sorted by them, so that merges and the
anti-join read it without a shuffle. Each batch of documents is split by the runs: keys that no run holds are new and stand
in the batch's own run as such, the others add to the counts of a key that stands elsewhere. `fanout` runs of a level are
merged into one of the next. The list of runs is a table as well, so that a later call or session with the same root goes on
with the runs: its documents are judged with all that earlier ones held. Their ids must be others than those of earlier calls,
as a document counts once per call. Everything is DataFrame operations.

Null or empty text is one empty line. A document is an id: rows that repeat an id count once for a key and share its
fate. Null ids hold no line: they do not count, and their lines go like any others. Extra columns are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, scratch, written


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE_CHARS)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark(text: Column) -> Column:
    """Tells the texts of rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """(doc_id, mark, pos, h1, h2, batch) of the lines long enough; the batch follows the id."""
    lines = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keys = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    return keys.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second half"), F.col("key")).alias("h2"), batch.alias("batch"))


class LineRuns:
    """The runs of a corpus, as bucketed tables in the shared folder.

    A run has h1, h2, n_docs (documents that hold the key), holder (the largest doc_id) and `new`: whether the key stands
    here first. A key is new in one run only, which is what the anti-join of a batch provides.
    """

    COLUMNS = "h1 long, h2 long, n_docs long, holder long, new boolean"
    LIST = "version long, level int, place int, path string, buckets int"

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2):
        """root: a new folder (`open` goes on with one that holds runs); None is a new folder in the shared one."""
        self.spark, self.fanout = spark, fanout
        self.root = root or scratch(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, fanout: int = 2) -> LineRuns:
        """The runs that an earlier call or session left under root; none yet if it is new."""
        runs = cls(spark, root, fanout)
        try:
            listed = spark.read.schema(cls.LIST).parquet(f"{root}/list")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return runs
        last = listed.where(F.col("version") == listed.agg(F.max("version")).first()[0]).orderBy("level", "place").collect()
        for row in last:
            runs.version = row["version"]
            while len(runs.levels) <= row["level"]:
                runs.levels.append([])
            runs.levels[row["level"]].append(row["path"])
            if not spark.catalog.tableExists(cls._table(row["path"])):
                spark.sql(f"create table {cls._table(row['path'])} ({cls.COLUMNS.replace('new ', '`new` ')}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {row['buckets']} buckets location '{row['path']}'")
        return runs

    @staticmethod
    def _table(path: str) -> str:
        return path.rsplit("/", 1)[1].replace("-", "_")

    def _buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        run.select("h1", "h2", "n_docs", "holder", "new").write.bucketBy(self._buckets(), "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(self._table(path))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _note(self) -> None:
        """Adds the present list of runs to the table of lists; the newest version counts."""
        self.version += 1
        rows = [(self.version, level, place, path, self._buckets()) for level, paths in enumerate(self.levels) for place, path in enumerate(paths)]
        self.spark.createDataFrame(rows, self.LIST).coalesce(1).write.mode("append").parquet(f"{self.root}/list")

    def rows(self, paths: list[str] | None = None) -> DataFrame:
        """The rows of some runs, or of all."""
        out = self.spark.createDataFrame([], self.COLUMNS)
        for k, path in enumerate([p for level in self.levels for p in level] if paths is None else paths):
            out = self.spark.table(self._table(path)) if k == 0 else out.unionByName(self.spark.table(self._table(path)))
        return out

    def split(self, own: DataFrame) -> DataFrame:
        """The merge anti-join of a batch's keys (h1, h2, ...): adds `new`, true for those that no run holds yet. One left merge
        join tells both sides, as a key is new in one run only."""
        known = self.rows().where("new").select("h1", "h2", F.lit(True).alias("known")).hint("merge")
        return own.join(known, ["h1", "h2"], "left").withColumn("new", F.col("known").isNull()).drop("known")

    def add(self, lines: DataFrame) -> None:
        """Adds the run of a batch of hashed lines; the documents of two batches must differ."""
        own = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"))
        self._write(self.split(own) if any(self.levels) else own.withColumn("new", F.lit(True)), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)
        self._note()

    def _compact(self, level: int) -> None:
        paths, self.levels[level] = self.levels[level], []
        merged = self.rows(paths).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"), F.bool_or("new").alias("new"))
        self._write(merged, level + 1)

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, holder) of all keys: new rows, and what later batches added to them."""
        every = self.rows()
        more = every.where("not new").groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("holder").alias("later"))
        joined = every.where("new").join(more.hint("merge"), ["h1", "h2"], "left")
        return joined.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("holder", "later").alias("holder"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 6, fanout: int = 2, root: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): keys in `min_docs` documents or more stay in the largest doc_id only.

    The hashed lines of all batches are written once and read batch by batch. The lines to drop are those whose key is
    frequent and that another document holds. Their places are gathered per text (never per key, so a line that all documents
    share costs one short row each), and only then do the texts meet them, by id and mark of the text. The runs stay under
    `root`; one that holds runs of earlier calls is gone on with.
    """
    spark = docs.sparkSession
    path = scratch(spark, "line-hashes")
    hashed_lines(docs, min_chars, batches).write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema("doc_id long, mark long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns.open(spark, root, fanout) if root else LineRuns(spark, None, fanout)
    for batch in range(batches):
        runs.add(hashed.where(F.col("batch") == batch))
    # A table of its own: broadcast if it is small, else the join with the hashed lines is one that Spark can split by skew.
    frequent = written(runs.counts().where((F.col("n_docs") >= min_docs) & F.col("holder").isNotNull()), "frequent-lines")
    lost = hashed.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    per_text = lost.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set("pos").alias("__lost"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = texts["doc_id"].eqNullSafe(per_text["__id"]) & (text_mark(texts["text"]) == per_text["__mark"])
    joined = texts.join(per_text.hint("shuffle_hash"), met, "left").withColumn("__lines", lines_of(F.col("text")))
    # The places that stay are a difference of sets, so a text of many lost lines costs no more than its lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = joined.withColumn("__kept", F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.transform(places, lambda i: F.get("__lines", i))))
    return kept.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("kept_text"),
    )
