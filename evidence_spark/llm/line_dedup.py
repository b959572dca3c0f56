"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches. A run holds (h1, h2, n): a line's hash in two halves and in how
many documents it was found, once per line and sorted. A new batch is merge-anti-joined
with the lines that the runs already show to be frequent enough, its own lines are added as
a run of level 0, and ``fanout`` runs of a level are merged into one of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import join_checked, keyed
from evidence_spark.session import scratch_table, shuffle_partitions

SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """White space of ASCII stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _UPPER.lower())


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(17), F.reverse(key)).alias("h2"))


def line_hashes(docs: DataFrame, batches: int, least_points: int = 1) -> DataFrame:
    """(k1, k2, h1, h2, batch): each line key of each row once."""
    lines = keyed(docs).select("k1", "k2", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))).alias("key"))
    kept = lines.filter(F.char_length("key") >= least_points).select("k1", "k2", _hash(F.col("key")).alias("h"))
    return kept.select("k1", "k2", "h.h1", "h.h2", F.pmod(F.xxhash64("k1", "k2", F.lit(3)), F.lit(batches)).cast("int").alias("batch"))


class LineRuns:
    """The runs seen so far; ``add`` takes a batch of (h1, h2), one row per line and document."""

    def __init__(self, least_documents: int, fanout: int = 2):
        self.least, self.fanout = least_documents, fanout
        self.levels: list[list[DataFrame]] = []
        self.frequent: DataFrame | None = None

    def _run(self, counts: DataFrame) -> DataFrame:
        parts = shuffle_partitions(counts.sparkSession)
        return scratch_table(counts.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2"), "line-run")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        together = runs[0]
        for run in runs[1:]:
            together = together.unionByName(run)
        return together.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        new = batch.select("h1", "h2")
        if self.frequent is not None:
            new = join_checked(new, self.frequent, ["h1", "h2"], "left_anti")
        runs, level = self._run(new.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(runs)
            if len(self.levels[level]) < self.fanout:
                break
            runs = self._run(self._merged(self.levels[level]))
            more = runs.filter(F.col("n") >= self.least).select("h1", "h2")
            known = more if self.frequent is None else self.frequent.unionByName(more).distinct()
            self.frequent = scratch_table(known, "line-frequent")
            self.levels[level] = []
            level += 1

    def found_often(self) -> DataFrame:
        """(h1, h2) of all lines in at least ``least`` of the documents added."""
        runs = [run for level in self.levels for run in level]
        counted = self._merged(runs).filter(F.col("n") >= self.least).select("h1", "h2")
        return scratch_table(counted if self.frequent is None else counted.unionByName(self.frequent).distinct(), "line-frequent")


def without_frequent_lines(docs: DataFrame, least_documents: int = 10, least_points: int = 1, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(k1, k2, row, n_lines, n_dropped, kept): the texts without the lines whose key was found
    in at least ``least_documents`` rows of ``docs``; one row for each row.

    A null or empty text is one empty line, and stays so. Keys of fewer than ``least_points``
    code points stay. A line repeated within one document counts once; repeated rows count
    each. A document that loses all its lines keeps an empty text.
    """
    hashes = scratch_table(line_hashes(docs, batches, least_points), "line-hashes")
    runs = LineRuns(least_documents, fanout)
    for batch in range(batches):
        runs.add(hashes.filter(F.col("batch") == batch))
    hit = join_checked(hashes.select("k1", "k2", "h1", "h2"), runs.found_often(), ["h1", "h2"], "inner")
    per_document = scratch_table(hit.groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("often")), "line-hits")
    # the text travels once, within its row, and by the same kind of join at any size
    joined = keyed(docs).select("row", "k1", "k2").join(per_document.hint("merge"), ["k1", "k2"], "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    stay = F.when(F.col("often").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("often", _hash(line_key(x)))))
    split = joined.select("k1", "k2", "row", F.size(lines).cast("long").alias("n_lines"), stay.alias("stay"))
    return split.select("k1", "k2", "row", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("kept"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the same columns and rows, texts without their frequent lines; a null text
    stays null."""
    done = without_frequent_lines(docs, **options)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return done.select(F.col("row").withField("text", text).alias("row")).select("row.*")
