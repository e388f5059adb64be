"""Incremental refresh: new files change only the folders and tasks they touch."""

from pyspark.sql import functions as F

from corpusctx.functions import paths, text
from corpusctx.operators.assemble import Templates, block_chars, task_chars
from corpusctx.operators.selection import classify_files, included
from corpusctx.sources.tables import read_latest, read_runs, write_run


class ContextRefresh:
    """Tables below ``path``: ``files`` (contents), ``sizes`` (no contents), ``folders``, ``totals``.

    Each batch of files (project, path, content, and read_error) is written under its epoch, then the
    folder sums and prompt totals of the touched keys are recomputed from ``sizes``.
    A repeated batch rewrites the same epoch. Rows whose ``removed`` is true take their file away;
    a batch holds a file once. As in a batch run, an unreadable file counts as a file of its
    project, and a folder that holds nothing readable has no sum.
    """

    def __init__(self, path, tasks, ignore=(), excludes=(), templates=Templates(), ratio=text.DEFAULT_RATIO):
        self.path, self.tasks, self.ignore, self.excludes = path, tasks, list(ignore), list(excludes)
        self.templates, self.ratio = templates, ratio

    def process(self, batch, epoch):
        spark = batch.sparkSession
        for column, absent in (("read_error", F.lit(None).cast("string")), ("removed", F.lit(False))):
            batch = batch.withColumn(column, F.coalesce(column, absent) if column in batch.columns else absent)
        files = included(classify_files(batch, self.ignore, self.excludes))
        write_run(files, f"{self.path}/files", epoch)
        landed = spark.read.parquet(f"{self.path}/files/run_id={int(epoch)}")
        sizes = block_chars(
            landed.withColumn("folder", paths.folder(F.col("path"))).withColumn(
                "est_tokens", F.when(F.col("read_error").isNull(), text.text_tokens(F.col("content"), self.ratio))
            ),
            self.templates,
        )
        write_run(sizes, f"{self.path}/sizes", epoch)
        touched = spark.read.parquet(f"{self.path}/sizes/run_id={int(epoch)}")
        projects = touched.select("project").distinct()
        current = self._current_sizes(spark, epoch, projects)

        # A folder or project that has lost its last file gets a row as well, which replaces the earlier one.
        folders = touched.select("project", "folder").distinct().join(current, ["project", "folder"], "left")
        write_run(
            folders.groupBy("project", "folder").agg(F.sum("est_tokens").cast("bigint").alias("tokens")),
            f"{self.path}/folders",
            epoch,
        )
        sums = projects.join(current.withColumn("_held", F.lit(1)), "project", "left")
        sums = sums.groupBy("project").agg(
            F.count("_held").alias("n_files"), F.coalesce(F.sum("block_chars"), F.lit(0)).alias("chars")
        )
        total = (F.col("chars") + task_chars(self.templates)).cast("bigint")
        totals = self.tasks.join(sums, "project").select(
            "task_id", "n_files", total.alias("total_chars"), text.estimate_tokens(total, self.ratio).alias("est_tokens")
        )
        write_run(totals, f"{self.path}/totals", epoch)

    def _current_sizes(self, spark, epoch, projects):
        """The newest size row of each file of these projects up to this epoch."""
        runs = read_runs(spark, f"{self.path}/sizes").filter(F.col("run_id") <= int(epoch))
        runs = runs.join(projects, "project", "left_semi")
        newest = F.max(F.struct("run_id", "folder", "est_tokens", "block_chars", "removed")).alias("s")
        newest = runs.groupBy("project", "path").agg(newest).where("NOT s.removed")
        return newest.select("project", "path", "s.folder", "s.est_tokens", "s.block_chars")

    def start(self, stream, checkpoint, available_now=True):
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def files(self, spark):
        return read_latest(spark, f"{self.path}/files", ["project", "path"]).where("NOT removed").drop("run_id", "removed")

    def folders(self, spark):
        return read_latest(spark, f"{self.path}/folders", ["project", "folder"]).where("tokens IS NOT NULL").drop("run_id")

    def totals(self, spark):
        """Totals of every task; a task none of whose files arrived yet counts its own text only."""
        seen = read_latest(spark, f"{self.path}/totals", ["task_id"]).select(
            "task_id", "n_files", F.col("total_chars").alias("_chars")
        )
        total = F.coalesce(F.col("_chars"), task_chars(self.templates)).cast("bigint")
        return self.tasks.join(seen, "task_id", "left").select(
            "task_id",
            F.coalesce("n_files", F.lit(0)).alias("n_files"),
            total.alias("total_chars"),
            text.estimate_tokens(total, self.ratio).alias("est_tokens"),
        )
