"""Tables written in the middle of a job, in the shared folder the session names."""

import tempfile
import uuid

_LOCAL = {}


def scratch_dir(spark):
    """The folder of ``spark.checkpoint.dir``; a temporary one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="corpusctx-")
    return _LOCAL[app]


def materialize(df, label):
    """Write ``df`` once and read it back: cuts lineage and fixes row placement."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
