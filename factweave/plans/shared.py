"""Tables and markers in the folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, as in local tests, a temporary folder is set for it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_kept: set[str] = set()


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name below the application's part of the shared folder, which is deleted when the application ends."""
    own = f"{shared_root(spark)}/factweave/{spark.sparkContext.applicationId}"
    if own not in _kept:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _kept.add(own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


class SharedFiles:
    """Small files on the shared file system, published by rename: a reader sees the old or the new one, never a part."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def children(self, path: str, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of the folder's entries that begin so."""
        p, fs = self._at(path)
        names = [str(f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []
        return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]

    def read_json(self, path: str):
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish_json(self, path: str, value) -> None:
        p, fs = self._at(path)
        part, _ = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(part, True)
        stream.write(json.dumps(value).encode())
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(part, p, options)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def cut(df, purpose: str):
    """``df`` written to the shared folder and read back: its lineage ends there, and no executor holds it."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
