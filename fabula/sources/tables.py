"""Tables between jobs, in the folder that all machines share, and what is needed to look at folders there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``.  Where that is not set, a local session (tests) has a folder of its
    own; on a cluster that is an error, as its machines share no temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="fabula-")
        named = _own[context.applicationId]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what follows reads the table and not what made it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_plain_name(name: str) -> bool:
    """Whether ``name`` can only be that of something directly within a folder, and one that Spark reads."""
    return bool(name) and "/" not in name and "\\" not in name and ".." not in name and name[0] not in "._"


class Folder:
    """A folder in whichever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self._at = path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self._at(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self, folders: bool = False) -> list[str]:
        """What lies directly in the folder (or its folders only), sorted; nothing if there is no such folder."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._of("")) if f.isDirectory() or not folders) if self.exists() else []

    def put(self, name: str, text: str) -> bool:
        """A new file with ``text``, there as a whole or not at all; false, and nothing changed, if the name is taken."""
        draft = self._of(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.exists(self._of(name)) and self._fs.rename(draft, self._of(name)):
            return True
        self._fs.delete(draft, False)
        return False

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._of(name), True)
