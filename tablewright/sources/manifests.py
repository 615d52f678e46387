"""Folders of one model's results each, replaced as a whole.

Results are first written beside the folders. Their files are then moved into the
model's folder, and a manifest there is replaced in one step; it names the files that
count. Files of earlier results are deleted last. A write that breaks off at any place
leaves a manifest that names whole results, the old ones or the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Names that Spark's readers pass over, as they begin with an underscore.
MANIFEST = "_files"
STAGED = "_staged"
NO_MODEL = "__HIVE_DEFAULT_PARTITION__"


class Files:
    """The file system a path lies in, by Spark's own settings."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none where it is not there."""
        at = self.path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def read(self, path: str) -> str | None:
        at = self.path(path)
        if not self.system.exists(at):
            return None
        stream = self.system.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write a small file so that a reader sees the old text or the new one."""
        partial = self.path(f"{path}-{uuid.uuid4().hex}")
        stream = self.system.create(partial)
        stream.write(bytearray(text.encode()))
        stream.close()
        kinds = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        context.rename(self.system.makeQualified(partial), self.system.makeQualified(self.path(path)), kinds)

    def move(self, source: str, target: str) -> None:
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} cannot be moved to {target}")

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)


def folder_name(spark: SparkSession, model: str) -> str:
    """The folder Spark writes a model's rows to."""
    return "model=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(model)


def replace_models(
    df: DataFrame, path: str, save: Callable[[DataFrameWriter, str], None], models: list[str] | None = None
) -> None:
    """Write the rows of ``df`` per model; each of its models, and of ``models``, then has these rows and no others.

    A model of ``models`` without rows has none afterwards. Other models stay as they are.
    """
    spark = df.sparkSession
    files, root = Files(spark, path), path.rstrip("/")
    staged = f"{root}/{STAGED}-{uuid.uuid4().hex}"
    save(df.write.partitionBy("model"), staged)
    written = {name: files.names(f"{staged}/{name}") for name in files.names(staged) if name.startswith("model=")}
    for folder in sorted({*written, *(folder_name(spark, m) for m in models or [])}):
        named = sorted(n for n in written.get(folder, []) if not n.startswith(("_", ".")))
        place = f"{root}/{folder}"
        files.system.mkdirs(files.path(place))
        for name in named:
            files.move(f"{staged}/{folder}/{name}", f"{place}/{name}")
        files.replace(f"{place}/{MANIFEST}", json.dumps({"files": named}))
        for name in files.names(place):
            if name not in named and not name.startswith(("_", ".")):
                files.delete(f"{place}/{name}")
    files.delete(staged)


def current_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the files that count: the named ones of folders with a manifest, and all of others."""
    if not paths:
        return []
    files = Files(spark, paths[0])
    named: dict[str, set[str] | None] = {}
    kept = []
    for path in paths:
        folder, name = path.rsplit("/", 1)
        if folder not in named:
            text = files.read(f"{folder}/{MANIFEST}")
            named[folder] = None if text is None else set(json.loads(text)["files"])
        # paths are listed with escapes that the manifest's names do not need
        if named[folder] is None or name in named[folder]:
            kept.append(path)
    return kept
