"""Files of any store that Spark reads, by its own file system interface."""

from __future__ import annotations

import re
import uuid
from fnmatch import fnmatch
from glob import escape as glob_escape
from glob import glob

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, sorted; for local files without the scheme."""
    path, store = _path(spark, pattern)
    found = store.globStatus(path) or []
    return sorted(str(f.getPath().toString()).removeprefix("file:") for f in found)


def opened(path: str):
    """A file to read bytes of at any place, in a worker: of a mounted file system or, if the
    path has another scheme, of a store that pyarrow knows (hdfs, s3, gs)."""
    if path.startswith("file:") or "://" not in path:
        return open(re.sub("^file:(//)?", "", path), "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, 2)


def bytes_of(spark: SparkSession, path: str) -> int:
    """The size of a file of any store that Spark reads."""
    path, store = _path(spark, path)
    return store.getFileStatus(path).getLen()


def sized(df: DataFrame, each: int = 8 << 20) -> int:
    """So many tasks that each has about `each` bytes of the files that the frame is made from."""
    spark = df.sparkSession
    whole = sum(bytes_of(spark, p) for p in df.inputFiles())
    return max(1, -(-whole // each))


def spread(df: DataFrame, *keys: str, each: int = 2 << 20) -> DataFrame:
    """The frame by `keys`, in so many partitions that what a task holds doesn't grow with the
    input; as it is, where a shuffle has as many anyway."""
    tasks = sized(df, each)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def listed(folder: str, pattern: str) -> list[str]:
    """The files of a folder whose names match, sorted, in a worker."""
    if folder.startswith("file:") or "://" not in folder:
        return sorted(glob(f"{glob_escape(re.sub('^file:(//)?', '', folder))}/{pattern}"))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f"{scheme}://{f.path}" for f in found if f.is_file and fnmatch(f.base_name, pattern))


def gather(spark: SparkSession, source: str, folder: str, name) -> list[str]:
    """Moves the part files of source/key=value/... to one folder; name(value, k) names the k-th one of
    a value. A driver's step for each file, of which no byte is read."""
    made, store = [], _path(spark, folder)[1]
    store.mkdirs(_path(spark, folder)[0])
    for k, path in enumerate(matching(spark, f"{source}/*/part-*")):
        value = path.split("/")[-2].split("=", 1)[1]
        made.append(f"{folder}/{name(value, k)}")
        if not store.rename(_path(spark, path)[0], _path(spark, made[-1])[0]):
            raise OSError(f"can't move {path}")
    store.delete(_path(spark, source)[0], True)
    return made


def write_single(lines: DataFrame, folder: str, name: str, codec: str = "none") -> str:
    """Text lines (value), few enough for one file, as folder/name, in order of `ord` if they
    have it; gives the path."""
    if "ord" in lines.columns:
        lines = lines.repartition(1).sortWithinPartitions("ord")
    spark, part = lines.sparkSession, f"{folder}/.part-{uuid.uuid4().hex}"
    lines.select("value").coalesce(1).write.option("compression", codec).text(part)
    (made,) = matching(spark, f"{part}/part-*")
    target, store = _path(spark, f"{folder}/{name}")
    store.mkdirs(target.getParent())
    if not store.rename(_path(spark, made)[0], target):
        raise OSError(f"can't move {made} to {folder}/{name}")
    store.delete(_path(spark, part)[0], True)
    return f"{folder}/{name}"
