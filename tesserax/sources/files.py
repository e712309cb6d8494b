"""Files that tasks read and write themselves: paths made whole on the driver, ranges of bytes, listings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Schemes that Arrow knows by another name.
ALIASES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Spark itself would give it: a path without a scheme is on the default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def store(path: str):
    """(Arrow file system, path in it) of a qualified path; any task can call it. A path without a scheme is refused, as it would
    mean another disk on each executor."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon:
        raise ValueError(f"qualify the path first: {path}")
    return fs.FileSystem.from_uri(ALIASES.get(scheme, scheme) + ":" + rest)


def folder(path: str):
    """store(path), made if it is not there."""
    where, inner = store(path)
    where.create_dir(inner, recursive=True)
    return where, inner


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path in its store, bytes) of the files with an ending in a folder, by name; or the one file itself."""
    from pyarrow import fs

    where, inner = store(path)
    if inner.endswith(ending):
        return [(inner, where.get_file_info(inner).size)]
    found = where.get_file_info(fs.FileSelector(inner))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(ending))


def whole(path: str, inner: str) -> bytes:
    where, _ = store(path)
    with where.open_input_stream(inner) as f:
        return f.read()
