"""Listing and reading directory trees, dot files included.

Spark's own file sources leave out names that start with a dot, which is where
``.env`` and most credential files live. Directories are listed level by level
in tasks, so a tree of any size never passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.sources.workspace import materialise

_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_ROWS = 10_000  # of a listing
GROUP_BYTES = 64 * 1024 * 1024  # of files that one task reads, about


def list_tree(spark: SparkSession, root: str, max_depth: int | None = None, skip: tuple[str, ...] = (".git",)) -> DataFrame:
    """``path, length`` of every regular file below ``root``.

    Directories named in ``skip`` (any case) and those deeper than
    ``max_depth`` are never opened. Symbolic links are not followed. A root
    that is missing, unreadable or not a directory raises: it must not look
    like a clean one. A directory that goes away while the tree is walked is
    left out.
    """
    skipped = frozenset(skip)
    root = resolve_root(spark, root)

    def entries(batches: Iterator) -> Iterator:
        import os

        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        base, local = base.rstrip("/"), isinstance(system, fs.LocalFileSystem)
        as_table = lambda rows: pd.DataFrame(rows, columns=["path", "length", "is_dir"]).astype({"length": "Int64", "is_dir": bool})
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=bool(folder))):
                    is_dir = info.type == fs.FileType.Directory
                    if local and os.path.islink(info.path) or not (is_dir or info.type == fs.FileType.File):
                        continue
                    if not (is_dir and info.base_name.lower() in skipped):
                        name = f"{folder}/{info.base_name}" if folder else info.base_name
                        rows.append((name, None if is_dir else info.size, is_dir))
                if len(rows) >= _BATCH_ROWS:
                    yield as_table(rows)
                    rows = []
            yield as_table(rows)

    level, depth, found = spark.createDataFrame([("",)], "path string"), 0, []
    while True:
        listed = materialise(level.mapInPandas(entries, "path string, length long, is_dir boolean"), "listing")
        found.append(listed.where(~F.col("is_dir")).select("path", "length"))
        level = listed.where("is_dir").select("path")
        if depth == max_depth or level.isEmpty():
            break
        # So many tasks as there are cores for small rows too: what costs time is opening folders.
        level, depth = level.repartition(4 * spark.sparkContext.defaultParallelism, "path"), depth + 1
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files


def write_tree(rows: DataFrame, root: str) -> None:
    """Write ``rows(folder, line)`` as text files below ``root``: each task one file for each folder of which it has lines.

    Written in place by the tasks, as ``read_contents`` reads: no file is moved
    or listed by the driver. A task that is run again writes the same files. A
    null line is an empty one.
    """
    spark = rows.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(top)
    root = resolve_root(spark, root)

    def write(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        base, name, out, n = base.rstrip("/"), None, None, 0
        for batch in batches:
            for folder, line, task in zip(batch["folder"], batch["line"], batch["_task"], strict=True):
                if folder != name:
                    if out:
                        out.close()
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    name, out, n = folder, system.open_output_stream(f"{base}/{folder}/part-{task:05d}.txt"), n + 1
                out.write((line or "").encode() + b"\n")
        if out:
            out.close()
        yield pd.DataFrame({"files": [n]})

    sorted_rows = rows.select("folder", "line").sortWithinPartitions("folder").withColumn("_task", F.spark_partition_id())
    sorted_rows.mapInPandas(write, "files long").write.format("noop").mode("overwrite").save()


def resolve_root(spark: SparkSession, root: str) -> str:
    """``root`` as a full address, as Spark resolves a path: without a scheme it is in the default file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def balanced_by_bytes(files: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``files(path, length)`` dealt out so that tasks read about equally many bytes.

    A file's place in the running total of its listing split decides its group,
    and groups are dealt out one by one, so neither the number of listing
    tasks nor a folder of large files decides how many tasks read.
    """
    rows = files.withColumn("_split", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id())
    running = Window.partitionBy("_split").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(running), F.lit(0))
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // group_bytes))
    grouped = rows.withColumn("_group", F.floor(before / group_bytes))
    return grouped.repartition(tasks, "_split", "_group").drop("_split", "_nth", "_group")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` with a binary ``content`` column, read in tasks; null if a file is gone."""
    root = resolve_root(files.sparkSession, root)

    def read(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        base = base.rstrip("/")
        for batch in batches:
            rows, size = [], 0
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        content = stream.read()
                except FileNotFoundError:
                    content = None
                rows.append((path, length, content))
                size += len(content or b"")
                if size > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "length", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return balanced_by_bytes(files.select("path", "length")).mapInPandas(read, "path string, length long, content binary")
