"""Files of whatever file system Spark reads: which exist, what a folder has, what Parquet footers say."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Footers that are read at a time.
AT_ONCE = 32


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder has; none if it doesn't exist."""
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only in local mode without it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tickspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables written so far.
_TABLES: list[str] = []


def tables() -> list[str]:
    """Folders of the tables that written() made and nothing dropped, in order."""
    return list(_TABLES)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such tables, on which no result may depend any more."""
    for path in paths:
        removed(spark, path)
        _TABLES.remove(path)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its folder: lineage ends there, lost executors cost nothing done so far."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def written_dealt(df: DataFrame, name: str, by: str, parts: int) -> DataFrame:
    """df as such a table in parts by the hash of by: joins and aggregations by it, in as many partitions, don't shuffle df."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    entry = path.rpartition("/")[2].replace("-", "_")
    dealt = df.repartition(parts, by).write.bucketBy(parts, by).format("parquet").option("compression", "zstd")
    dealt.option("path", path).saveAsTable(entry)
    _TABLES.append(path)
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # only the catalog's entry: the table is where path says
    return table


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames within a file system; the folders of target are made, and an existing target is an error."""
    p, fs = _path(spark, source)
    t, _ = _path(spark, target)
    fs.mkdirs(t.getParent())
    if fs.exists(t) or not fs.rename(p, t):
        raise FileExistsError(f"{source} can't become {target}")


def removed(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p)
    out.write(data)
    out.close()


def write_file(df: DataFrame, path: str) -> None:
    """df, which one task can hold, as a single Parquet file of that name."""
    spark, folder = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(folder)
    part = next(n for n in entries(spark, folder) if n.endswith(".parquet"))
    moved(spark, f"{folder}/{part}", path)
    removed(spark, folder)


def written_days(rows: DataFrame, root: str, kind: str, symbol: str, months: bool = False) -> str:
    """Writes rows(market, ts, ...), a file of the store for each market and UTC day, or month of sampled tops; gives root.

    One write deals the rows to their days, whose folders then get their names; the tasks are as many as days.
    """
    from tickspark.sources.ticks import day_file, month_file

    spark, made = rows.sparkSession, f"{root}/new-{uuid.uuid4().hex}"
    at = F.timestamp_micros(F.expr("ts div 1000"))
    parts = {"__y": F.year(at), "__m": F.month(at)} | ({} if months else {"__d": F.dayofmonth(at)})
    dated = rows.withColumns(parts)
    dated.repartition("market", *parts).sortWithinPartitions("ts").write.partitionBy("market", *parts).parquet(made)

    def below(path: str, name: str) -> list[tuple[str, str]]:
        return [(f"{path}/{n}", n.partition("=")[2]) for n in entries(spark, path) if n.startswith(f"{name}=")]

    for of_market, market in below(made, "market"):
        for of_year, y in below(of_market, "__y"):
            for of_month, m in below(of_year, "__m"):
                if months:
                    moved(spark, of_month, month_file(root, symbol, market, int(y), int(m)))
                    continue
                for of_day, d in below(of_month, "__d"):
                    moved(spark, of_day, day_file(root, kind, symbol, market, datetime(int(y), int(m), int(d), tzinfo=UTC)))
    removed(spark, made)
    return root


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, meta_rows, row_groups, open_failed) of files' footers, by Spark's own reader on any file system it knows.

    A footer is a few kilobytes and its figures are one row: the driver reads some at a time. A folder that Spark wrote
    counts with all its part files. What can't be read has nulls and open_failed.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def parts(path: str) -> list:
        p, fs = _path(spark, path)
        if not fs.getFileStatus(p).isDirectory():
            return [p]
        return [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]

    def read(path: str) -> tuple:
        rows = groups = 0
        try:
            for part in parts(path):
                file = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(part, conf))
                try:
                    rows, groups = rows + file.getRecordCount(), groups + file.getRowGroups().size()
                finally:
                    file.close()
        except Exception:  # any fault of the file is the finding
            return path, None, None, True
        return path, rows, groups, False

    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = list(pool.map(read, paths))
    return spark.createDataFrame(found, "file string, meta_rows long, row_groups long, open_failed boolean")
