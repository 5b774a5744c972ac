"""Row formats and writers: CSV dialects, JSON lines, reports, reader lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.scalar import SCALE, iso_ms


def cell(field: T.StructField, booleans: str = "true false") -> Column:
    """A value as text: null empty, booleans by name, binary as lower-case hex."""
    c, (yes, no) = F.col(f"`{field.name}`"), booleans.split()
    if isinstance(field.dataType, T.BooleanType):
        c = F.when(c, yes).when(~c, no)
    elif isinstance(field.dataType, T.BinaryType):
        c = F.lower(F.hex(c))
    return F.coalesce(c.cast("string"), F.lit(""))


def quoted(text: Column) -> Column:
    """Quoted where it has a comma, a quote or a line end; quotes are doubled."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, sep: str = ",", booleans: str = "true false", quote: bool = True) -> DataFrame:
    cells = (cell(f, booleans) for f in df.schema.fields)
    return df.select(F.concat_ws(sep, *(quoted(c) if quote else c for c in cells)).alias("value"))


def semicolon_lines(df: DataFrame) -> DataFrame:
    return csv_lines(df, ";", "True False", quote=False)


def write_csv(df: DataFrame, path: str, sep: str = ",", codec: str = "none") -> None:
    df.write.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').option("nullValue", "").option("compression", codec).csv(path)


def write_anomalies(audit: DataFrame, path: str, everything: bool = False) -> None:
    """A JSON object a line for each audited file with anomalies, or each."""
    (audit if everything else audit.where(F.size("anomalies") > 0)).write.json(path)


def json_lines(audit: DataFrame, everything: bool = False) -> DataFrame:
    rows = audit if everything else audit.where(F.size("anomalies") > 0)
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def report_lines(audit: DataFrame, title: str) -> DataFrame:
    """Lines of name and value, one block a row."""
    rows = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in audit.columns]
    return audit.select(F.concat_ws("\n", F.lit(title), *rows).alias("value"))


def reader_line(columns: list[Column], sep: str = ";") -> Column:
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def shown_time(ns: Column, raw: bool = False) -> Column:
    return ns.cast("string") if raw else iso_ms(ns)


def levels(side: Column, places: int = 8) -> Column:
    """px(qty),px(qty) of an array of levels in fixed point."""
    return F.array_join(F.transform(side, lambda x: F.format_string(f"%.{places}f(%.{places}f)", x["px"] / SCALE, x["qty"] / SCALE)), ",")


def with_total(result: DataFrame, total: DataFrame, order: str) -> DataFrame:
    """result with a total row of the same columns before it."""
    rows = total.withColumn("line", F.lit(0)).unionByName(result.withColumn("line", F.lit(1)))
    return rows.orderBy("line", F.col(order).desc()).drop("line")


def order_line(*columns: str) -> Column:
    return F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def write_models(models: DataFrame, path: str) -> None:
    """A folder of CSV for each half-life."""
    models.write.partitionBy("hl").option("header", "true").csv(path)


def zstd_frames(lines: DataFrame, level: int = 3) -> DataFrame:
    """(frame): lines(value) as zstd frames, each a batch's lines; frames one after another are a zstd file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            if batch.num_rows:
                text = "".join(f"{x or ''}\n" for x in batch.column(0).to_pylist())
                yield pa.record_batch([pa.array([packer.compress(text.encode())], pa.binary())], ["frame"])

    return lines.select("value").mapInArrow(run, "frame binary")
