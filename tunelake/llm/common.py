"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes that lower-case A-Z and leave every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words between ASCII white space, as a Java regular expression for the separators.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on one machine, a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="tunelake-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage is cut and the rows are in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: for wide rows, of which readers need a few columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def with_crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], fields: list[tuple[str, str]], text: str = "text", keep: list[str] | None = None, rows: int = 512, where: str | None = None) -> DataFrame:
    """Add columns computed from whole texts, a slice of Arrow rows at a time.

    make() runs once a task and returns a function from a list of UTF-8 byte strings (None for null) to
    {column: list or Arrow array}.  keep: the input columns to keep, all by default; a new column replaces an
    input column of the same name.  where: a computed boolean column that rows must have set; it isn't returned.
    """
    new = {name.lower() for name, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    out = [(n, t) for n, t in fields if n != where]
    kept = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(keep, source.schema.fields, strict=False)]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in out)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, fn = to_arrow_schema(schema), make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                column = part.column(part.num_columns - 1)
                got = fn(column.cast(pa.large_binary()).to_pylist())
                columns = [*part.columns[:-1], *[got[n] for n, _ in out]]
                columns = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)]
                made = pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in wanted]))
                if where:
                    made = made.filter(pa.array(got[where], pa.bool_()))
                yield made

    return source.mapInArrow(run, schema)
