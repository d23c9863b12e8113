"""Dumps of SQL statements: written a row a statement, and read by byte ranges whatever is quoted in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.sources.media import RangedFile, listed

#: Bytes of a range that a task reads, and of a block of it.
RANGE, BLOCK = 64 << 20, 1 << 20
NESTED = (T.StructType, T.ArrayType, T.MapType)
INSERT = re.compile(r"""\s*INSERT\s+INTO\s+(?:"((?:[^"]|"")+)"|`([^`]+)`|\[([^\]]+)\]|(\w+))\s*(?:\(([^)]*)\)\s*)?VALUES\s*""", re.I)
#: A value: a text with its quotes doubled, bytes as hex, a number or null.
VALUE = re.compile(r"""\s*(?:'((?:[^']|'')*+)'|[xX]'([0-9a-fA-F]*)'|([^\s,()';]+))\s*""")


def literal(column: Column, kind: T.DataType) -> Column:
    """A column as SQL text: texts and JSON in quotes that are doubled inside, numbers so that they are read back the same."""
    if isinstance(kind, NESTED):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, T.BooleanType):
        return F.coalesce(column.cast("int").cast("string"), F.lit("NULL"))
    elif isinstance(kind, T.BinaryType):
        return F.coalesce(F.concat(F.lit("X'"), F.hex(column), F.lit("'")), F.lit("NULL"))
    else:
        plain = column.cast("string")
        odd = plain.isin("NaN", "Infinity", "-Infinity") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
        return F.coalesce(F.when(odd, F.concat(F.lit("'"), plain, F.lit("'"))).otherwise(plain), F.lit("NULL"))
    return F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def statements(df: DataFrame, name: str) -> DataFrame:
    """A row of text for each row of a table: the statement that inserts it."""
    values = F.concat_ws(",", *[literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    return df.select(F.concat(F.lit(f'INSERT INTO "{name}" VALUES('), values, F.lit(");")).alias("value"))


def definition(name: str, schema: T.StructType) -> str:
    kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
    columns = ", ".join(f'"{f.name}" {kinds.get(type(f.dataType), "TEXT")}' for f in schema)
    return f'CREATE TABLE IF NOT EXISTS "{name}" ({columns});'


def write_statements(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """A folder for each table, of text files of statements; any engine that knows the schema can run them."""
    for name, df in tables.items():
        first = df.sparkSession.createDataFrame([(definition(name, df.schema),)], "value string").coalesce(1)
        first.write.mode("overwrite" if overwrite else "error").text(f"{path}/{name}.sql")
        statements(df, name).write.mode("append").text(f"{path}/{name}.sql")


def ranges(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(path, start, end, size) of the byte ranges of a file of statements, or of those of a folder."""
    size = size or RANGE
    files = [(p, s) for p, s in listed(path, "*", True) if not p.rsplit("/", 1)[-1].startswith(("_", "."))]
    rows = [(p, a, min(a + size, n), n) for p, n in files for a in range(0, n, size)]
    frame = spark.createDataFrame(rows, "path string, start long, end long, size long")
    return frame.repartition(max(min(len(rows), 10_000), 1))


def quote_counts(parts: DataFrame) -> DataFrame:
    """Ranges with ``inside``: whether they begin inside quotes. Each is counted by itself; the counts before it decide.

    A quote inside quotes is doubled, so it changes nothing. The window has a row a range of a file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for path, start, end in zip(batch.path, batch.start, batch.end, strict=True):
                with RangedFile(path) as file:
                    counts.append(sum(file.at(a, min(BLOCK, end - a)).count(b"'") for a in range(start, end, BLOCK)))
            yield batch.assign(quotes=counts)

    counted = parts.mapInPandas(run, "path string, start long, end long, size long, quotes long")
    before = F.sum("quotes").over(Window.partitionBy("path").orderBy("start")) - F.col("quotes")
    return counted.select("path", "start", "end", "size", (before % 2 == 1).alias("inside"))


def ends(data: bytes, inside: bool) -> tuple[list[int], bool]:
    """Places after the semicolons outside quotes, and whether the data end inside quotes."""
    found, at = [], 0
    for k, piece in enumerate(data.split(b"'")):
        if (k % 2 == 1) == inside:  # outside
            place = piece.find(b";")
            while place >= 0:
                found.append(at + place + 1)
                place = piece.find(b";", place + 1)
        at += len(piece) + 1
    return found, inside ^ (data.count(b"'") % 2 == 1)


def range_statements(path: str, start: int, end: int, inside: bool) -> Iterator[str]:
    """The statements that begin in a range; the last one may end in a later one.

    One begins at the start of the file and after each semicolon outside quotes. Nothing before the range is read.
    """
    with RangedFile(path) as file:
        at, begun, held = start, start == 0, b""
        if start and not inside and file.at(start - 1, 1) == b";":
            begun = True
        while at < file.size and (at < end or begun):
            block = file.at(at, BLOCK)
            places, after = ends(block, inside)
            last = 0
            for place in places:
                if begun:
                    yield (held + block[last:place]).decode("utf-8", "replace")
                held, last, begun = b"", place, at + place < end
            if begun:
                held += block[last:]
            at, inside = at + len(block), after
        if begun and held.strip():
            yield held.decode("utf-8", "replace")


def parsed(statement: str) -> Iterator[tuple[str, list[str] | None, list[str | None]]]:
    """(table, columns if they are named, values as text) of the rows of an insert; nothing of other statements."""
    head = INSERT.match(statement)
    if not head:
        return
    name = next(g for g in head.groups()[:4] if g is not None).replace('""', '"')
    columns = [c.strip().strip('"`[]') for c in head[5].split(",")] if head[5] else None
    at = head.end()
    while at < len(statement) and statement[at] == "(":
        values: list[str | None] = []
        at += 1
        while True:
            m = VALUE.match(statement, at)
            if not m:
                raise ValueError(f"no value at {at} of {statement[:80]}")
            text, blob, plain = m.groups()
            values.append(text.replace("''", "'") if text is not None else bytes.fromhex(blob).decode("latin-1") if blob is not None else None if plain.upper() == "NULL" else plain)
            at = m.end()
            if statement[at : at + 1] != ",":
                break
            at += 1
        if statement[at : at + 1] != ")":
            raise ValueError(f"a row isn't closed at {at} of {statement[:80]}")
        yield name, columns, values
        rest = re.compile(r"\s*,?\s*").match(statement, at + 1)
        at = rest.end()


def read_rows(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(name, columns, values) of every row that the statements of a file or folder insert."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out: list[Any] = []
                for statement in range_statements(row.path, row.start, row.end, bool(row.inside)):
                    out += parsed(statement)
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=["name", "columns", "values"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["name", "columns", "values"])

    return quote_counts(ranges(spark, path, size)).mapInPandas(run, "name string, columns array<string>, values array<string>")


def typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, NESTED):
        return F.from_json(text, kind)
    if isinstance(kind, T.BinaryType):
        return F.encode(text, "ISO-8859-1")
    return text.cast(kind) if not isinstance(kind, T.StringType) else text


def read_statements(spark: SparkSession, path: str, schemas: dict[str, T.StructType], size: int | None = None) -> dict[str, DataFrame]:
    """Tables of a dump by name; values are taken by place, or by column where an insert names them.

    The dump of each table is read for that table only if it has a folder of its own; else the one file is read for each.
    """
    out = {}
    single = not any(f"/{n}.sql/" in p for n in schemas for p, _ in listed(path, "*", True))
    for name, schema in schemas.items():
        rows = read_rows(spark, path if single else f"{path}/{name}.sql", size).where(F.col("name") == name)
        have = F.coalesce("columns", F.array(*[F.lit(f.name) for f in schema]))
        text = lambda f: F.get("values", F.array_position(have, f.name).cast("int") - 1)  # noqa: B023, E731
        out[name] = rows.select(*[typed(F.when(F.array_position(have, f.name) > 0, text(f)), f.dataType).alias(f.name) for f in schema])
    return out

