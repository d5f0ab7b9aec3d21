"""Binary tables of FITS files as a Spark data source.

    spark.dataSource.register(FitsTable)
    spark.read.format("fits_table").option("hdu", "RATE").load(folder)

A file is a chain of header and data units (HDU). Headers are blocks of 80-character cards, a binary table has
rows of fixed width whose columns its cards describe. A partition is a range of rows of one file,
so a large file is read by many tasks; only the columns of the schema are decoded (give a schema to
read fewer). Files are opened through ``pyarrow.fs``, local or remote, and only needed bytes are read. The
schema comes from the first file; a later file is read by column name, a column it lacks is NULL.
"""

from __future__ import annotations

import fnmatch
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.expr import no_nan

BLOCK, CARD = 2880, 80
#: Bytes of rows that one partition reads.
PART_BYTES = 64 << 20
#: Column codes: numpy type (big-endian) and Spark type. A is text, L is T or F.
KINDS = {"B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "double"), "D": (">f8", "double")}


def _cards(block: bytes) -> dict:
    out = {}
    for i in range(0, len(block), CARD):
        card = block[i : i + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if card[8:10] != "= ":
            if key == "END":
                out["END"] = True
                break
            continue
        text = card[10:].strip()
        quoted = re.match(r"'((?:[^']|'')*)'", text)
        if quoted:
            out[key] = quoted[1].replace("''", "'").rstrip()
            continue
        word = text.split("/")[0].strip()
        if word in ("T", "F"):
            out[key] = word == "T"
        elif re.fullmatch(r"[+-]?\d+", word):
            out[key] = int(word)
        elif word:
            out[key] = float(word.replace("D", "E"))
    return out


def _header(f, at: int, size: int) -> tuple[dict, int]:
    """Cards of the header at a position and where its data begin."""
    cards: dict = {}
    while at + BLOCK <= size:
        f.seek(at)
        cards |= {k: v for k, v in _cards(f.read(BLOCK)).items() if k not in cards}
        at += BLOCK
        if "END" in cards:
            return cards, at
    raise ValueError(f"no end of header before byte {size}")


def find_table(f, size: int, hdu: str | None) -> tuple[dict, int]:
    """Cards and data start of a binary table: the first one, or the one of a name or number (0: primary)."""
    at, number, seen = 0, 0, []
    while at < size:
        cards, data = _header(f, at, size)
        table = cards.get("XTENSION", "").strip() == "BINTABLE"
        name = str(cards.get("EXTNAME", ""))
        seen.append(name or str(number))
        if table and (hdu is None or hdu.upper() in (name.upper(), str(number))):
            return cards, data
        axes = [cards.get(f"NAXIS{i + 1}", 0) for i in range(cards.get("NAXIS", 0))]
        n = abs(cards.get("BITPIX", 8)) // 8 * cards.get("GCOUNT", 1) * (cards.get("PCOUNT", 0) + int(np.prod(axes, dtype=np.int64))) if axes else 0
        at, number = data + -(-n // BLOCK) * BLOCK, number + 1
    raise ValueError(f"no binary table {hdu or ''} among {seen}")


class Column:
    """One column of a table: where it stands in a row, and how to read it."""

    def __init__(self, cards: dict, i: int, start: int):
        form = re.fullmatch(r"\s*(\d*)([A-Z])(.*)", str(cards[f"TFORM{i}"]))
        self.name = str(cards.get(f"TTYPE{i}", f"col{i}")).strip()
        self.count, self.code, self.start = int(form[1] or 1), form[2], start
        self.scale, self.zero, self.null = cards.get(f"TSCAL{i}", 1), cards.get(f"TZERO{i}", 0), cards.get(f"TNULL{i}")
        width = {"L": 1, "X": 0, "A": 1, "C": 8, "M": 16, "P": 8, "Q": 16}.get(self.code)
        width = np.dtype(KINDS[self.code][0]).itemsize if width is None else width
        self.width = (self.count + 7) // 8 if self.code == "X" else self.count * width

    def spark_type(self) -> str | None:
        """NULL for columns that are not read: bits, complex numbers, variable arrays, empty columns."""
        if self.code == "A":
            return "string"
        if self.count == 0 or self.code not in "L" + "".join(KINDS):
            return None
        one = "boolean" if self.code == "L" else "double" if (self.scale, self.zero) != (1, 0) else KINDS[self.code][1]
        return one if self.count == 1 else f"array<{one}>"

    def read(self, rows: np.ndarray) -> pa.Array:
        """``rows``: one row of bytes for each table row."""
        raw = np.ascontiguousarray(rows[:, self.start : self.start + self.width])
        n = len(raw)
        if self.code == "A":
            return pa.array([bytes(r).split(b"\0")[0].decode("utf-8", "replace").rstrip() for r in raw], pa.string())
        if self.code == "L":
            flat = pa.array(raw.ravel() == ord("T"), mask=~np.isin(raw.ravel(), [ord("T"), ord("F")]))
        else:
            values = raw.view(KINDS[self.code][0]).ravel()
            mask = values == self.null if self.null is not None and self.code in "BIJK" else None
            values = values.astype(values.dtype.newbyteorder("="))
            if (self.scale, self.zero) != (1, 0):
                values = values * float(self.scale) + float(self.zero)
            elif self.code == "B":
                values = values.astype(np.int16)
            elif self.code == "E":
                values = values.astype(np.float64)
            flat = pa.array(values, mask=mask)
        return flat if self.count == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.count, pa.int32()), flat)


def columns_of(cards: dict) -> list[Column]:
    out, start = [], 0
    for i in range(1, cards["TFIELDS"] + 1):
        out.append(Column(cards, i, start))
        start += out[-1].width
    return out


def _files(path: str, glob: str | None) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder, by path."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(where, recursive=True))
    found = [i for i in found if i.is_file and not i.base_name.startswith((".", "_"))]
    return sorted((i.path, i.size) for i in found if glob is None or fnmatch.fnmatch(i.base_name, glob))


def _open(path: str, base: str):
    from pyarrow import fs

    system = fs.FileSystem.from_uri(base)[0] if "://" in base or base.startswith("file:") else fs.LocalFileSystem()
    return system.open_input_file(path)


class RowRange(InputPartition):
    def __init__(self, path: str, size: int, part: int, parts: int):
        self.path, self.size, self.part, self.parts = path, size, part, parts


class FitsTable(DataSource):
    """Options: ``hdu`` (name or number of the table, else the first), ``pathGlobFilter``, ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> str:
        path, size = self._files()[0]
        with _open(path, self.options["path"]) as f:
            cards, _ = find_table(f, size, self.options.get("hdu"))
        kept = [(c.name, c.spark_type()) for c in columns_of(cards)]
        return ", ".join([*[f"`{n}` {t}" for n, t in kept if t], "`_file` string"])

    def _files(self):
        found = _files(self.options["path"], self.options.get("pathGlobFilter"))
        if not found:
            raise FileNotFoundError(f"no files in {self.options['path']}")
        return found

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, self._files(), {k.lower(): v for k, v in self.options.items()})


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[tuple[str, int]], options: dict):
        self.wanted, self.files, self.options = schema, files, options

    def partitions(self) -> list[RowRange]:
        each = int(self.options.get("partbytes", PART_BYTES))
        return [RowRange(p, size, i, n) for p, size in self.files for n in [-(-size // each)] for i in range(n)]

    def read(self, partition: RowRange):
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.wanted)
        with _open(partition.path, self.options["path"]) as f:
            cards, data = find_table(f, partition.size, self.options.get("hdu"))
            found = {c.name.lower(): c for c in columns_of(cards)}
            width, rows = cards["NAXIS1"], cards["NAXIS2"]
            first, end = rows * partition.part // partition.parts, rows * (partition.part + 1) // partition.parts
            step = max(1, (8 << 20) // max(width, 1))
            for at in range(first, end, step):
                n = min(step, end - at)
                f.seek(data + at * width)
                block = np.frombuffer(f.read(n * width), np.uint8).reshape(n, width)
                arrays = []
                for field in want:
                    if field.name == "_file":
                        arrays.append(pa.array([partition.path] * n, pa.string()))
                    elif field.name.lower() in found:
                        arrays.append(found[field.name.lower()].read(block).cast(field.type))
                    else:
                        arrays.append(pa.nulls(n, field.type))
                yield pa.record_batch(arrays, schema=want)


def read_fits(spark: SparkSession, path: str, hdu: str | None = None, glob: str | None = None, schema: str | StructType | None = None) -> DataFrame:
    """Binary tables of a file or folder, and ``_file``; with a schema, only its columns."""
    spark.dataSource.register(FitsTable)
    reader = spark.read.format("fits_table")
    for name, value in (("hdu", hdu), ("pathGlobFilter", glob)):
        if value is not None:
            reader = reader.option(name, value)
    return (reader.schema(schema) if schema else reader).load(path)


def load_fits_curves(spark: SparkSession, path: str, start: float | None = None, hdu: str | None = None, glob: str | None = None) -> DataFrame:
    """Curves with upper-case columns, TIME renamed MJD unless there is one, from ``start`` on; NaN as NULL."""
    df = read_fits(spark, path, hdu, glob)
    upper = {c: c.upper() if c != "_file" else c for c in df.columns}
    if "MJD" not in upper.values():
        upper = {c: "MJD" if u == "TIME" else u for c, u in upper.items()}
    kinds = dict(df.dtypes)
    df = df.select(*[(no_nan(F.col(f"`{c}`")) if kinds[c] == "double" else F.col(f"`{c}`")).alias(u) for c, u in upper.items()])
    if "MJD" not in df.columns:
        raise ValueError(f"no time column among {df.columns}")
    return df.where(F.col("MJD") >= start) if start is not None else df
