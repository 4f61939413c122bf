"""Delivered text lines: parse the valid ones, part the others with the reason.

Every input row is one record. A record is assembled quote-aware (blanks around quoted
fields go, quotes inside unquoted fields are structural errors), parsed with Python's strict
``csv`` reader inside the partition, and only then given to the typed field constructors.

Defined cases: a null line is an empty line (``columns``); a file without a header line, or
whose header shows neither separator, is comma-separated; lines of an unknown (null) file are
comma-separated too; repeated lines are repeated in the result; an empty table gives none.
"""

from __future__ import annotations

import csv
import datetime
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A few copies of each file's header, so that the lines of one huge file spread over tasks.
SALTS = 8

FIELDS = ("date", "driver_unique_name", "driver_classification", "driver_value", "denorm")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\ufffd]")

PARSED = "reason string, date date, driver_unique_name string, driver_classification string, driver_value double, denorm double"


class Rejected(ValueError):
    """A field constructor's refusal; ``reason`` is what the result shows."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    s = re.escape(sep)
    return re.compile(rf' *+("(?:[^"]|"")*+") *+(?={s}|\Z)'), re.compile(rf"[^{s}]*+")


_BY_SEP = {s: _patterns(s) for s in ",;"}


def assemble(line: str, sep: str) -> str:
    """One record with blanks around its quoted fields removed; raises csv.Error on broken quoting."""
    if '"' not in line:
        return line
    quoted, bare = _BY_SEP[sep]
    out, at = [], 0
    while True:
        m = quoted.match(line, at)
        if m:
            out.append(m.group(1))
        else:
            m = bare.match(line, at)
            field = m.group()
            if '"' in field:
                if field.lstrip(" ").startswith('"'):
                    next(csv.reader([line[at:].lstrip(" ")], delimiter=sep, strict=True))
                raise csv.Error("quote inside an unquoted field")
            out.append(field)
        at = m.end()
        if at >= len(line):
            return sep.join(out)
        at += 1  # the separator; a line that ends with one has a last empty field
        if at == len(line):
            return sep.join([*out, ""])


def split_record(line: str | None, sep: str) -> list[str]:
    """The fields of a record. Raises csv.Error where its quoting is broken."""
    line = line or ""
    if line.endswith("\r"):
        line = line[:-1]
    ready = assemble(line, sep)
    # line breaks inside a record belong to a field here; the reader takes each row as one record
    hidden, breaks = ready, {}
    if "\n" in ready or "\r" in ready:
        used = set(ready)
        free = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)
        breaks = {c: next(free) for c in "\r\n"}
        hidden = ready.translate(str.maketrans(breaks))
    fields = next(csv.reader([hidden], delimiter=sep, strict=True), [])
    if '"' not in line:
        fields = [f.strip(" ") for f in fields]
    else:
        quoted = _BY_SEP[sep][0]
        at, stripped = 0, []
        for f in fields:
            m = quoted.match(line, at)
            stripped.append(f if m else f.strip(" "))
            at = (m or _BY_SEP[sep][1].match(line, at)).end() + 1
        fields = stripped
    if breaks:
        back = str.maketrans({v: k for k, v in breaks.items()})
        fields = [f.translate(back) for f in fields]
    return fields


def make_name(text: str) -> str:
    if not text.strip() or CONTROL.search(text):
        raise Rejected("name")
    return text


def make_date(text: str) -> datetime.date:
    if not DAY.fullmatch(text):
        raise Rejected("date")
    try:
        return datetime.date(int(text[:4]), int(text[5:7]), int(text[8:]))
    except ValueError:
        raise Rejected("date") from None


def make_number(text: str) -> float | None:
    if text == "":
        return None
    if not NUMBER.fullmatch(text):
        raise Rejected("value")
    return float(text)


def parse(line: str | None, sep: str) -> tuple:
    """(reason, date, name, classification, value, denorm); reason is None for a valid line."""
    try:
        fields = split_record(line, sep)
    except csv.Error:
        return ("quoting", None, None, None, None, None)
    if len(fields) != len(FIELDS):
        return ("columns", None, None, None, None, None)
    day, name, kind, value, denorm = fields
    try:
        made_name = make_name(name)
        return (None, make_date(day), made_name, kind or None, make_number(value), make_number(denorm))
    except Rejected as e:
        return (e.reason, None, None, None, None, None)


def _parse_batches(batches: Iterator[pa.RecordBatch], keep: list[str], line_col: str, sep_col: str) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    types = (pa.string(), pa.date32(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for b in batches:
        seps = b.column(sep_col).to_pylist()
        rows = [parse(x, s) for x, s in zip(b.column(line_col).to_pylist(), seps)]
        columns = list(zip(*rows)) if rows else [()] * len(types)
        arrays = [b.column(k) for k in keep] + [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f"p_{i}" for i in range(len(types)))])


def parse_lines(lines: DataFrame, keys: list[str], *, file: str = "file_name", line_no: str = "line_no", line: str = "raw_line") -> DataFrame:
    """All lines but headers, with ``reason`` and the typed fields.

    ``keys`` (for instance ``["line_id"]``) are kept. The separators are few (one per file), so
    the join is cheap; its hot files are salted, and AQE makes it a broadcast where the measured
    size of the separators' side allows.
    """
    size = lambda c: F.length(line) - F.length(F.replace(F.col(line), F.lit(c), F.lit("")))
    headers = (
        lines.where(F.col(line_no) == 1)
        .groupBy(F.col(file).alias("_file"))
        .agg(F.max(F.when(size(";") > size(","), ";").otherwise(",")).alias("_sep"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    body = lines.where((F.col(line_no) != 1) | F.col(line_no).isNull()).select(
        *[F.col(k) for k in keys], F.col(file).alias("_f"), F.col(line).alias("_line"), F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("_s")
    )
    joined = body.join(headers, (F.col("_f") == F.col("_file")) & (F.col("_s") == F.col("_salt")), "left").select(
        *keys, "_line", F.coalesce("_sep", F.lit(",")).alias("_sep")
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keys).schema)
    schema = kept + ", " + PARSED
    return joined.mapInArrow(lambda it: _renamed(_parse_batches(it, keys, "_line", "_sep")), schema)


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["reason", *FIELDS]
    for b in batches:
        n = b.num_columns - len(names)
        yield pa.RecordBatch.from_arrays(b.columns, names=[*b.schema.names[:n], *names])


def rejected(lines: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    return parse_lines(lines, keys, **columns).where(F.col("reason").isNotNull()).select(*keys, "reason")


def accepted(lines: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    return parse_lines(lines, keys, **columns).where(F.col("reason").isNull()).drop("reason")
