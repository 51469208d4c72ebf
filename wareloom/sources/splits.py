"""Text formats whose records may cross lines and file splits, read by one task per split.

What a split means depends on the state the reader is in where it begins: inside a quoted field (delimited text), inside a string
and how deep in brackets (JSON). A first pass works out, for every split, what it does to each state it could begin in; these
effects are put together along each file (one small row per split); a second pass reads every split from its true state. Records
that lie in one split are made there; only the pieces at split borders are brought together afterwards.

Rows of a split come in file order and tasks stream, so a task holds one record and one batch."""

from __future__ import annotations

import csv
import re
import sys
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = [("file", pa.string()), ("block", pa.int64())]


def split_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text rows with the file and the place in it where their split begins."""
    r = spark.read
    for k, v in options.items():
        r = r.option(k, v)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches):
    """(file, block, values) for the stretches of rows of one split, in order."""
    for b in batches:
        files, blocks, values = b.column("file"), b.column("block").to_numpy(), b.column("value")
        start = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or blocks[i] != blocks[start] or files[i] != files[start]:
                yield files[start].as_py(), int(blocks[start]), values.slice(start, i - start)
                start = i


def _batch(rows, schema):
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# ------------------------------------------------------------------ delimited text

def _closing(quote: str) -> re.Pattern:
    q = re.escape(quote)
    return re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}(?!{q})")


def ends_inside(line: str, inside: bool, sep: str, quote: str, closing: re.Pattern) -> bool:
    """Whether a line leaves the reader inside a quoted field, given whether it begins inside one. A quote opens a field only at
    the field's start; a doubled quote is a quote."""
    at = 0
    if inside:
        m = closing.match(line)
        if not m:
            return True
        at = line.find(sep, m.end())
        if at < 0:
            return False
        at += len(sep)
    while True:
        if line.startswith(quote, at):
            m = closing.match(line, at + 1)
            if not m:
                return True
            at = line.find(sep, m.end())
        else:
            at = line.find(sep + quote, at)
        if at < 0:
            return False
        at += len(sep)


_EFFECT = pa.schema([*_SPLIT, ("outside_to", pa.bool_()), ("inside_to", pa.bool_()), ("outside_opens", pa.int64()), ("inside_opens", pa.int64())])


def _line_effects(sep, quote, batches):
    """Per split: the state it ends in and the records it leaves open on some line, for either state it may begin in."""
    closing = _closing(quote)
    key, state, opens = None, [False, True], [0, 0]
    for file, block, values in _by_split(batches):
        if (file, block) != key:
            if key:
                yield _batch([(*key, *state, *opens)], _EFFECT)
            key, state, opens = (file, block), [False, True], [0, 0]
        for v in values.filter(pc.match_substring(values, quote)):
            line = v.as_py()
            for k in (0, 1):
                after = ends_inside(line, state[k], sep, quote, closing)
                opens[k] += after and not state[k]
                state[k] = after
    if key:
        yield _batch([(*key, *state, *opens)], _EFFECT)


_STATE = pa.schema([*_SPLIT, ("inside", pa.bool_()), ("opens", pa.int64())])


def _line_states(batches):
    """The state every split begins in, from the effects in file order; block -1 has a file's last state."""
    file, inside, opens, out = None, False, 0, []
    for b in batches:
        for r in b.to_pylist():
            if r["file"] != file:
                if file is not None:
                    out.append((file, -1, inside, opens))
                file, inside, opens = r["file"], False, 0
            out.append((file, r["block"], inside, opens))
            kind = "inside" if inside else "outside"
            inside, opens = r[f"{kind}_to"], opens + r[f"{kind}_opens"]
        yield _batch(out, _STATE)
        out = []
    if file is not None:
        yield _batch([(file, -1, inside, opens)], _STATE)


_RECORD = pa.schema([("value", pa.string()), ("fields", pa.list_(pa.string())), *_SPLIT, ("line", pa.int64()), ("record", pa.int64()), ("head", pa.bool_())])


def fields_of(record: str, sep: str, quote: str) -> list[str]:
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([record], delimiter=sep, quotechar=quote), [])


def _records(sep, quote, batches):
    """Records: ``value`` and, if it holds quotes, its ``fields``. The lines of a record that crosses a split border come one by one
    with the record's number in the file. ``head`` marks the first record of a file."""
    closing = _closing(quote)
    key, inside, opens, line, held, began, head = None, False, 0, 0, [], False, False

    def pieces():
        return [(v, None, *key, n, opens, head) for n, v in held]

    for b in batches:
        out = []
        starts = dict(zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist()), zip(b.column("inside").to_pylist(), b.column("opens").to_pylist())))
        for file, block, values in _by_split([b]):
            if (file, block) != key:
                if held:
                    out += pieces()
                key, line, held, began = (file, block), 0, [], False
                inside, opens = starts[key]
                head = block == 0
            quoted = pc.match_substring(values, quote).to_pylist()
            for v, q in zip(values.to_pylist(), quoted):
                line += 1
                if not inside and not q:
                    if v:
                        out.append((v, None, *key, line, None, head))
                        head = False
                    continue
                if not inside:
                    if not ends_inside(v, False, sep, quote, closing):
                        out.append((v, fields_of(v, sep, quote), *key, line, None, head))
                        head = False
                        continue
                    inside, opens, held, began = True, opens + 1, [(line, v)], True
                    continue
                held.append((line, v))
                if q and not ends_inside(v, True, sep, quote, closing):
                    if began:
                        whole = "\n".join(x for _, x in held)
                        out.append((whole, fields_of(whole, sep, quote), *key, held[0][0], None, head))
                    else:
                        out += pieces()
                    inside, held, began, head = False, [], False, False
        yield _batch(out, _RECORD)
    if held:
        yield _batch(pieces(), _RECORD)


def _parsed(sep, quote, batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("value"), pa.array([fields_of(v, sep, quote) for v in b.column("value").to_pylist()], pa.list_(pa.string())),
                                          b.column("head")], names=["value", "fields", "head"])


def line_fields(value: Column, sep: str, quote: str) -> Column:
    """The fields of one line; only lines with a quote leave the JVM."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of_quoted(lines):
        return lines.map(lambda v: None if v is None else fields_of(v, sep, quote))

    has = F.contains(value, F.lit(quote))
    return F.coalesce(of_quoted(F.when(has, value)), F.split(value, "\\Q" + sep + "\\E", -1))


def quoted_records(spark: SparkSession, path: str, sep: str, quote: str = '"', encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """(records, unclosed). records: value (the whole record, line breaks inside quotes kept as one newline), fields, head (the first
    record of its file). unclosed: the lines (value) after a quote that is never closed."""
    raw = split_rows(spark, path, encoding=encoding)
    effects = raw.mapInArrow(partial(_line_effects, sep, quote), "file string, block long, outside_to boolean, inside_to boolean, outside_opens long, inside_opens long")
    states = (effects.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_line_states, "file string, block long, inside boolean, opens long"))
    from ..session import cut_lineage
    states = cut_lineage(states, "split-states")                       # one row per split of the files
    begun = raw.join(F.broadcast(states.where("block >= 0")), ["file", "block"]).select("value", "file", "block", "inside", "opens")
    rows = begun.mapInArrow(partial(_records, sep, quote), "value string, fields array<string>, file string, block long, line long, record long, head boolean")
    whole = rows.where("record IS NULL").select(
        "value", F.coalesce("fields", F.split("value", "\\Q" + sep + "\\E", -1)).alias("fields"), "head")
    pieces = rows.where("record IS NOT NULL")
    open_end = states.where("block = -1 AND inside").select("file", F.col("opens").alias("record"))
    unclosed = pieces.join(open_end, ["file", "record"], "left_semi").select("value")
    crossing = (pieces.join(open_end, ["file", "record"], "left_anti").groupBy("file", "record")
                .agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("l"), F.bool_or("head").alias("head"))
                .select(F.array_join(F.col("l.value"), "\n").alias("value"), "head"))
    return whole.unionByName(crossing.mapInArrow(partial(_parsed, sep, quote), "value string, fields array<string>, head boolean")), unclosed


# ------------------------------------------------------------------ JSON arrays

_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_BRACKETS = re.compile(r"[\[\]{}]")


def chunk_effect(chunk: str, inside: bool) -> tuple[bool, int]:
    """(inside a string at the end, change of depth) of a chunk and the ``}`` that ends it."""
    if inside:
        m = _REST.match(chunk)
        if not m:
            return True, 0
        chunk = chunk[m.end():]
    plain = _STRING.sub("", chunk)
    opened = plain.find('"')
    if opened >= 0:
        plain = plain[:opened]
    depth = sum(1 if c in "[{" else -1 for c in _BRACKETS.findall(plain))
    return opened >= 0, depth - (opened < 0)


_JSON_EFFECT = pa.schema([*_SPLIT, ("outside_to", pa.bool_()), ("inside_to", pa.bool_()), ("outside_depth", pa.int64()), ("inside_depth", pa.int64())])


def _json_effects(batches):
    key, state, depth = None, [False, True], [0, 0]
    for file, block, values in _by_split(batches):
        if (file, block) != key:
            if key:
                yield _batch([(*key, *state, *depth)], _JSON_EFFECT)
            key, state, depth = (file, block), [False, True], [0, 0]
        for v in values.to_pylist():
            for k in (0, 1):
                state[k], d = chunk_effect(v, state[k])
                depth[k] += d
    if key:
        yield _batch([(*key, *state, *depth)], _JSON_EFFECT)


_JSON_STATE = pa.schema([*_SPLIT, ("inside", pa.bool_()), ("depth", pa.int64())])


def _json_states(batches):
    file, inside, depth = None, False, 0
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["file"] != file:
                file, inside, depth = r["file"], False, 0
            out.append((file, r["block"], inside, depth))
            kind = "inside" if inside else "outside"
            inside, depth = r[f"{kind}_to"], depth + r[f"{kind}_depth"]
        yield _batch(out, _JSON_STATE)


_ELEMENT = pa.schema([("text", pa.string()), *_SPLIT, ("part", pa.int32())])
WHOLE, FIRST, LAST, INNER = 0, 1, 2, 3


def _json_elements(batches):
    """Elements that lie in one split (part WHOLE); of a split also what comes up to its first end (FIRST), what is left after its
    last end (LAST), or all of it when no element ends there (INNER)."""
    key, inside, depth, held, ends = None, False, 0, [], 0

    def rest():
        return [("".join(held), *key, LAST if ends else INNER)]

    for b in batches:
        out = []
        starts = dict(zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist()), zip(b.column("inside").to_pylist(), b.column("depth").to_pylist())))
        for file, block, values in _by_split([b]):
            if (file, block) != key:
                if key:
                    out += rest()
                key, held, ends = (file, block), [], 0
                inside, depth = starts[key]
            for v in values.to_pylist():
                inside, change = chunk_effect(v, inside)
                depth += change
                held.append(v + "}")
                if not inside and depth == 1:
                    out.append(("".join(held), *key, WHOLE if ends else FIRST))
                    held, ends = [], ends + 1
        yield _batch(out, _ELEMENT)
    if key:
        yield _batch(rest(), _ELEMENT)


def _joined(batches):
    """Elements out of the border pieces of a file, in file order."""
    file, held = None, []
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["file"] != file:
                file, held = r["file"], []
            held.append(r["text"])
            if r["part"] == FIRST:
                out.append("".join(held))
                held = []
            elif r["part"] == LAST:
                held = [r["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def json_array_elements(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """The objects of files that hold one JSON array each, one per row (``text``, without line breaks). Files are cut at closing
    brackets, not lines, so an array on one line is read by many tasks too."""
    raw = split_rows(spark, path, encoding=encoding, lineSep="}")
    effects = raw.mapInArrow(_json_effects, "file string, block long, outside_to boolean, inside_to boolean, outside_depth long, inside_depth long")
    from ..session import cut_lineage
    states = cut_lineage(effects.repartition("file").sortWithinPartitions("file", "block")
                         .mapInArrow(_json_states, "file string, block long, inside boolean, depth long"), "split-states")
    found = (raw.join(F.broadcast(states), ["file", "block"]).select("value", "file", "block", "inside", "depth")      # one row per split
             .mapInArrow(_json_elements, "text string, file string, block long, part int"))
    border = found.where(f"part <> {WHOLE}").repartition("file").sortWithinPartitions("file", "block", F.col("part") == LAST).mapInArrow(_joined, "text string")
    every = found.where(f"part = {WHOLE}").select("text").unionByName(border)
    # what stands before an element: the array's bracket, commas, blanks, elements that are no objects
    return every.select(F.regexp_replace(F.regexp_replace("text", r"^[^{]*", ""), r"[\r\n]+", " ").alias("text")).where("text <> ''")
