"""Problem 2: fields that are added, renamed, removed or retyped between files.

``ingest`` enforces a target schema: every field is read from its approved
names (at first its own name alone), cast where its value allows it, and
whatever is unknown or cannot be cast is kept as JSON in a rescue column.
``changes`` reports the drift from the ingested table: how the fields of each
file arrived against the file before it in its feed. A field that left and one
that came are one field under another name if their content says so; the
content is read from the typed columns and the rescue column. ``evolve``
approves the names found that way and replays the rescued values into the typed
columns. ``replay`` does so for names approved by hand.

Plan: an Arrow function parses each record once. Files are compared by the
distinct shapes of their records (partial aggregation, so the number of records
of a hot feed does not matter); the look back is a window per feed and day,
stitched across days by one row per day, so that no task holds all files of a
feed. Content is read only of files where a field came or left, as sketches of
bounded size (the ``SKETCH`` least hashes of a field's values) that tasks merge.

Edge cases: null, cut or otherwise unreadable records, and records that are no
object, say nothing (``ingest`` keeps them whole in the rescue column); a file
without any whole record is passed over; repeated records change nothing; null
values make a field present but give it no type; a field without a type on
either side is never retyped; files landing at the same time are ordered by
file_id; rows without feed form a feed of their own; of a key that an object
holds twice the last value counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilake.session import BROADCAST_LIMIT_BYTES, cut

# The target table: fields and how each is cast (text, whole, number, flag, instant or json).
KINDS = {
    "schema_version": "whole", "source": "text", "place_id": "text", "name": "text", "query": "text", "address": "text", "location.lat": "number", "location.lon": "number",
    "location.srid": "text", "captured_at": "instant", "live_pct": "number", "typical_by_hour": "json", "is_mock": "flag",
}
NAMES: dict[str, tuple[str, ...]] = {f: (f,) for f in KINDS}
NESTED = "location"
SKETCH = 128
TYPES = {"s": "string", "w": "whole number", "f": "number with fraction", "b": "boolean", "[": "array", "{": "object"}
_CODES = {str: "s", int: "w", float: "f", bool: "b", type(None): ""}
_COLUMN = {"text": ("string", pa.string()), "whole": ("bigint", pa.int64()), "number": ("double", pa.float64()), "flag": ("boolean", pa.bool_()), "instant": ("bigint", pa.int64()), "json": ("string", pa.string())}
_NUMBER = re.compile(r"\s*[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?\s*")
_ZONED = re.compile(r"(Z|[+-]\d{2}(:?\d{2})?)\s*$")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def shape(v: Any) -> str:
    """Whole shape of a JSON value: one letter for a scalar, nothing for null, the shapes within for arrays and objects."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shape(v[k])}" for k in sorted(v)) + "}"
    if not isinstance(v, list):
        return _CODES[type(v)]
    kinds = set(map(type, v))
    inner = {_CODES[k] for k in kinds} if kinds <= _CODES.keys() else {shape(x) for x in v}
    inner.discard("")
    if "f" in inner:
        inner.discard("w")
    return f"[{'|'.join(sorted(inner))}]"


def compact(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) else None if isinstance(v, (dict, list)) else compact(v)


def _whole(v: Any) -> int | None:
    if isinstance(v, str) and len(v) <= 400 and _NUMBER.fullmatch(v) and "," not in v:
        d = Decimal(v.strip())
        v = int(d) if abs(d) < 1 << 64 and d == int(d) else None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or abs(v) >= 1 << 63 or v != int(v):
        return None
    return int(v)


def _number(v: Any) -> float | None:
    if isinstance(v, str):
        return float(v.replace(",", ".")) if _NUMBER.fullmatch(v) else None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e308 else None


def _flag(v: Any) -> bool | None:
    if isinstance(v, bool):
        return v
    low = v.strip().lower() if isinstance(v, str) else v
    return True if low in ("true", "1", "si", "sí", 1) else False if low in ("false", "0", "no", 0) else None


def _instant(v: Any) -> int | None:
    """Microseconds since 1970 UTC of ten digits (seconds), thirteen (milliseconds) or ISO text with an offset."""
    t = str(v) if isinstance(v, int) and not isinstance(v, bool) else v
    if not isinstance(t, str):
        return None
    if t.isascii() and t.isdigit() and len(t) in (10, 13):
        return int(t) * (1_000_000 if len(t) == 10 else 1000)
    if not _ZONED.search(t):
        return None
    try:
        return (datetime.fromisoformat(t.strip()) - _EPOCH) // timedelta(microseconds=1)
    except (ValueError, TypeError, OverflowError):
        return None


CASTS: dict[str, Callable[[Any], Any]] = {"text": _text, "whole": _whole, "number": _number, "flag": _flag, "instant": _instant, "json": compact}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def read_object(text: str | None) -> dict | None:
    """The JSON object a text holds; None for everything else."""
    if text is None:
        return None
    try:
        v = json.loads(text, parse_constant=_refuse)
        return v if isinstance(v, dict) else None
    except (ValueError, RecursionError):
        return None


def flatten(record: dict, nested: str = NESTED) -> dict[str, Any]:
    """Top-level fields, those of the nested object one by one; a name met twice gets a plus sign."""
    inner = record.get(nested)
    if not isinstance(inner, dict):
        return record
    out = {k: v for k, v in record.items() if k != nested}
    for k, v in inner.items():
        k = f"{nested}.{k}"
        out[k if k not in out else f"{k}+"] = v
    return out


def fit(flat: Mapping[str, Any], names: Mapping[str, Sequence[str]], kinds: Mapping[str, str], filled: Sequence[Any] | None = None) -> tuple[list[Any], dict[str, Any]]:
    """(one value per target field, what is left over): unknown fields, values that could not be cast or differ from the one taken."""
    row, rest, known = list(filled) if filled else [None] * len(names), {}, set()
    for i, (f, aliases) in enumerate(names.items()):
        cast = CASTS[kinds.get(f, "text")]
        for a in aliases:
            known.add(a)
            v = flat.get(a)
            if v is None:
                continue
            c = cast(v)
            if row[i] is None and c is not None:
                row[i] = c
            elif c is None or c != row[i]:
                rest[a] = v
    for k, v in flat.items():
        if v is not None and k not in known:
            rest[k] = v
    return row, rest


def _columns(names: Mapping[str, Sequence[str]], kinds: Mapping[str, str]) -> tuple[list[str], list[str], list[pa.DataType]]:
    of = [_COLUMN[kinds.get(f, "text")] for f in names]
    return [f.replace(".", "_") for f in names], [k for k, _ in of], [p for _, p in of]


def ingest(df: DataFrame, record: str = "record", names: Mapping[str, Sequence[str]] = NAMES, kinds: Mapping[str, str] = KINDS, rescue: str = "_rescued", arrived: str | None = None) -> DataFrame:
    """df without ``record``, plus one typed column per target field (dots become underscores) and the rescue column.

    The rescue column is a JSON object of every field that is unknown, whose
    value could not be cast (a fraction is no whole number) or differs from the
    one taken from another approved name, or the whole text of an unreadable record under
    the key ``_record``; null when nothing was left over. ``arrived`` names a
    further column with the fields as they came and their shapes, null where
    the record was unreadable. Columns of df that bear the name of a new column
    are kept as ``in_`` and their name.
    """
    cols, sql, arrow = _columns(names, kinds)
    taken = {*cols, rescue, arrived or rescue}
    df = df.withColumnsRenamed({c: f"in_{c}" for c in df.columns if c in taken and c != record})
    keep = [c for c in df.columns if c != record]
    kind = T.StructType([T.StructField(f"f{i}", T._parse_datatype_string(t)) for i, t in enumerate([*sql, "string", "string"])])
    parts = [pa.field(f"f{i}", t) for i, t in enumerate([*arrow, pa.string(), pa.string()])]

    @F.arrow_udf(kind)
    def read(text: pa.Array) -> pa.Array:
        rows, memo = [], {}
        for t in text.to_pylist():
            o = read_object(t)
            try:
                if o is None:
                    raise ValueError
                flat = flatten(o)
                row, rest = fit(flat, names, kinds)
                rescued = compact(rest) if rest else None
                came = tuple(sorted((k, shape(v)) for k, v in flat.items()))
            except (ValueError, RecursionError, OverflowError):
                rows.append((*[None] * len(cols), None if t is None else compact({"_record": t}), None))
                continue
            if came not in memo:
                memo[came] = compact(came)
            rows.append((*row, rescued, memo[came]))
        values = zip(*rows) if rows else [()] * len(parts)
        return pa.StructArray.from_arrays([pa.array(v, p.type) for v, p in zip(values, parts)], fields=parts)

    d = df.withColumn("__r", read(F.col(record)))
    out = [F.col("__r")[f"f{i}"].alias(c) for i, c in enumerate([*cols, rescue])]
    return d.select(*keep, *out, *([F.col("__r")[f"f{len(cols) + 1}"].alias(arrived)] if arrived else []))


def replay(table: DataFrame, approved: Mapping[str, Sequence[str]], kinds: Mapping[str, str] = KINDS, rescue: str = "_rescued") -> DataFrame:
    """Fill typed columns from newly approved names in the rescue column, and take out of it what they now hold.

    approved: field -> names. A field that the table lacks becomes a new
    column; a filled value stays, and a rescued one that differs stays rescued.
    """
    if not approved:
        return table
    cols, sql, arrow = _columns(approved, kinds)
    kind = T.StructType([T.StructField(f"f{i}", T._parse_datatype_string(t)) for i, t in enumerate([*sql, "string"])])
    parts = [pa.field(f"f{i}", t) for i, t in enumerate([*arrow, pa.string()])]

    @F.arrow_udf(kind)
    def read(text: pa.Array, *filled: pa.Array) -> pa.Array:
        rows = []
        for t, *row in zip(text.to_pylist(), *[f.to_pylist() for f in filled]):
            o = read_object(t)
            if o is None or o.keys() == {"_record"}:
                rows.append((*row, t))
                continue
            new, rest = fit(o, approved, kinds, row)
            rows.append((*new, compact(rest) if rest else None))
        values = zip(*rows) if rows else [()] * len(parts)
        return pa.StructArray.from_arrays([pa.array(v, p.type) for v, p in zip(values, parts)], fields=parts)

    filled = [F.col(c) if c in table.columns else F.lit(None).cast(t) for c, t in zip(cols, sql)]
    d = table.withColumn("__r", read(F.col(rescue), *filled))
    return d.withColumns({c: F.col("__r")[f"f{i}"] for i, c in enumerate([*cols, rescue])}).drop("__r")


# how files differ, from the shapes of their records


def _types(shapes: Sequence[str]) -> dict[str, tuple[str, str]]:
    """field -> (kinds, whole shapes) over the distinct shapes of a file's records."""
    out: dict[str, set[str]] = {}
    for s in shapes:
        for name, sh in json.loads(s):
            out.setdefault(name, set()).update([sh] if sh else [])
    return {k: (" | ".join(sorted({TYPES[s[0]] for s in v})), " | ".join(sorted(v))) for k, v in out.items()}


_STEP = "file_id bigint, prior bigint, feed string, gone array<string>, come array<string>, typed array<struct<field:string,was:string,kind:string,was_kind:string,shape:string,was_shape:string>>"


def _steps(files: DataFrame) -> DataFrame:
    """One row per file that differs from the one before it."""
    order = F.struct("__landed", "__file")
    w = Window.partitionBy("__feed", "__day").orderBy("__landed", "__file")
    here = F.struct(F.col("__file").alias("file"), "now")
    files = files.withColumn("__day", F.to_date("__landed")).withColumn("before", F.lag(here).over(w))
    days = files.groupBy("__feed", "__day").agg(F.max_by(here, order).alias("last"))
    days = days.withColumn("__prior", F.lag("last").over(Window.partitionBy("__feed").orderBy("__day"))).drop("last")
    both = files.join(days.withColumnsRenamed({"__feed": "f2", "__day": "d2"}), F.col("__feed").eqNullSafe(F.col("f2")) & F.col("__day").eqNullSafe(F.col("d2")))
    both = both.select(F.col("__file").alias("file_id"), F.col("__feed").alias("feed"), "now", F.coalesce("before", "__prior").alias("before")).where(F.col("before").isNotNull())
    both = both.select("file_id", "feed", F.col("before.file").alias("prior"), F.array_sort("now").alias("now"), F.array_sort("before.now").alias("was")).where(F.col("now") != F.col("was"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, feed, prior, now, was in zip(p["file_id"], p["feed"], p["prior"], p["now"], p["was"]):
                a, b = _types(was), _types(now)
                gone, come = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
                typed = [(f, f, b[f][0], a[f][0], b[f][1], a[f][1]) for f in sorted(a.keys() & b.keys()) if a[f] != b[f]]
                typed += [(f, None, b[f][0], None, b[f][1], None) for f in come] + [(None, f, None, a[f][0], None, a[f][1]) for f in gone]
                if gone or come or typed:
                    rows.append((i, prior, feed, gone, come, typed))
            yield pd.DataFrame(rows, columns=["file_id", "prior", "feed", "gone", "come", "typed"], dtype=object)

    return both.mapInPandas(run, _STEP)


# what a field's values are like


def _leaves(v: Any) -> list[str]:
    if isinstance(v, dict):
        return [x for y in v.values() for x in _leaves(y)]
    if isinstance(v, list):
        return [x for y in v for x in _leaves(y)]
    n = _number(v)
    return [] if v is None else [f"{n:g}" if n is not None else str(v).casefold()]


def look(v: Any) -> tuple[str, str, float]:
    """(family, content, magnitude) of a value, the same however it is written: 41 and "41" are one."""
    if isinstance(v, (dict, list)):
        leaves = sorted(_leaves(v))
        return "o", "|".join(leaves), float(len(leaves))
    if isinstance(v, bool):
        return "n", str(float(v)), float(v)
    if (at := _instant(v)) is not None:
        return "i", str(at // 1_000_000), at / 1e6
    if (n := _number(v)) is not None:
        return "n", str(n), n
    if isinstance(v, str) and (flag := _flag(v)) is not None:
        return "n", str(float(flag)), float(flag)
    t = " ".join(str(v).casefold().split())
    return "t", t, float(len(t))


class Content:
    """A bounded summary of a field's values in one file: families, magnitudes and a sketch of the values with their counts."""

    def __init__(self) -> None:
        self.n, self.family, self.low, self.high, self.total = 0, {}, float("inf"), float("-inf"), 0.0
        self.sketch: dict[int, int] = {}

    def add(self, v: Any) -> None:
        family, content, size = look(v)
        self.n += 1
        self.family[family] = self.family.get(family, 0) + 1
        self.low, self.high, self.total = min(self.low, size), max(self.high, size), self.total + size
        h = xxhash.xxh64_intdigest(content) >> 1
        self.sketch[h] = self.sketch.get(h, 0) + 1
        if len(self.sketch) > 4 * SKETCH:
            self.trim()

    def trim(self) -> None:
        self.sketch = {h: self.sketch[h] for h in sorted(self.sketch)[:SKETCH]}

    def merge(self, o: Content) -> None:
        self.n += o.n
        for k, v in o.family.items():
            self.family[k] = self.family.get(k, 0) + v
        self.low, self.high, self.total = min(self.low, o.low), max(self.high, o.high), self.total + o.total
        for h, k in o.sketch.items():
            self.sketch[h] = self.sketch.get(h, 0) + k
        self.trim()

    def dump(self) -> str:
        self.trim()
        return json.dumps([self.n, self.family, self.low, self.high, self.total, [[h, k] for h, k in self.sketch.items()]])

    @classmethod
    def load(cls, text: str) -> Content:
        c = cls()
        c.n, c.family, c.low, c.high, c.total, pairs = json.loads(text)
        c.sketch = {h: k for h, k in pairs}
        return c


def _pieces(name: str) -> set[str]:
    """Pairs of neighbouring letters within the words of a name."""
    words = re.findall(r"[A-Za-z][a-z]*|\d+", name.rpartition(".")[2])
    return {w[i : i + 2] for w in map(str.lower, words) for i in range(max(1, len(w) - 1))}


def plain_name(name: str) -> str:
    """A name however its words are joined: placeId and place_id are one."""
    return re.sub(r"[^a-z0-9.]", "", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())


def likeness(a: str, x: Content | None, b: str, y: Content | None) -> float:
    """How far field a with content x and field b with content y are one field under two names, 0 to 1 and more."""
    p, q = _pieces(a), _pieces(b)
    named = 2 * len(p & q) / max(1, len(p) + len(q))
    if plain_name(a) == plain_name(b):
        return 2.0
    if not x or not y or not x.n or not y.n:
        return 0.6 * named
    family = sum(min(x.family.get(k, 0) / x.n, y.family.get(k, 0) / y.n) for k in x.family)
    edge = min(max(x.sketch), max(y.sketch)) if max(len(x.sketch), len(y.sketch)) >= SKETCH else 1 << 64
    left, right = {h for h in x.sketch if h <= edge}, {h for h in y.sketch if h <= edge}
    shared = len(left & right) / max(1, min(len(left), len(right)))
    often = sum(min(x.sketch[h] / x.n, y.sketch[h] / y.n) for h in left & right) if len(left | right) <= 8 else shared
    mean_x, mean_y = x.total / x.n, y.total / y.n
    if min(x.family.get("i", 0) / x.n, y.family.get("i", 0) / y.n) > 0.5:
        # times go on from file to file, so that their values are never shared
        return family * (0.8 if abs(mean_x - mean_y) < FILES_APART_S else 0.2) + 0.3 * named
    span = max(x.high, y.high) - min(x.low, y.low)
    reach = 1.0 if span == 0 else max(0.0, min(x.high, y.high) - max(x.low, y.low)) / span
    middle = 1 - abs(mean_x - mean_y) / max(span, abs(mean_x), abs(mean_y), 1e-9)
    return family * (0.1 + 0.4 * min(shared, often) + 0.2 * reach + 0.2 * middle) + 0.3 * named


FILES_APART_S = 60 * 86_400
LIKE = 0.45  # likeness from which two names are one field


def pair_up(gone: Mapping[str, Content | None], come: Mapping[str, Content | None], home: Mapping[str, str] | None = None) -> dict[str, str]:
    """new name -> old name, best pair first; only fields of one object are paired.

    home: the target field of names that are known; two such names are one
    field if that is the same, and otherwise are not.
    """
    home = home or {}
    pairs = []
    for a, x in gone.items():
        for b, y in come.items():
            if a.rpartition(".")[0] != b.rpartition(".")[0]:
                continue
            both = a in home and b in home
            pairs.append((-(2.0 * (home[a] == home[b]) if both else likeness(a, x, b, y)), a, b))
    out: dict[str, str] = {}
    for s, a, b in sorted(pairs):
        if s <= -LIKE and b not in out and a not in out.values():
            out[b] = a
    return out


def _contents(table: DataFrame, steps: DataFrame, names: Mapping[str, Sequence[str]], kinds: Mapping[str, str], rescue: str) -> DataFrame:
    """(file, field, content) of the fields that came or left, of the files on either side."""
    both = steps.where((F.size("gone") > 0) & (F.size("come") > 0))
    want = both.select(F.col("file_id").alias("file"), F.explode("come").alias("field")).union(both.select("prior", F.explode("gone")))
    want = cut(want.groupBy("file").agg(F.collect_set("field").alias("fields")), "wanted")
    if want.count() * 1000 <= BROADCAST_LIMIT_BYTES:
        want = F.broadcast(want)
    own = {f: f.replace(".", "_") for f in names}
    d = table.where(F.col("__arrived").isNotNull()).join(want.withColumnRenamed("file", "__wf"), F.col("__file").eqNullSafe(F.col("__wf")))
    # distinct rows, so that repeated records weigh nothing
    d = d.select("__file", "fields", rescue, *own.values()).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, str], Content] = {}
        for p in parts:
            columns = {f: p[c].tolist() for f, c in own.items()}
            for k, (file, fields, rescued) in enumerate(zip(p["__file"], p["fields"], p[rescue])):
                rest = read_object(rescued if isinstance(rescued, str) else None) or {}
                for f in fields:
                    v = rest.get(f)
                    if v is None and f in columns:
                        v = columns[f][k]
                        v = None if v is None or v != v else json.loads(v) if kinds.get(f) == "json" else int(v) // 1000 if kinds.get(f) == "instant" else v
                    if v is not None:
                        seen.setdefault((file, f), Content()).add(v)
            if len(seen) > 2_000:
                yield dump(seen)
                seen = {}
        yield dump(seen)

    def dump(seen: Mapping[tuple[int, str], Content]) -> pd.DataFrame:
        return pd.DataFrame([(a, b, c.dump()) for (a, b), c in seen.items()], columns=["file", "field", "content"], dtype=object)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = Content()
        for c in pdf["content"]:
            whole.merge(Content.load(c))
        return pd.DataFrame([(pdf["file"].iloc[0], pdf["field"].iloc[0], whole.dump())], columns=["file", "field", "content"], dtype=object)

    kind = "file bigint, field string, content string"
    return d.mapInPandas(run, kind).groupBy("file", "field").applyInPandas(merge, kind)


_CHANGE = "file_id bigint, feed string, field string, change string, was string, kind string"


def _judged(steps: DataFrame, contents: DataFrame, home: Mapping[str, str] | None = None) -> DataFrame:
    """(file_id, feed, field, change, was, kind): every change; kind is set for those of a whole shape alone."""
    by_file = contents.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "content"))).alias("c"))
    d = steps.join(by_file.withColumnsRenamed({"file": "file_id", "c": "new"}), "file_id", "left").join(by_file.withColumnsRenamed({"file": "prior", "c": "old"}), "prior", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, feed, gone, come, typed, new, old in zip(p["file_id"], p["feed"], p["gone"], p["come"], p["typed"], p["new"], p["old"]):
                read = lambda m, fs: {f: Content.load(dict(m)[f]) if m is not None and f in dict(m) else None for f in fs}  # noqa: B023, E731
                named = pair_up(read(old, gone), read(new, come), home)
                rows += [(i, feed, f, "removed", f, None) for f in gone if f not in named.values()] + [(i, feed, f, "added", None, None) for f in come if f not in named] + [(i, feed, b, "renamed", a, None) for b, a in named.items()]
                now = {t["field"]: t for t in typed if t["field"] is not None}
                was = {t["was"]: t for t in typed if t["was"] is not None}
                for f, t in now.items():
                    o = was.get(named.get(f, f))
                    if o is None or not t["kind"] or not o["was_kind"]:
                        continue
                    if t["kind"] != o["was_kind"]:
                        rows.append((i, feed, f, "retyped", o["was"], None))
                    elif t["shape"] != o["was_shape"]:
                        rows.append((i, feed, f, "retyped", o["was"], t["kind"]))
            yield pd.DataFrame(rows, columns=["file_id", "feed", "field", "change", "was", "kind"], dtype=object)

    return d.mapInPandas(run, _CHANGE)


def _met(files: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """In how many files two names stand in one record; such names are two fields."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for now in p["now"]:
                records = [{name for name, _ in json.loads(s)} for s in now]
                rows += [(k,) for k, (a, b) in enumerate(pairs) if any(a in r and b in r for r in records)]
            yield pd.DataFrame(rows, columns=["k"])

    got = files.select("now").mapInPandas(run, "k int").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    return {pairs[r["k"]]: r["n"] for r in got}


def approve(renamed: Sequence[tuple[str, str, int]], names: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """Target field -> names, from (old name, new name, times met): each name goes to the field that it is linked to most often, along the strongest links."""
    home = {a: f for f, aliases in names.items() for a in aliases}
    weight: dict[tuple[str, str], int] = {}
    for a, b, n in renamed:
        for pair in ((a, b), (b, a)):
            weight[pair] = weight.get(pair, 0) + n
    while True:
        votes: dict[str, dict[str, int]] = {}
        for (a, b), n in weight.items():
            if a in home and b not in home:
                v = votes.setdefault(b, {})
                v[home[a]] = v.get(home[a], 0) + n
        if not votes:
            break
        best = max(votes, key=lambda b: (max(votes[b].values()), b))
        home[best] = max(votes[best], key=lambda f: (votes[best][f], f))
    return {f: (*aliases, *sorted(a for a, t in home.items() if t == f and a not in aliases)) for f, aliases in names.items()}


def evolve(df: DataFrame, feed: str = "feed", file_id: str = "file_id", landed: str = "landed_at", record: str = "record", names: Mapping[str, Sequence[str]] = NAMES, kinds: Mapping[str, str] = KINDS, shaped: str = "typical_by_hour", rescue: str = "_rescued") -> tuple[DataFrame, DataFrame, dict[str, tuple[str, ...]]]:
    """(table, changes, names): ingest, learn names from content, report the drift, replay.

    changes: file_id, feed, field, change and was (the name before). Names are
    learned in a first look: pairs that content calls one field, less those
    that stand side by side in more files than they take turns in. With them
    known, all files are judged, so that a rename whose values say little is
    told by the same rename elsewhere. Names are a vocabulary of the feeds'
    makers, not of the data's size; only their distinct pairs come to the driver.
    """
    d = df.withColumns({"__feed": F.coalesce(F.col(feed), F.lit("\u0000")), "__landed": F.col(landed), "__file": F.col(file_id)})
    table = cut(ingest(d, record, names, kinds, rescue, arrived="__arrived"), "ingested")
    files = table.where(F.col("__arrived").isNotNull()).select("__feed", "__landed", "__file", "__arrived").distinct().groupBy("__feed", "__landed", "__file").agg(F.collect_list("__arrived").alias("now"))
    files = cut(files, "files")
    steps = cut(_steps(files), "steps")
    contents = cut(_contents(table, steps, names, kinds, rescue), "contents")
    turns = {(r["was"], r["field"]): r["n"] for r in _judged(steps, contents).where("change = 'renamed'").groupBy("was", "field").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = _met(files, list(turns)) if turns else {}
    known = approve([(a, b, n) for (a, b), n in turns.items() if met.get((a, b), 0) <= n], names)
    found = _judged(steps, contents, {a: f for f, aliases in known.items() for a in aliases})
    changes = found.where(F.col("kind").isNull() | F.col("field").isin(*known.get(shaped, (shaped,)))).select("file_id", F.nullif("feed", F.lit("\u0000")).alias("feed"), "field", "change", "was")
    out = replay(table, {f: a for f, a in known.items() if len(a) > 1}, kinds, rescue)
    return out.drop("__feed", "__landed", "__file", "__arrived"), changes, known


def changes(df: DataFrame, feed: str = "feed", file_id: str = "file_id", landed: str = "landed_at", record: str = "record", **how) -> DataFrame:
    """(file_id, field, change) of every file against the one before it in its feed."""
    return evolve(df, feed, file_id, landed, record, **how)[1].select("file_id", "field", "change")
