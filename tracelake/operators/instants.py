"""Mixed timestamp texts to unambiguous UTC instants.

Method. Every value gets the array of all its valid interpretations (format, instant): ISO forms, epoch numbers in four
precisions, RFC 1123, spelled months, Chinese dates, compact digits, and numeric dates read day-first as well as
month-first. Where only one is possible it is taken. Where several are, a Viterbi search over the order of the
source's records chooses the sequence with the least penalty for format switches and backward time jumps.

Zones. An offset or zone in the text wins; else the zone of the source (NULL: UTC). A local time that occurs twice
means the first, one that was skipped is read with the offset before the change. Digits finer than a microsecond are
cut off.

Scale. Reading is JVM-side, and only touches values that aren't canonical already; a value is matched against the patterns first and
its zone resolved once, whatever the format. All values, sorted by (source, field, record key) into range partitions of about
``BLOCK`` values, go through the search, so a source that holds a third of all rows, or rows without a record key, are cut into
equal blocks by rank. A block whose values have one reading each is settled in vectors as it passes. A block
with an ambiguous value is condensed to the penalties between the interpretations at its two ends; these few numbers are searched
per source, and then the open blocks are solved with their neighbours' choices fixed. The result is that of one
long search.

Defined results. NULL, blank and unreadable values, impossible dates and years before 1970 or after 2199 have no
instant and are left out. An unknown source zone counts as UTC. Ties go to the earlier format in ``FORMATS``. Rows
with a NULL record key come first in their source's order, by their first reading. A NULL source is a source of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise

BLOCK = 1 << 17
SWITCH, BACKWARD, BACKWARD_SLACK_US = 1.0, 3.0, 3_600_000_000
CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$"

# Month names of RFC 1123 dates and zone abbreviations with their offsets in minutes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "NST": -210, "NDT": -150, "BRT": -180, "JST": 540, "AEST": 600, "AEDT": 660}

_CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,12}))?)?"
_ZONE = r"\s*(Z|z|[+-]\d\d(?::?\d\d)?(?::?\d\d)?|[A-Z]{2,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+)?(?:\[([A-Za-z0-9_/+\-]+)\])?\s*$"
_HALF = r"\s*([AaPp])\.?[Mm]\.?"

#: name, pattern, groups of (year, month, day, hour, minute, second, fraction, half of the day, zone); 0: not there.
FORMATS: list[tuple[str, str, tuple[int, ...]]] = [
    ("iso", r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})[Tt ]" + _CLOCK + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("slash_ymd", r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})[Tt ]" + _CLOCK + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("compact", r"^\s*((?:19|20|21)\d\d)(\d\d)(\d\d)[Tt ]?(\d\d)(\d\d)(\d\d)(?:[.,](\d{1,9}))?" + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("chinese", r"^\s*(\d{4})年(\d{1,2})月(\d{1,2})日\s*(上午|下午|凌晨|早上|中午|晚上)?\s*(\d{1,2})[:：时](\d\d)(?:[:：分](\d\d))?秒?(?:[.,](\d{1,9}))?\s*$", (1, 2, 3, 5, 6, 7, 8, 4, 0)),
    ("rfc", r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[ \-]([A-Za-z]{3,9})[ \-,]+(\d{4})[ ,T]+" + _CLOCK + _ZONE, (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    ("month_first", r"^\s*(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4}),? " + _CLOCK + _HALF + r"\s*$", (3, 1, 2, 4, 5, 6, 7, 8, 0)),
    ("month_first_24", r"^\s*(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4}),? " + _CLOCK + _ZONE, (3, 1, 2, 4, 5, 6, 7, 0, 8)),
    ("day_month_year", r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})[T ,]+" + _CLOCK + _ZONE, (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    ("month_day_year", r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})[T ,]+" + _CLOCK + _ZONE, (3, 1, 2, 4, 5, 6, 7, 0, 8)),
    ("month_day_year_12", r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})[T ,]+" + _CLOCK + _HALF + r"\s*$", (3, 1, 2, 4, 5, 6, 7, 8, 0)),
    ("day_month_year_12", r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})[T ,]+" + _CLOCK + _HALF + r"\s*$", (3, 2, 1, 4, 5, 6, 7, 8, 0)),
]
#: epoch numbers: name, integer digits, microseconds per unit (None: thousandths of a microsecond)
EPOCHS = [("epoch_s", r"^\s*(\d{9,10})(?:[.,](\d{1,9}))?\s*$", 1_000_000), ("epoch_ms", r"^\s*(\d{12,13})(?:[.,](\d{1,6}))?\s*$", 1_000), ("epoch_us", r"^\s*(\d{15,16})()\s*$", 1), ("epoch_ns", r"^\s*(\d{18,19})()\s*$", None)]
NAMES = [f[0] for f in FORMATS] + [e[0] for e in EPOCHS]
US_DAY = 86_400_000_000
LIMIT_US = (4_102_444_800 + 3_155_760_000) * 1_000_000  # the end of 2199


def zone_names(spark: SparkSession) -> list[str]:
    """The regions the JVM knows: a fixed list of some hundred names."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _local(value: Column, pattern: str, groups: tuple[int, ...], month_names: bool) -> Column:
    """struct<us, text>: local microseconds since 1970 (NULL where the value isn't a date in the format) and the zone text.

    The value is matched once: its groups are cut out together.
    """
    cut = F.split(F.regexp_replace(value, pattern, "\x1f".join(f"${g}" if g else "" for g in groups)), "\x1f", -1)

    def read(parts: Column) -> Column:
        y, mo, d, h, mi, s, frac, half, zone = [parts[k] for k in range(9)]
        if month_names:
            mo = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(mo, 1, 3))).cast("string")
        day = F.unix_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")).cast("bigint")
        hour, minute, second = h.try_cast("int"), mi.try_cast("int"), F.coalesce(s.try_cast("int"), F.lit(0))
        if groups[7]:
            late = half.isin("P", "p", "下午", "晚上", "中午")
            twelve = half.isin("A", "a", "P", "p", "上午", "下午")
            clocked = F.when(half == "", hour).when((hour == 12) & ~late, F.lit(0)).when(late & (hour < 12) & ~((half == "中午") & (hour == 11)), hour + 12).otherwise(hour)
            hour = F.when((half == "") | ~twelve | hour.between(0, 12), clocked)
        micro = F.coalesce(F.substring(F.rpad(frac, 6, "0"), 1, 6).try_cast("bigint"), F.lit(0))
        fits = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
        total = day * US_DAY + (hour.cast("bigint") * 3600 + minute.cast("bigint") * 60 + second.cast("bigint")) * 1_000_000 + micro
        return F.struct(F.when(fits, total).alias("us"), zone.alias("text"))

    return F.transform(F.array(cut), read)[0]


def _resolve(text: Column, local: Column, own: Column, regions: list[str]) -> Column:
    """Instant of a local time: the zone in the text (offset, abbreviation or region) wins over the source's own."""
    offset = r"^([+-])(\d\d):?(\d\d)?(?::?(\d\d))?$"
    part = lambda g: F.coalesce(F.regexp_extract(text, offset, g).try_cast("bigint"), F.lit(0))
    away = F.when(text.startswith("-"), -1).otherwise(1) * (part(2) * 3600 + part(3) * 60 + part(4)) * 1_000_000
    short = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()) + ")"), F.upper(text)).cast("bigint") * 60_000_000
    known = F.expr(f"map_from_arrays(array({_quoted(regions)}), array({_quoted(regions)}))")
    zone = F.when(text == "", own).otherwise(F.try_element_at(known, text))
    by_name = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))
    return F.when(text.rlike(offset), local - away).when(short.isNotNull(), local - short).otherwise(by_name)


def interpretations(value: Column, zone: Column, regions: list[str]) -> Column:
    """array<struct<fmt int, us bigint>>: all valid readings of the text, in the order of ``FORMATS``."""
    found = []
    for n, (name, pattern, groups) in enumerate(FORMATS):
        local = _local(value, pattern, groups, name in ("rfc", "month_first", "month_first_24"))
        found.append(F.when(value.rlike(pattern), F.struct(F.lit(n).alias("fmt"), local.alias("read"))))
    for n, (_, pattern, unit) in enumerate(EPOCHS, len(FORMATS)):
        whole = F.regexp_extract(value, pattern, 1).try_cast("bigint")
        if unit is None:
            us = F.floor(whole / F.lit(1000).cast("decimal(20,0)")).cast("bigint")
        else:
            digits = len(str(unit)) - 1
            rest = F.coalesce(F.substring(F.rpad(F.regexp_extract(value, pattern, 2), digits, "0"), 1, digits).try_cast("bigint"), F.lit(0)) if digits else F.lit(0)
            us = whole * unit + rest
        found.append(F.when(value.rlike(pattern), F.struct(F.lit(n).alias("fmt"), F.struct(us.alias("us"), F.lit("UTC").alias("text")).alias("read"))))
    local = F.filter(F.array(*found), lambda r: r["read"]["us"].isNotNull())
    read = F.transform(local, lambda r: F.struct(r["fmt"].alias("fmt"), _resolve(r["read"]["text"], r["read"]["us"], zone, regions).alias("us")))
    return F.filter(read, lambda r: r["us"].isNotNull() & (r["us"] >= 0) & (r["us"] < LIMIT_US))


def readings(rows: DataFrame, fields: list[str], key: str, source: str, sources: DataFrame, source_zone: str) -> DataFrame:
    """(source, record_key, field_name, canonical, cands): one row per value that denotes an instant.

    ``sources`` maps a source to its zone; it is joined after a reduction to one row per source.
    """
    regions = zone_names(rows.sparkSession)
    zones = sources.groupBy(F.col(source).alias("source")).agg(F.min(source_zone).alias("zone")).withColumn("zone", F.expr(f"case when zone in ({_quoted(regions)}) then zone end"))
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    long = rows.select(F.col(source).alias("source"), F.col(key).cast("bigint").alias("record_key"), F.explode(values).alias("v")).select("source", "record_key", "v.*").where(r"value is not null and trim(value) != ''")
    long = long.join(zones, "source", "left").withColumn("zone", F.coalesce("zone", F.lit("UTC")))
    own = F.unix_micros(F.col("value").try_cast("timestamp"))
    canonical = F.col("value").rlike(CANONICAL)
    plain = F.when(canonical & own.isNotNull(), F.array(F.struct(F.lit(0).alias("fmt"), own.alias("us"))))
    cands = F.when(canonical, plain).otherwise(interpretations(F.col("value"), F.col("zone"), regions))
    return long.select("source", "record_key", "field_name", canonical.alias("canonical"), F.array_distinct(cands).alias("cands")).where(F.size("cands") > 0)


def _step(pf, pu, cf, cu) -> np.ndarray:
    """Penalties from each interpretation of one record to each of the next."""
    return SWITCH * (np.asarray(pf)[:, None] != np.asarray(cf)[None, :]) + BACKWARD * (np.asarray(cu)[None, :] < np.asarray(pu)[:, None] - BACKWARD_SLACK_US)


def _narrowed(cands) -> tuple[np.ndarray, np.ndarray]:
    return np.array([c["fmt"] for c in cands], dtype=np.int64), np.array([c["us"] for c in cands], dtype=np.int64)


def condense(cands: list) -> tuple[tuple, tuple, np.ndarray]:
    """First and last interpretations of an ordered block and the least penalty between each pair of them."""
    first = _narrowed(cands[0])
    cost, last = np.where(np.eye(len(first[0]), dtype=bool), 0.0, np.inf), first
    single = np.array([len(c) == 1 for c in cands])
    cuts = np.flatnonzero(single)
    if len(cuts) == 0 or len(cands) == 1:
        walk = range(1, len(cands))
    else:  # between two unambiguous records the penalty is the same for every way through: only the ends matter
        walk = [*range(1, cuts[0] + 1), *range(cuts[-1] + 1, len(cands))]
    at = 0
    for i in walk:
        if i - at > 1:
            last = _narrowed(cands[i - 1])
        here = _narrowed(cands[i])
        cost = (cost[:, :, None] + _step(*last, *here)[None, :, :]).min(axis=1)
        last, at = here, i
    if at < len(cands) - 1:
        last = _narrowed(cands[-1])
    return first, last, cost


def solve(cands: list, before: tuple[int, int] | None, after: tuple[int, int] | None) -> list[int]:
    """Index of the chosen interpretation of every record, given the neighbours' choices."""
    n = len(cands)
    chosen, i = [0] * n, 0
    while i < n:
        if len(cands[i]) == 1:
            i += 1
            continue
        j = i
        while j < n and len(cands[j]) > 1:
            j += 1
        left = (cands[i - 1][chosen[i - 1]]["fmt"], cands[i - 1][chosen[i - 1]]["us"]) if i else before
        right = (cands[j][0]["fmt"], cands[j][0]["us"]) if j < n else after
        run = [_narrowed(c) for c in cands[i:j]]
        cost = _step([left[0]], [left[1]], *run[0])[0] if left else np.zeros(len(run[0][0]))
        back = []
        for prev, here in zip(run, run[1:]):
            ways = cost[:, None] + _step(*prev, *here)
            back.append(ways.argmin(axis=0))
            cost = ways.min(axis=0)
        if right:
            cost = cost + _step(*run[-1], [right[0]], [right[1]])[:, 0]
        pick = int(cost.argmin())
        for k in range(j - 1, i - 1, -1):
            chosen[k] = pick
            if k > i:
                pick = int(back[k - i - 1][pick])
        i = j
    return chosen


_PLACE = ["source", "field_name", "block"]
_VALUE = "source string, record_key bigint, field_name string, canonical boolean, fmt int, us bigint, cands array<struct<fmt:int,us:bigint>>"
_PASSED = f"kind string, block bigint, {_VALUE}, ends string"
_FIXED = "source string, field_name string, block bigint, before_fmt bigint, before_us bigint, after_fmt bigint, after_us bigint"
_SOLVED = "record_key bigint, field_name string, canonical boolean, fmt int, epoch_us bigint"
_PAIRS = pa.list_(pa.struct([("fmt", pa.int32()), ("us", pa.int64())]))
_ARROW = pa.schema(
    [("kind", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("record_key", pa.int64()), ("field_name", pa.string()), ("canonical", pa.bool_()), ("fmt", pa.int32()), ("us", pa.int64()), ("cands", _PAIRS), ("ends", pa.string())]
)


def _edges(values: pa.Table) -> np.ndarray:
    """Where a new (source, field) begins in an ordered table; the last entry is its length."""
    n = values.num_rows
    new = np.zeros(n, dtype=bool)
    for c in ("source", "field_name"):
        codes = values[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), n)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pass over one ordered block: values of settled runs are done, others stay open; every run has its ends."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    values = pa.Table.from_batches(held)
    edges = _edges(values)
    single = pa.compute.is_null(values["cands"]).to_numpy(zero_copy_only=False)
    nulls = lambda n, name: pa.nulls(n, _ARROW.field(name).type)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = values.slice(lo, hi - lo).combine_chunks()
        settled = bool(single[lo:hi].all())
        kind = "done" if settled else "open"
        for batch in part.to_batches(max_chunksize=50_000):
            n = batch.num_rows
            cols = {"kind": pa.array([kind] * n), **{c: batch.column(c) for c in batch.schema.names}}
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else nulls(n, f.name) for f in _ARROW], schema=_ARROW)
        first, last, cost = condense(_cands(part["fmt"], part["us"], part["cands"])) if not settled else _plain_ends(part)
        ends = json.dumps([first[0].tolist(), first[1].tolist(), last[0].tolist(), last[1].tolist(), cost.tolist()])
        row = {"kind": "ends", "block": part["block"][0].as_py(), "source": part["source"][0].as_py(), "field_name": part["field_name"][0].as_py(), "ends": ends}
        yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if f.name in row else nulls(1, f.name) for f in _ARROW], schema=_ARROW)


def _plain_ends(part: pa.Table) -> tuple:
    """The ends of a run in which every value has one reading; the penalty inside is the same for all ways, so 0."""
    one = lambda i: (np.array([part["fmt"][i].as_py()], dtype=np.int64), np.array([part["us"][i].as_py()], dtype=np.int64))
    return one(0), one(part.num_rows - 1), np.zeros((1, 1))


def _cands(fmt, us, cands) -> list:
    """The interpretations of every value: its list where there are several, else its only one."""
    return [c if c is not None else [{"fmt": f, "us": u}] for f, u, c in zip(fmt.to_pylist(), us.to_pylist(), cands.to_pylist())]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Viterbi over the blocks of one source: what the neighbours of each block are."""
    pdf = pdf.sort_values("block").reset_index(drop=True)
    pdf[["first_fmt", "first_us", "last_fmt", "last_us", "cost"]] = pd.DataFrame([json.loads(e) for e in pdf["ends"]], dtype=object)
    total, steps = None, []
    for r in pdf.itertuples():
        inner = np.asarray(r.cost, dtype=float)
        if total is None:
            steps.append((None, inner.argmin(axis=0)))
            total = inner.min(axis=0)
        else:
            enter = total[:, None] + _step(prev.last_fmt, prev.last_us, r.first_fmt, r.first_us)
            at_first = enter.min(axis=0)
            through = at_first[:, None] + inner
            steps.append((enter.argmin(axis=0), through.argmin(axis=0)))
            total = through.min(axis=0)
        prev = r
    firsts, lasts, pick = [0] * len(pdf), [0] * len(pdf), int(total.argmin())
    for i in range(len(pdf) - 1, -1, -1):
        lasts[i] = pick
        firsts[i] = int(steps[i][1][pick])
        if i:
            pick = int(steps[i][0][firsts[i]])
    out = pdf[["source", "field_name", "block"]].copy()
    last = [(r.last_fmt[k], r.last_us[k]) for r, k in zip(pdf.itertuples(), lasts)]
    first = [(r.first_fmt[k], r.first_us[k]) for r, k in zip(pdf.itertuples(), firsts)]
    for name, shifted in (("before", [None, *last[:-1]]), ("after", [*first[1:], None])):
        out[f"{name}_fmt"] = pd.array([x[0] if x else None for x in shifted], dtype="Int64")
        out[f"{name}_us"] = pd.array([x[1] if x else None for x in shifted], dtype="Int64")
    return out


def _choose(rows: pa.Table, fixed: pa.Table) -> pa.Table:
    """The second pass over one open run, with the choices beside it fixed."""
    rows = rows.sort_by([("seq", "ascending")])
    side = {}
    for name in ("before", "after"):
        given = fixed.num_rows and fixed[f"{name}_fmt"][0].as_py() is not None
        side[name] = (fixed[f"{name}_fmt"][0].as_py(), fixed[f"{name}_us"][0].as_py()) if given else None
    cands = _cands(rows["fmt"], rows["us"], rows["cands"])
    picked = [c[k] for c, k in zip(cands, solve(cands, side["before"], side["after"]))]
    fmt, us = pa.array([p["fmt"] for p in picked], pa.int32()), pa.array([p["us"] for p in picked], pa.int64())
    return pa.table({"record_key": rows["record_key"], "field_name": rows["field_name"], "canonical": rows["canonical"], "fmt": fmt, "epoch_us": us})


def choose(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """(record_key, field_name, canonical, fmt, epoch_us) with one interpretation per value.

    ``candidates`` is read twice (to count it and to sort it), so give a table, not a long computation.
    """
    blocks = max(1, -(-candidates.count() // block))
    first = F.col("cands")[0]
    values = candidates.select("source", "record_key", "field_name", "canonical", first["fmt"].alias("fmt"), first["us"].alias("us"), F.when(F.size("cands") > 1, F.col("cands")).alias("cands"))
    order = [F.col(c).asc_nulls_first() for c in ("source", "field_name", "record_key", "us", "fmt")]
    placed = values.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id().cast("bigint"))
    passed = materialise(placed.mapInArrow(_search_blocks, _PASSED).withColumn("seq", F.monotonically_increasing_id()), "instants")
    done = passed.where("kind = 'done'").select("record_key", "field_name", "canonical", "fmt", F.col("us").alias("epoch_us"))
    opened = passed.where("kind = 'open'").select(*_PLACE, "seq", "record_key", "canonical", "fmt", "us", "cands")
    ends = passed.where("kind = 'ends'").select(*_PLACE, "ends")
    fixed = ends.groupBy("source", "field_name").applyInPandas(_chain, _FIXED)
    solved = opened.groupBy(*_PLACE).cogroup(fixed.groupBy(*_PLACE)).applyInArrow(lambda rows, beside: _choose(rows, beside) if rows.num_rows else _NOTHING, _SOLVED)
    return done.unionByName(solved)


_NOTHING = pa.table({"record_key": pa.array([], pa.int64()), "field_name": pa.array([], pa.string()), "canonical": pa.array([], pa.bool_()), "fmt": pa.array([], pa.int32()), "epoch_us": pa.array([], pa.int64())})


def normalise(rows: DataFrame, fields: list[str], key: str, source: str, sources: DataFrame, source_zone: str, block: int = BLOCK) -> DataFrame:
    """All values of ``fields`` that denote an instant, each with its one UTC instant in microseconds since 1970."""
    found = materialise(readings(rows, fields, key, source, sources, source_zone), "readings")
    return choose(found, block)
