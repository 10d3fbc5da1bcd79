"""Ordered-sequence primitives (W1-W6) that hold when one key owns a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a hot key into one task. Here every heavy step works on bounded pieces:

* ``running_count`` cuts the order of all rows into ranges of about equally many rows, whatever their keys and times, and
  adds what earlier ranges hold of a range's first key, the only one that can have begun before it;
* ``shifted`` and ``fold_chunks`` cut a key by row position into chunks of at most ``chunk_rows`` rows. What crosses a
  chunk border is either a few overlapping rows (lag, lead) or a small state (greedy selection, distinct counting).

The only per-key steps run over one row per slice or chunk. All results equal the sequential definition.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_released

SECOND = 1_000_000
CHUNK_ROWS = 65_536


FIRST, LAST = 1, 2


def counted_ranges(df: DataFrame, keys: list[str], order: list[str], unit: Column) -> DataFrame:
    """df by ranges of (keys, order): the number of the range, __inside (the running sum of unit per key in it), and
    __edge, which marks the FIRST and the LAST row of a range (or adds up both).

    The cuts are sampled quantiles of the rows, so a key or a time that many rows share is spread over ranges. Written
    once, as cuts drawn again would differ; rows without a key or time have no place in the order and stay out.
    """
    placed = df.dropna(subset=[*keys, *order[:1]]).withColumn("__unit", unit)
    fields = [*df.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__inside", T.LongType()),
              T.StructField("__edge", T.IntegerType())]

    def number(batches):
        last, carried, held = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                column = batch.column(k)
                opens[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = [batch.column(k)[0].as_py() for k in keys]
            sums = np.cumsum(batch.column("__unit").to_numpy(zero_copy_only=False))
            opened = np.maximum.accumulate(np.where(opens, np.arange(len(sums)), 0))
            inside = sums - np.where(opened > 0, sums[opened - 1], 0)
            inside[opened == 0] += carried if first == last else 0
            edge = np.zeros(len(sums), dtype="int32")
            if held is None:
                edge[0] = FIRST
            else:
                yield held[0].append_column("__edge", pa.array(held[1]))
            last, carried = [batch.column(k)[-1].as_py() for k in keys], int(inside[-1])
            held = batch.drop_columns(["__unit"]).append_column("__inside", pa.array(inside, pa.int64())), edge
        if held is not None:
            held[1][-1] += LAST
            yield held[0].append_column("__edge", pa.array(held[1]))

    return cut_released(
        placed.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .select(*df.columns, F.spark_partition_id().alias("__range"), "__unit").mapInArrow(number, T.StructType(fields)))


def running_count(
    df: DataFrame,
    keys: list[str],
    out: str,
    order: list[str] = ("us", "seq"),
    flag: Column | None = None,
) -> DataFrame:
    """Add out: rows of the same key up to and including this one (only those where flag holds).

    Rows without a key or a time are left out. Order columns tell all rows of a key apart.
    """
    unit = F.lit(1).cast("long") if flag is None else F.coalesce(flag.cast("long"), F.lit(0).cast("long"))
    ranges = counted_ranges(df, list(keys), list(order), unit)
    edges = ranges.filter("__edge > 0").withColumn("__key", F.struct(F.lit(0).alias("__zero"), *keys))
    row = Window.partitionBy(F.lit(0)).orderBy("__range", "__edge")  # two rows per range at most
    before = F.coalesce(
        F.sum(F.when(F.col("__edge") >= LAST, F.col("__inside"))).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goes_on = F.coalesce(F.lag("__key").over(row) == F.col("__key"), F.lit(False))
    offsets = (
        edges.withColumns({"__before": before, "__goes_on": goes_on})
        .withColumn("__base", F.last(F.when(~F.col("__goes_on"), F.col("__before")), ignorenulls=True).over(row))
        .withColumn("__past", F.col("__before") - F.col("__base"))
        .filter(f"__edge != {LAST} AND __past > 0").select("__range", *keys, "__past"))
    return (
        ranges.join(F.broadcast(cut_released(offsets)), ["__range", *keys], "left")
        .select(*df.columns, (F.col("__inside") + F.coalesce("__past", F.lit(0))).alias(out))
    )


def shifted(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    offset: int,
    out: str,
    rank: str = "rank",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add out: value of the row `offset` positions later (negative: earlier) by the dense rank of the key.

    Rows near a chunk border are copied into the neighbouring chunk as context and dropped afterwards.
    """
    span = abs(offset)
    if span == 0:
        return df.withColumn(out, F.col(value) if isinstance(value, str) else value)
    chunk_rows = max(chunk_rows, 2 * span)
    home = F.expr(f"({rank} - 1) div {chunk_rows}")
    position = F.expr(f"({rank} - 1) % {chunk_rows}")
    if offset < 0:
        near_border, neighbour = position >= chunk_rows - span, F.col("__home") + 1
    else:
        near_border, neighbour = position < span, F.col("__home") - 1
    copies = F.when(near_border, F.array(F.col("__home"), neighbour)).otherwise(F.array(F.col("__home")))
    in_chunk = Window.partitionBy(*keys, "__chunk").orderBy(rank)
    shift = F.lag(value, span) if offset < 0 else F.lead(value, span)
    return (
        df.withColumn("__home", home)
        .withColumn("__chunk", F.explode(copies))
        .withColumn(out, shift.over(in_chunk))
        .filter("__chunk = __home")
        .drop("__home", "__chunk")
    )


def first_rows(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every group (W5); Spark prunes each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def gap_sessions(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Add session: the first event time of the run of events in which no two neighbours lie more than gap_us apart.

    Two events in one slice of width gap_us are never further apart than that, so sessions follow from the first and
    last time of each slice. Only those summaries are ordered per key.
    """
    sliced = df.withColumn("__slice", F.expr(f"us div {gap_us}"))
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    so_far = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        sliced.groupBy(*keys, "__slice").agg(F.min("us").alias("__lo"), F.max("us").alias("__hi"))
        .withColumn("__prev", F.lag("__hi").over(by_slice))
        .withColumn("__start", F.when(F.col("__prev").isNull() | (F.col("__lo") - F.col("__prev") > gap_us), F.col("__lo")))
        .select(*keys, "__slice", F.max("__start").over(so_far).alias("session"))
    )
    return sliced.join(starts, [*keys, "__slice"]).drop("__slice")


def session_summary(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """One row per gap session: first and last time and the number of events, without touching single events twice."""
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    so_far = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("__slice", F.expr(f"us div {gap_us}"))
        .groupBy(*keys, "__slice")
        .agg(F.min("us").alias("__lo"), F.max("us").alias("__hi"), F.count("*").alias("__n"))
        .withColumn("__prev", F.lag("__hi").over(by_slice))
        .withColumn("__start", F.when(F.col("__prev").isNull() | (F.col("__lo") - F.col("__prev") > gap_us), F.col("__lo")))
        .withColumn("session", F.max("__start").over(so_far))
        .groupBy(*keys, "session")
        .agg(F.max("__hi").alias("last_us"), F.sum("__n").alias("n_events"))
        .withColumnRenamed("session", "first_us")
    )


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of a sorted partition, one after the other, as arrays per column.

    Rows arrive in batches that know nothing of groups; only the unfinished last group is carried along. Many small
    groups share a batch, which is far cheaper than one call per group.
    """
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        arrays = {c: rows[c].to_numpy() for c in rows.columns}
        changed = np.zeros(len(rows), dtype=bool)
        for k in keys:
            changed[1:] |= arrays[k][1:] != arrays[k][:-1]
        starts = [0, *np.flatnonzero(changed)]
        for begin, end in zip(starts, starts[1:]):
            yield {c: v[begin:end] for c, v in arrays.items()}
        rest = rows.iloc[starts[-1]:]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


def _frames(rows: Iterable[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def fold_chunks(
    df: DataFrame,
    keys: list[str],
    summarise: Callable[[dict], object],
    advance: Callable[[object, object], object],
    emit: Callable[[object, dict], list[int]],
    start: object,
    reverse: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run an order-dependent fold over the dense `rank` of each key; returns (keys, rank) of the rows it picks, written once.

    1. summarise: every chunk of at most chunk_rows positions, on its own, to a small summary;
    2. advance: over a key's summaries in order, giving the state in which each chunk is entered;
    3. emit: every chunk again, on its own, from its entry state, which arrives as the chunk's first row.
    """
    part = [*keys, "__chunk"]
    chunked = df.withColumn("__chunk", F.expr(f"(rank - 1) div {chunk_rows}"))
    ids = _fields(chunked, part)
    text = [T.StructField("__state", T.StringType())]

    def first_pass(batches):
        yield from _frames(
            ((*(g[c][0] for c in part), json.dumps(summarise(g))) for g in sorted_groups(batches, part)),
            [*part, "__state"])

    def walk(batches):
        def entered():
            for g in sorted_groups(batches, keys):
                state = start
                for i, summary in enumerate(g["__state"]):
                    yield (*(g[c][i] for c in part), json.dumps(state))
                    state = advance(state, json.loads(summary))

        yield from _frames(entered(), [*part, "__state"])

    def second_pass(batches):
        def picked():
            for g in sorted_groups(batches, part):
                key = tuple(g[k][0] for k in keys)
                for r in emit(json.loads(g["__state"][0]), {c: v[1:] for c, v in g.items()}):
                    yield (*key, r)

        yield from _frames(picked(), [*keys, "rank"])

    summaries = (
        chunked.repartition(*part).sortWithinPartitions(*part, "rank")
        .mapInPandas(first_pass, T.StructType([*ids, *text])))
    order = F.col("__chunk").desc() if reverse else F.col("__chunk")
    states = (
        summaries.repartition(*keys).sortWithinPartitions(*keys, order)
        .mapInPandas(walk, T.StructType([*ids, *text])))
    return cut_released(
        chunked.withColumn("__state", F.lit(None).cast("string"))
        .unionByName(states.withColumn("rank", F.lit(0).cast("long")), allowMissingColumns=True)
        .repartition(*part).sortWithinPartitions(*part, "rank")
        .mapInPandas(second_pass, T.StructType([*_fields(chunked, keys), T.StructField("rank", T.LongType())])))


def spaced_picks(candidates: DataFrame, keys: list[str], n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Greedy choice over the rank column: take the first candidate, then each next one at least n ranks later.

    This is what "fire at n, then clear the buffer" selects. Entering a chunk, the first allowed rank exceeds the
    chunk's start by less than n, so a chunk is described by n possible outcomes.
    """
    chunk_rows = max(chunk_rows, n)

    def follow(ranks: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        after = np.searchsorted(ranks, ranks + n)
        at = np.searchsorted(ranks, allowed)
        last = np.full(len(at), -1)
        while (live := at < len(ranks)).any():
            last = np.where(live, at, last)
            at = np.where(live, after[np.minimum(at, len(ranks) - 1)], at)
        return np.where(last >= 0, ranks[last] + n, allowed)

    def summarise(rows):
        ranks = rows["rank"]
        first = int((ranks[0] - 1) // chunk_rows) * chunk_rows + 1
        return [first, follow(ranks, first + np.arange(n)).tolist()]

    def advance(allowed, summary):
        first, exits = summary
        return exits[max(0, allowed - first)]

    def emit(allowed, rows):
        ranks = rows["rank"].astype("int64")
        after = np.searchsorted(ranks, ranks + n)
        at, picked = int(np.searchsorted(ranks, allowed)), []
        while at < len(ranks):
            picked.append(int(ranks[at]))
            at = int(after[at])
        return picked

    return fold_chunks(candidates.select(*keys, "rank"), keys, summarise, advance, emit, 1, chunk_rows=chunk_rows)


def _distinct_run(values: list, begin: int, k: int, seen: list, on_fire, stop_at=None):
    """Collect distinct values from begin on; clear at k of them. Returns the values held at the end."""
    held = set(seen)
    for i in range(begin, len(values)):
        held.add(values[i])
        if len(held) >= k:
            held.clear()
            on_fire(i)
            if stop_at is not None and i in stop_at:
                return stop_at[i]
    return sorted(held)


def distinct_picks(rows: DataFrame, keys: list[str], value: str, k: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ranks at which the k-th distinct value since the last such rank appears.

    Whatever values a chunk is entered with, its first hit falls on the first occurrence of one of its first k
    distinct values; after that only the position counts. So k outcomes describe a chunk.
    """

    def summarise(chunk):
        values = chunk[value].tolist()
        firsts, where = [], {}
        for i, v in enumerate(values):
            if v not in where:
                where[v] = i
                firsts.append(v)
                if len(firsts) == k:
                    break
        known, outcomes = {}, {}
        for v in reversed(firsts):
            fired: list[int] = []
            outcome = _distinct_run(values, where[v] + 1, k, [], fired.append, known)
            known.update(dict.fromkeys(fired, outcome))
            known[where[v]] = outcomes[v] = outcome
        return [firsts, [outcomes[v] for v in firsts]]

    def advance(held, summary):
        firsts, outcomes = summary
        now = set(held)
        for v, outcome in zip(firsts, outcomes):
            now.add(v)
            if len(now) >= k:
                return outcome
        return sorted(now)

    def emit(held, chunk):
        fired: list[int] = []
        _distinct_run(chunk[value].tolist(), 0, k, held, fired.append)
        return chunk["rank"][fired].tolist()

    return fold_chunks(rows.select(*keys, "rank", value), keys, summarise, advance, emit, [], chunk_rows=chunk_rows)


def first_diverse_anchor(
    rows: DataFrame, keys: list[str], value: str, k: int, width_us: int, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per key the first row whose forward window of width_us holds at least k distinct values.

    Read backwards, the next k distinct values and their next times are all the state there is.
    """

    def nearest(known: list, found: list) -> list:
        mine = {v for v, _ in found}
        return [*found, *[[v, t] for v, t in known if v not in mine]][:k]

    def summarise(chunk):
        found: dict = {}
        for v, t in zip(chunk[value].tolist(), chunk["us"].tolist()):
            if v not in found:
                found[v] = int(t)
                if len(found) == k:
                    break
        return list(map(list, found.items()))

    def emit(following, chunk):
        ahead = {v: t for v, t in reversed(following)}
        best = []
        for v, t, r in zip(reversed(chunk[value].tolist()), reversed(chunk["us"].tolist()), reversed(chunk["rank"].tolist())):
            ahead.pop(v, None)
            ahead[v] = t
            if len(ahead) > k:
                del ahead[next(iter(ahead))]
            if len(ahead) == k and next(iter(ahead.values())) - t <= width_us:
                best = [r]
        return best

    per_chunk = fold_chunks(
        rows.select(*keys, "rank", "us", value), keys, summarise, nearest, emit, [], reverse=True, chunk_rows=chunk_rows)
    return per_chunk.groupBy(*keys).agg(F.min("rank").alias("rank"))


def next_mark(rows: DataFrame, marks: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add mark: the smallest marked rank of the key at or after the row's rank; rows behind the last mark drop out.

    Inside a chunk this is a running minimum; what lies beyond the chunk is its successors' first mark.
    """
    part = [*keys, "__chunk"]
    chunk = F.expr(f"(rank - 1) div {chunk_rows}")
    marked = rows.join(marks.select(*keys, "rank", F.col("rank").alias("__own")), [*keys, "rank"], "left") \
        .withColumn("__chunk", chunk)
    ahead = Window.partitionBy(*part).orderBy(F.col("rank").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present_chunks = rows.select(*keys, chunk.alias("__chunk")).groupBy(*part).agg(F.lit(1).alias("__one"))
    later = Window.partitionBy(*keys).orderBy(F.col("__chunk").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    beyond = (
        present_chunks
        .join(marks.withColumn("__chunk", chunk).groupBy(*part).agg(F.min("rank").alias("__first")), part, "left")
        .select(*part, F.min("__first").over(later).alias("__beyond"))
    )
    return (
        marked.withColumn("__here", F.min("__own").over(ahead))
        .join(beyond, part)
        .withColumn("mark", F.coalesce("__here", "__beyond"))
        .filter("mark IS NOT NULL")
        .drop("__own", "__chunk", "__here", "__beyond")
    )


def rows_in_spans(spans: DataFrame, rows: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Rows inside each span [lo_us, hi_us] that do not precede (lo_us, lo_seq); no span is wider than width_us.

    An equi-join on (key, time bucket): a span touches at most two buckets, a row lies in one.
    """
    bucketed = rows.withColumn("__bucket", F.expr(f"us div {width_us}"))
    probes = spans.withColumn(
        "__bucket", F.explode(F.expr(f"array_distinct(array(lo_us div {width_us}, hi_us div {width_us}))")))
    inside = (
        F.col("us").between(F.col("lo_us"), F.col("hi_us"))
        & ((F.col("us") > F.col("lo_us")) | (F.col("seq") >= F.col("lo_seq")))
    )
    return bucketed.join(probes, [*keys, "__bucket"]).filter(inside).drop("__bucket", "lo_us", "hi_us", "lo_seq")


def range_blocks(first: Column, last: Column) -> Column:
    """The ranks first to last as an array of (level, block): few whole blocks of 2^level ranks, two of a level at most."""
    top = F.floor(F.log2((last - first + 1).cast("double"))).cast("int")

    def whole(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.call_function("div", first - 1 + size - 1, size), F.call_function("div", last, size)
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), whole)))


def blocks_of(rank: Column, top: Column) -> Column:
    """The blocks of levels 0 to top that hold a rank."""
    return F.transform(F.sequence(F.lit(0), top), lambda level: F.struct(
        level.alias("level"), F.call_function("shiftright", rank - 1, level).alias("block")))


def rows_in_ranges(spans: DataFrame, rows: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """Rows ranked first to last of every span (key, mark, first, last), or only the `first` ones of it.

    Joined by equal blocks of ranks, so that only rows inside are compared.
    """
    if first is not None:
        ranks = F.sequence("first", F.least("last", F.col("first") + first - 1))
        return spans.select(key, "mark", F.explode(ranks).alias("rank")).join(rows, [key, "rank"])
    parts, held = by_blocks(spans, rows, key)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few rows that make many are not put together
    return held.repartition(tasks, key, "__part").join(parts, [key, "__part"]).drop("__part")


def firsts_in_spans(spans: DataFrame, values: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Spans (key, first, last, ...) beside every value that their rows hold, once, with the value's first row in the span.

    values: (key, kind, value, rank, ...). A row is its value's first one in the spans that begin behind the value's row
    before it, but not behind itself. That is a range of first ranks, joined by whole blocks, so what the join makes is the
    result: nothing as large as spans times values is exchanged or summed up. Spans also meet rows behind their last rank,
    as far as the longest span would reach. Rows before a chunk of ranks are known by the last of each value in it.
    """
    part = [key, "kind", "value"]
    placed = values.withColumn("__chunk", F.expr(f"(rank - 1) div {chunk_rows}"))
    ends = placed.groupBy(*part, "__chunk").agg(F.max("rank").alias("__end"))
    earlier = ends.select(*part, "__chunk", F.lag("__end").over(Window.partitionBy(*part).orderBy("__chunk")).alias("__earlier"))
    before = F.lag("rank").over(Window.partitionBy(*part, "__chunk").orderBy("rank"))
    longest = F.broadcast(spans.agg(F.max(F.col("last") - F.col("first") + 1).alias("__longest")))  # one row
    low = F.greatest(F.coalesce("__before", "__earlier", F.lit(0)) + 1, F.col("rank") - F.col("__longest") + 1)
    rows = (
        placed.withColumn("__before", before).join(earlier, [*part, "__chunk"]).crossJoin(longest)
        .withColumn("__part", F.explode(range_blocks(low, F.col("rank"))))
        .drop("__chunk", "__before", "__earlier", "__longest"))
    top = F.floor(F.log2(F.col("__longest").cast("double"))).cast("int")
    begun = spans.crossJoin(longest).withColumn("__part", F.explode(blocks_of(F.col("first"), top))).drop("__longest")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few rows that make many are not put together
    return rows.repartition(tasks, key, "__part").join(begun, [key, "__part"]).filter("rank <= last").drop("__part")


def by_blocks(spans: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of every span (key, mark, __part), and the rows once per block of the levels in use, with __part.

    A span has two blocks a level at most and a row one, so neither grows with how far spans overlap.
    """
    parts = spans.select(key, "mark", F.explode(range_blocks(F.col("first"), F.col("last"))).alias("__part"))
    used = parts.agg(F.max("__part.level").alias("__top"))
    held = rows.crossJoin(F.broadcast(used)).withColumn("__part", F.explode(blocks_of(F.col("rank"), F.col("__top"))))  # one row
    return parts, held.drop("__top")
