"""Quantities recorded in different units: a hidden Markov model per device, decoded by Viterbi.

The hidden state of a device is the unit its bare figures are in. Under each state a record has its likeliest own
unit: what the value, a remark or the device's note state are emissions (a statement that is passed over costs
much), the figure itself is another (how often figures of that size are written in that unit, learnt from all
records that state one), and to depart from the device's unit costs something. From one record to the next a
switch of units costs, and so does a jump of the log-value against the level the record before stood at.

Costs add along a chain and the best way through a stretch is a table of state by state, so stretches are worked on
apart: every task sums its stretch up as one table, the driver strings the tables together (one row a task) and
every task then decodes its stretch between the two states that are right for its ends. The result is that of one
Viterbi pass over each device, however many tasks its records lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.functions.units import KMH_PER_UNIT
from lanternway.runtime import Scratch

UNITS = list(KMH_PER_UNIT)
STATES = len(UNITS)
LOG_FACTOR = np.log([float(f) for f in KMH_PER_UNIT.values()])
#: Costs in nats. A statement outweighs all that can speak against it: two switches, two jumps, a departure and a figure.
WRITTEN, NOTED, SAID = 800.0, 300.0, 90.0
SWITCH, DEPART, MOST_JUMP, MOST_FIGURE = 20.0, 12.0, 6.0, 10.0
#: Level and spread of speeds in log km/h where nothing is learnt, and how many records that counts for.
LEVEL, LEVEL_SPREAD, PRIOR = float(np.log(40.0)), 1.0, 20.0
#: Spread of the level from record to record where too few pairs of records tell it, and the least there is.
SPREAD, LEAST_SPREAD, LEAST_PAIRS = 0.4, 0.05, 30
#: Figures are counted by their logarithm in steps of a hundredth, between these bounds.
STEP, LOWEST, HIGHEST = 0.01, -8.0, 16.0
#: Records of a task: a stretch is held as arrays.
STRETCH = 500_000
_BLOCK = 64


class Model:
    """Costs of the model; ``figure`` is a table of unit by step of the log-figure. A switch may cost less than SWITCH, but not more."""

    def __init__(self, counts: np.ndarray | None = None, spread: float = SPREAD, switch: float = SWITCH):
        grid = LOWEST + STEP * np.arange(int((HIGHEST - LOWEST) / STEP) + 1)
        level = grid[None, :] + LOG_FACTOR[:, None]
        prior = STEP * np.exp(-((level - LEVEL) ** 2) / (2 * LEVEL_SPREAD**2)) / (LEVEL_SPREAD * np.sqrt(2 * np.pi)) + 1e-12
        seen = np.zeros_like(prior) if counts is None else counts
        cost = -np.log((seen + PRIOR * prior) / (seen.sum(axis=1, keepdims=True) + PRIOR))
        self.figure = np.minimum(cost - cost.min(axis=0), MOST_FIGURE)
        self.spread, self.switch = spread, switch

    def emissions(self, log_value: np.ndarray, written: np.ndarray, noted: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, unit, level) by record and state; statements are numbers of units, -1 for none."""
        own = self.figure[:, figure_step(log_value)].T.copy()
        for stated, strength in ((written, WRITTEN), (noted, NOTED), (said, SAID)):
            own += strength * ((stated >= 0)[:, None] & (stated[:, None] != np.arange(STATES)))
        best = own.argmin(axis=1)
        apart = own.min(axis=1)[:, None] + DEPART
        unit = np.where(own <= apart, np.arange(STATES), best[:, None])
        return np.minimum(own, apart), unit, log_value[:, None] + LOG_FACTOR[unit]

    def step(self, before: np.ndarray, level: np.ndarray, cost: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tables (n, from, to) of moving from records at levels ``before`` to ones at ``level``; none binds the first of a chain."""
        jump = np.minimum((level[:, None, :] - before[:, :, None]) ** 2 / (2 * self.spread**2), MOST_JUMP)
        return np.where(first[:, None, None], 0.0, jump + self.switch * (1 - np.eye(STATES))) + cost[:, None, :]


def figure_step(log_value: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log_value - LOWEST) / STEP), 0, int((HIGHEST - LOWEST) / STEP)).astype(np.int64)


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best way through two stretches one after the other."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


class Stretch:
    """Consecutive records as arrays, cut into blocks of equal length that are worked on side by side."""

    def __init__(self, model: Model, cost: np.ndarray, level: np.ndarray, first: np.ndarray, before: np.ndarray):
        n = len(cost)
        self.n, self.model = n, model
        self.blocks = -(-n // _BLOCK)
        pad = self.blocks * _BLOCK - n
        # Padding keeps the last state for nothing.
        self.cost, self.level, self.first = cost, level, first
        self.before = np.concatenate([before[None, :], level[:-1]])
        self.index = np.concatenate([np.arange(n), np.full(pad, n, np.int64)]).reshape(self.blocks, _BLOCK)

    def _step(self, s: int) -> np.ndarray:
        at = self.index[:, s]
        real = at < self.n
        k = np.where(real, at, 0)
        table = self.model.step(self.before[k], self.level[k], self.cost[k], self.first[k])
        still = np.where(np.eye(STATES) > 0, 0.0, np.inf)
        return np.where(real[:, None, None], table, still)

    def tables(self) -> np.ndarray:
        """One table for each block."""
        out = self._step(0)
        for s in range(1, _BLOCK):
            out = _compose(out, self._step(s))
        return out

    def whole(self) -> np.ndarray:
        tables = self.tables()
        while len(tables) > 1:
            if len(tables) % 2:
                tables = np.concatenate([tables, np.where(np.eye(STATES) > 0, 0.0, np.inf)[None]])
            tables = _compose(tables[0::2], tables[1::2])
        return tables[0]

    def states(self, start: np.ndarray, last: int | None) -> np.ndarray:
        """The states of the best way; start: cost of each state before the first record, last: state of the last record where known."""
        tables = self.tables()
        costs = [start]
        for t in tables:
            costs.append((costs[-1][:, None] + t).min(axis=0))
        ends = np.empty(self.blocks, np.int64)
        starts = np.empty(self.blocks, np.int64)
        at = int(costs[-1].argmin()) if last is None else last
        for b in range(self.blocks - 1, -1, -1):
            ends[b] = at
            at = int((costs[b] + tables[b][:, at]).argmin())
            starts[b] = at
        cost = np.where(np.arange(STATES) == starts[:, None], 0.0, np.inf)
        back = np.empty((_BLOCK, self.blocks, STATES), np.int8)
        for s in range(_BLOCK):
            way = cost[:, :, None] + self._step(s)
            back[s] = way.argmin(axis=1)
            cost = way.min(axis=1)
        out = np.empty((self.blocks, _BLOCK), np.int64)
        now, every = ends, np.arange(self.blocks)
        for s in range(_BLOCK - 1, -1, -1):
            out[:, s] = now
            now = back[s][every, now]
        return out.reshape(-1)[: self.n]


def viterbi(model: Model, log_value: np.ndarray, written: np.ndarray, noted: np.ndarray, said: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The unit of each record of a sequence of chains; ``first`` marks where a chain begins. Ties go to the unit listed first."""
    if not len(log_value):
        return np.empty(0, np.int64)
    cost, unit, level = model.emissions(log_value, written, noted, said)
    begins = first.copy()
    begins[0] = True
    states = Stretch(model, cost, level, begins, level[0]).states(np.zeros(STATES), None)
    return unit[np.arange(len(unit)), states]


_CHAIN = "device string, at timestamp, ref_table string, record_id long, number string, log_value double, written int, noted int, said int"
_SUMMED = f"{_CHAIN}, part int, pos long, summary array<double>"


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [pdf[c].to_numpy(t) for c, t in (("log_value", float), ("written", np.int64), ("noted", np.int64), ("said", np.int64))]


def _string_together(rows: list, model: Model) -> dict[int, tuple[np.ndarray, int | None, np.ndarray, int | None]]:
    """For each part: (cost of each state before it, level of the record before by state, its last state).

    rows: (part, device it begins with, device it ends with, first record's cost and level by state, last record's level
    by state, table from the first record's state to the last's), in order. One row a task.
    """
    costs, tables = [np.zeros(STATES)], []
    for k, (_, head, _, cost, level, _, inner) in enumerate(rows):
        goes_on = k > 0 and rows[k - 1][2] == head
        into = model.step((rows[k - 1][5] if k else level)[None], level[None], cost[None], np.array([not goes_on]))[0]
        tables.append(_compose(into, inner))
        costs.append((costs[-1][:, None] + tables[-1]).min(axis=0))
    out, at = {}, int(costs[-1].argmin())
    for k in range(len(rows) - 1, -1, -1):
        last = at
        at = int((costs[k] + tables[k][:, at]).argmin())
        goes_on = k > 0 and rows[k - 1][2] == rows[k][1]
        out[rows[k][0]] = (np.where(np.arange(STATES) == at, 0.0, np.inf), goes_on, rows[k - 1][5] if k else rows[k][4], last)
    return out


def learn(rows: DataFrame) -> Model:
    """Model of the figures of each unit and of the level's spread, from all records that state a unit.

    rows: device, at, log_value, written, noted, said. Two bounded tables reach the driver: units by steps, one number.
    """
    stated = F.when(F.col("written") >= 0, F.col("written")).when(F.col("noted") >= 0, F.col("noted")).otherwise(F.col("said"))
    known = rows.withColumn("u", stated).where("u >= 0")
    last = int((HIGHEST - LOWEST) / STEP)
    step = F.greatest(F.lit(0), F.least(F.lit(last), F.rint((F.col("log_value") - LOWEST) / STEP).cast("int")))
    counts = np.zeros((STATES, last + 1))
    for r in known.groupBy("u", step.alias("k")).count().collect():
        counts[r["u"], r["k"]] = r["count"]
    factor = F.element_at(F.array(*[F.lit(float(f)) for f in LOG_FACTOR]), F.col("u") + 1)
    level = known.select("device", F.to_date("at").alias("day"), (F.col("log_value") + factor).alias("x"))
    days = level.groupBy("device", "day").agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("v")).where("n > 1")
    got = days.agg(F.sum(F.col("n") - 1).alias("n"), F.sum((F.col("n") - 1) * F.col("v")).alias("v")).first()
    spread = max(LEAST_SPREAD, float(np.sqrt(2 * got["v"] / got["n"]))) if got["n"] and got["n"] >= LEAST_PAIRS else SPREAD
    return Model(counts, spread)


def decode_units(records: DataFrame, model: Model | None = None) -> DataFrame:
    """The unit of each record that states a positive number.

    records: ref_table, record_id, device, at TIMESTAMP, number DECIMAL, written, noted, said (units as keys of
    KMH_PER_UNIT, or null). All records of a device are one chain in order of time, whatever number of tasks they
    lie in. Of statements the one in the value goes before the one noted with the record, and that before what
    is said of the device. Rows without a positive number or an id come to nothing; repeated rows count once; records
    without device form one chain; null times come first; ties in time go by record. An empty table
    gives no rows. model: the costs; learnt from the records themselves if none is given.
    Result: ref_table, record_id, number, unit.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "units")
    names = F.array(*[F.lit(u) for u in UNITS])
    code = lambda c: F.coalesce(F.array_position(names, F.col(c)) - 1, F.lit(-1)).cast("int").alias(c)
    rows = records.where("number > 0 and record_id is not null").select(
        F.coalesce("device", F.lit("")).alias("device"), "at", "ref_table", "record_id", F.col("number").cast("string").alias("number"),
        F.log(F.col("number").cast("double")).alias("log_value"), code("written"), code("noted"), code("said"),
    ).distinct()
    rows = scratch.keep(rows)
    model = model or learn(rows)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // STRETCH))
    order = ["device", "at", "ref_table", "record_id", "number", "written", "noted", "said"]
    columns = [c.split()[0] for c in _CHAIN.split(", ")]

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, pos, table = TaskContext.get().partitionId(), 0, None
        head = tail = None
        for pdf in batches:
            if not len(pdf):
                continue
            cost, _, level = model.emissions(*_arrays(pdf))
            device = pdf["device"].to_numpy()
            first = np.r_[False if head is None else device[0] != tail[0], device[1:] != device[:-1]]
            if head is None:
                head = (device[0], cost[0], level[0])
                inner = Stretch(model, cost[1:], level[1:], first[1:], level[0]).whole() if len(pdf) > 1 else np.where(np.eye(STATES) > 0, 0.0, np.inf)
            else:
                inner = Stretch(model, cost, level, first, tail[1]).whole()
            table = inner if table is None else _compose(table, inner)
            tail = (device[-1], level[-1])
            yield pdf.assign(part=part, pos=np.arange(pos, pos + len(pdf)), summary=None)
            pos += len(pdf)
        if head is not None:
            numbers = np.concatenate([head[1], head[2], tail[1], table.reshape(-1)])
            yield pd.DataFrame({c: [None] for c in columns} | {"part": [part], "pos": [-1], "device": [head[0]], "ref_table": [tail[0]], "summary": [numbers.tolist()]})

    ordered = rows.repartitionByRange(n, *order[:5]).sortWithinPartitions(*order).select(*columns)
    summed = scratch.keep(ordered.mapInPandas(sum_up, _SUMMED))
    ends = []
    for r in summed.where("pos = -1").select("part", "device", F.col("ref_table").alias("tail"), "summary").orderBy("part").collect():  # a row a task
        x = np.array(r["summary"])
        ends.append((r["part"], r["device"], r["tail"], x[:STATES], x[STATES : 2 * STATES], x[2 * STATES : 3 * STATES], x[3 * STATES :].reshape(STATES, STATES)))
    around = spark.sparkContext.broadcast(_string_together(ends, model) if ends else {})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def stretch() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            start, goes_on, before, last = around.value[int(pdf["part"].iloc[0])]
            cost, unit, level = model.emissions(*_arrays(pdf))
            device = pdf["device"].to_numpy()
            first = np.r_[not goes_on, device[1:] != device[:-1]]
            states = Stretch(model, cost, level, first, before).states(start, last)
            return pdf[["ref_table", "record_id", "number"]].assign(unit=np.array(UNITS)[unit[np.arange(len(unit)), states]])

        for pdf in batches:
            cuts = np.flatnonzero(np.diff(pdf["part"].to_numpy())) + 1
            for piece in np.split(np.arange(len(pdf)), cuts):
                if len(piece) and held and held[-1]["part"].iloc[-1] != pdf["part"].iloc[piece[0]]:
                    yield stretch()
                    held.clear()
                if len(piece):
                    held.append(pdf.iloc[piece])
        if held:
            yield stretch()

    whole = summed.where("pos >= 0").select(*columns, "part", "pos").repartition(n, "part").sortWithinPartitions("part", "pos")
    out = whole.mapInPandas(decode, "ref_table string, record_id long, number string, unit string")
    return out.select("ref_table", "record_id", F.col("number").cast("decimal(18,6)").alias("number"), "unit")
