"""Ordered per-key rules: one step function each, shared by the batch replay and the stream.

A step gets the state of its key and one row, changes the state in place and
returns the decision. States are small (a window of stamps, a few counters), so
memory does not grow with the number of rows of a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.scan import join_same, running

# ---- Fixed values ------------------------------------------------------------
WINDOW_MS = 60_000
IDLE_MS = 5 * 60_000
GENERAL_LIMIT, UPLOAD_LIMIT = 20, 10
REGISTER_LIMIT, LOGIN_LIMIT = 3, 10
MAX_FAILS, LOCK_MS, FAIL_TTL_MS = 5, 15 * 60_000, 10 * 60_000
BREAKERS = {"qa": (3, 60_000), "vlm_ingest": (5, 120_000)}
THROTTLE_MS = 1_000
TURNS = 5
SEM_SIM, SEM_CAP, SEM_EVICT, SEM_KEY_CHARS = 0.95, 500, 0.2, 60
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """``step(state, row) -> tuple`` in the order of ``out``; the state is a JSON-able dict."""

    out: list[StructField]
    step: Callable[[dict, object], tuple]
    initial: dict = field(default_factory=dict)

    def fresh(self) -> dict:
        return json.loads(json.dumps(self.initial))

    def run(self, state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        decided = [self.step(state, row) for row in rows.itertuples(index=False)]
        extra = pd.DataFrame(decided, columns=[f.name for f in self.out], index=rows.index)
        return pd.concat([rows, extra], axis=1)


def _admit(stamps: list[int], now: int, limit: int) -> bool:
    """Sliding log: stamps older than a minute leave, a refused event is not recorded."""
    while stamps and now - stamps[0] > WINDOW_MS:
        stamps.pop(0)
    if len(stamps) >= limit:
        return False
    stamps.append(now)
    return True


def rate_limit(limit: int = GENERAL_LIMIT) -> Fold:
    """STR-1: at most ``limit`` events a minute per key."""
    return Fold([StructField("allowed", BooleanType())],
                lambda s, r: (_admit(s["stamps"], r.ts_ms, limit),), {"stamps": []})


def login_guard() -> Fold:
    """STR-3: one gateway's guard over ``ip``, ``name`` and ``action`` (register, success, failure).

    A locked name is turned away before the address window is looked at. Five
    failures in a row lock a name for 15 minutes; success clears it; a count is
    forgotten ten minutes after its last failure.
    """
    def step(s: dict, r) -> tuple:
        now, stamps = r.ts_ms, s["ips"].setdefault(r.ip, [])
        if r.action == "register":
            return ("registered" if _admit(stamps, now, REGISTER_LIMIT) else "rate_limited",)
        until = s["locked"].get(r.name)
        if until is not None:
            if now < until:
                return ("locked",)
            del s["locked"][r.name]
            s["fails"].pop(r.name, None)
        if not _admit(stamps, now, LOGIN_LIMIT):
            return ("rate_limited",)
        if r.action == "success":
            s["fails"].pop(r.name, None)
            return ("success",)
        count, last = s["fails"].get(r.name, (0, now))
        count = 1 if now - last > FAIL_TTL_MS else count + 1
        if count >= MAX_FAILS:
            s["locked"][r.name] = now + LOCK_MS
            count = 0
        s["fails"][r.name] = (count, now)
        return ("failure",)
    return Fold([StructField("verdict", StringType())], step, {"ips": {}, "fails": {}, "locked": {}})


def breaker(threshold: int = BREAKERS["qa"][0], recovery_ms: int = BREAKERS["qa"][1]) -> Fold:
    """STR-5: circuit breaker; ``ok`` is the outcome of a call that was let through."""
    def step(s: dict, r) -> tuple:
        if s["mode"] == "open" and r.ts_ms - s["at"] >= recovery_ms:
            s["mode"] = "half_open"
        before = s["mode"]
        if before == "open":
            return (False, before, s["mode"])
        if r.ok:
            s["mode"], s["fails"] = "closed", 0
        else:
            s["fails"], s["at"] = s["fails"] + 1, r.ts_ms
            if before == "half_open" or s["fails"] >= threshold:
                s["mode"] = "open"
        return (True, before, s["mode"])
    out = [StructField("allowed", BooleanType()), StructField("state_before", StringType()), StructField("state_after", StringType())]
    return Fold(out, step, {"mode": "closed", "fails": 0, "at": 0})


def throttle(every_ms: int = THROTTLE_MS) -> Fold:
    """STR-7: keep forced rows and rows at least a second after the last one kept."""
    def step(s: dict, r) -> tuple:
        keep = bool(r.forced) or s["at"] is None or r.ts_ms - s["at"] >= every_ms
        if keep:
            s["at"] = r.ts_ms
        return (keep,)
    return Fold([StructField("kept", BooleanType())], step, {"at": None})


def turn_trigger(every: int = TURNS) -> Fold:
    """STR-6: true on every fifth turn."""
    def step(s: dict, r) -> tuple:
        s["n"] += 1
        return (s["n"], s["n"] % every == 0)
    return Fold([StructField("turn", LongType()), StructField("due", BooleanType())], step, {"n": 0})


def token_budget(limit: int, day: str | None = None) -> Fold:
    """STR-4: allowed while the sum of the day before this event is under the limit; keyed by user and day.

    With ``day``, the column of the day, keyed by user alone: a stream then pays once per user for reading and
    writing a state, not once per user and day.
    """
    def step(s: dict, r) -> tuple:
        used = s["used"]
        s["used"] += max(0, r.tokens)
        return (used, used < limit)

    def step_of_day(s: dict, r) -> tuple:
        name = str(getattr(r, day))
        used = s["used"].get(name, 0)
        s["used"][name] = used + max(0, r.tokens)
        return (used, used < limit)

    out = [StructField("used_before", LongType()), StructField("allowed", BooleanType())]
    return Fold(out, step_of_day if day else step, {"used": {}} if day else {"used": 0})


def semantic_cache(cap: int = SEM_CAP, min_sim: float = SEM_SIM) -> Fold:
    """STR-11: look a question up, refresh the entry on a hit, else store it, dropping the oldest fifth when full."""
    def step(s: dict, r) -> tuple:
        import numpy as np
        entries = s["entries"]
        vec = np.asarray(r.embedding, dtype=np.float32)
        best, name = 0.0, None
        if entries:
            keys = list(entries)
            sims = np.asarray([entries[k]["v"] for k in keys], dtype=np.float32) @ vec
            at = int(sims.argmax())
            if sims[at] > best:
                best, name = float(sims[at]), keys[at]
        if name is not None and best >= min_sim:
            entries[name]["ts"] = r.ts_ms
            return (entries[name]["id"], len(entries))
        if len(entries) >= cap:
            oldest = sorted(entries, key=lambda k: entries[k]["ts"])
            for k in oldest[:max(1, int(len(entries) * SEM_EVICT))]:
                del entries[k]
        entries[f"{r.query[:SEM_KEY_CHARS]}:{len(r.query)}"] = {"id": int(r.id), "ts": int(r.ts_ms), "v": [float(x) for x in vec]}
        return (None, len(entries))
    return Fold([StructField("hit_id", LongType()), StructField("entries", LongType())], step, {"entries": {}})


# ---------------------------------------------------------------- batch replay

def quiet_segments(df: DataFrame, keys: list[str], quiet_ms: int) -> DataFrame:
    """Add ``segment``: stretches of a key with no event for longer than ``quiet_ms`` between them.

    Time is cut into bins of that length; a run of bins that hold events is one
    segment. Only distinct (key, bin) pairs are windowed, their number bounded by
    the time range, so a busy key splits into independent pieces of work.
    """
    binned = df.withColumn("_bin", F.floor(F.col("ts_ms") / quiet_ms))
    bins = binned.select(*keys, "_bin").distinct()
    island = bins.withColumn("segment", F.col("_bin") - F.row_number().over(W.partitionBy(*keys).orderBy("_bin")))
    return join_same(binned, island, [*keys, "_bin"]).select(*df.columns, "segment")


def reset_segments(df: DataFrame, keys: list[str], quiet_ms: int, block_ms: int = 86_400_000) -> DataFrame:
    """Add ``segment`` for the breaker: a new one after each success that came when any open state was over.

    Such a success leaves the state closed without failures, whatever was before.
    """
    block = F.floor(F.col("ts_ms") / block_ms)
    seen = running(df, keys, ["ts_ms", "id"], block, {"_prev": ("last", F.col("ts_ms"))}, inclusive=False)
    quiet = F.col("_prev").isNull() | (F.col("ts_ms") - F.col("_prev") >= quiet_ms)
    return running(seen.withColumn("_q", quiet), keys, ["ts_ms", "id"], block,
                   {"segment": ("count", F.when(F.col("_q") & F.col("ok"), 1))}, inclusive=False).drop("_prev", "_q")


def replay(df: DataFrame, fold: Fold, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Run a fold over every key in order.

    Rows are hashed by key and sorted; batches stream through the task with only
    the current state held, so the size of a key does not matter for memory.
    """
    order = order or ["ts_ms", "id"]
    schema = StructType(df.schema.fields + fold.out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, fold.fresh()
        for batch in batches:
            groups = batch.groupby(keys, sort=False, dropna=False)
            parts = []
            for key, rows in groups:
                if key != current:
                    current, state = key, fold.fresh()
                parts.append(fold.run(state, rows))
            if parts:
                yield pd.concat(parts)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
