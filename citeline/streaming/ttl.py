"""ST1: anchored TTL cache on a request stream.

With an event-time watermark the keys are dealt over ``GROUPS`` groups by their hash: a
micro-batch calls Python once per group, not once per key.  The state of a group is the
last successful cache write (anchor) of its keys and the requests that are still held: a request is
decided when the watermark has passed it, so requests that arrive out of order by less than
the watermark delay are folded in time order, with the same chain-jumping fold as the
batch operator.  Held requests wake their group by an event-time timeout.  An anchor is
dropped once the watermark passes ``anchor + TTL``: an
expired anchor decides exactly like no anchor, so the state stays bounded by the
requests of one delay and the keys active within one TTL.

Without a watermark requests are decided as they come, in time order within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from citeline.operators.cache import NO_ANCHOR, TTL_HOURS, fold_key, to_micros

STATE_SCHEMA = "anchor_us long"
HELD_SCHEMA = "anchors binary, held binary"
GROUPS = 256
_US, _GROUP, _ANCHOR = "_us", "_group", "_anchor"


def _pack(frame: pd.DataFrame) -> bytes:
    """Requests as an Arrow stream, for the state."""
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def ttl_stream(requests: DataFrame, key: str, ts: str, req_id: str, ok: str,
               ttl_hours: float = TTL_HOURS, watermark: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Streaming S3: ``requests`` (a streaming DataFrame) -> requests with ``hit``.

    ``watermark`` (e.g. ``'1 hour'``) is how late a request may come; ``ts`` must then be
    a TIMESTAMP column (cast NTZ first).  Later ones are dropped by Spark.  A
    request is put out once the watermark has passed it.  ``groups`` is the number of
    states that keys are dealt over; a checkpoint keeps to the number it began with."""
    ttl_us = int(ttl_hours * 3600 * 1_000_000)
    out_schema = StructType.fromJson(requests.schema.jsonValue()).add("hit", "boolean")
    if not watermark:
        return requests.groupBy(key).applyInPandasWithState(
            _as_they_come(ts, req_id, ok, ttl_us), out_schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    # a null key has a group of its own: beside it, pandas would turn whole keys into floats
    group = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    timed = requests.withColumn(_US, F.unix_micros(ts)).withColumn(_GROUP, group).withWatermark(ts, watermark)
    return timed.groupBy(_GROUP).applyInPandasWithState(
        _in_time_order(key, req_id, ok, ttl_us), out_schema, HELD_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def _as_they_come(ts: str, req_id: str, ok: str, ttl_us: int):
    def fold(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values([ts, req_id], kind="stable")
        a0 = state.get[0] if state.exists else None
        hit, _, a = fold_key(to_micros(pdf[ts]), pdf[ok].to_numpy().astype(bool), a0, ttl_us)
        if a is not None:
            state.update((int(a),))
        yield pdf.assign(hit=hit)
    return fold


def _decide(due: pd.DataFrame, anchors: pd.DataFrame, key: str, req_id: str, ok: str, ttl_us: int):
    """Requests of many keys -> hits in their order, and the anchors of all keys after them."""
    codes, keys = pd.factorize(pd.concat([anchors[key], due[key]], ignore_index=True), use_na_sentinel=False)
    last = np.full(len(keys), NO_ANCHOR, np.int64)
    last[codes[:len(anchors)]] = anchors[_ANCHOR].to_numpy()
    due = due.assign(**{_GROUP: codes[len(anchors):]}).sort_values([_GROUP, _US, req_id], kind="stable")
    code, t, good = due[_GROUP].to_numpy(), due[_US].to_numpy().astype(np.int64), due[ok].to_numpy().astype(bool)
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    hit = np.zeros(len(due), bool)
    for s, e in zip(starts, np.append(starts[1:], len(due))):
        before = last[code[s]]
        hit[s:e], _, after = fold_key(t[s:e], good[s:e], None if before == NO_ANCHOR else int(before), ttl_us)
        if after is not None:
            last[code[s]] = after
    kept = last != NO_ANCHOR
    return due.drop(columns=[_US, _GROUP]).assign(hit=hit), pd.DataFrame({key: keys[kept], _ANCHOR: last[kept]})


def _in_time_order(key: str, req_id: str, ok: str, ttl_us: int):
    def fold(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        anchors, data = state.get if state.exists else (None, None)
        anchors = _unpack(anchors) if anchors else None
        held = [_unpack(data)] if data else []
        out = None
        if held and (held[0][_US] <= passed).any():     # no request up to the watermark can come any more
            due = held[0][held[0][_US] <= passed]
            held = [held[0][held[0][_US] > passed]]
            if anchors is None:
                anchors = pd.DataFrame({key: due[key].iloc[:0], _ANCHOR: np.zeros(0, np.int64)})
            out, anchors = _decide(due, anchors, key, req_id, ok, ttl_us)
        if not state.hasTimedOut:
            held += [pdf.drop(columns=_GROUP) for pdf in pdfs]      # all behind the watermark: Spark has dropped later ones
        rest = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if anchors is not None:
            anchors = anchors[anchors[_ANCHOR] + ttl_us > passed]
        live = anchors is not None and len(anchors) > 0
        if not len(rest) and not live:
            if state.exists:
                state.remove()
        else:
            wake = int(rest[_US].min()) if len(rest) else int(anchors[_ANCHOR].max()) + ttl_us
            state.update((_pack(anchors) if live else None, _pack(rest) if len(rest) else None))
            state.setTimeoutTimestamp(max(wake // 1000 + 1, passed // 1000 + 1))
        if out is not None:
            yield out
    return fold
