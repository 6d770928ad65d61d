"""Streams whose state has an end: jobs that nobody has heard of for long are reaped, what a song was last
told is forgotten, a median is kept for a while, and leases leave when they are out of date.

State is one row for each key, with a timer in event time; it goes when the watermark passes the timer.  A
key's rows of a micro-batch are gone through in order of time and number, and one that comes after the timer
finds no state, whether the watermark has passed yet or not: so results don't depend on how rows are cut
into batches.  Rows with a null key or time are left out; later than the watermark allows, too; repeated
rows are events; an empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lineweave.streaming.jobs import DAY, FINAL, HOUR, LATE, available, event_stream

#: How long a job may be silent, a song's last word is known, and a median is kept.
SILENT, KNOWN, FRESH = 2 * DAY, DAY, 18 * HOUR
#: How long a lease lasts after its last sign of life, and a job is remembered after its last event.
HELD, KEPT = 3 * DAY, 4 * DAY
#: How long a job waits for data that comes late.
PATIENCE = 8 * HOUR
#: Finished jobs that a median looks at.
LAST = 20
#: A step takes a key's state (None: none), kind, time, event and value to the new state, when it ends (None:
#: never), and rows; an end takes the state that has run out to rows.
Step = Callable[[tuple | None, str, int, int, float], tuple[tuple | None, int | None, list[tuple]]]
End = Callable[[tuple], list[tuple]]


def with_end(events: DataFrame, step: Step, end: End, out: str, state: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Rows (user_id, and what step and end give) of events (user_id, event_id, event_type, value, at), which
    have a watermark; with kinds, events of others are passed over.  ``state`` is the schema of the state; when
    it ends is kept beside it."""
    names = ["user_id", *(c.split()[0] for c in out.split(", "))]
    whole = {n: "Int64" for n, t in zip(names, ["long", *(c.split()[1] for c in out.split(", "))]) if t == "long"}

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        until, now = (held.get[0], tuple(held.get[1:])) if held.exists else (None, None)
        rows: list[tuple] = []
        if held.hasTimedOut:
            rows += end(now)
            now = None
        else:
            for kind, t, event, value in pd.concat(list(batches)).sort_values(["t", "event_id"])[["event_type", "t", "event_id", "value"]].itertuples(index=False):
                if kinds and kind not in kinds:
                    continue
                if now is not None and until is not None and t > until:
                    rows += end(now)
                    now = until = None
                now, until, new = step(now, kind, int(t), int(event), float(value))
                rows += new
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update((until, *now))
            if until is not None:  # in whole milliseconds, and not before the watermark
                held.setTimeoutTimestamp(max(until // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=names).astype(whole)

    rows = events.where("user_id IS NOT NULL AND at IS NOT NULL").select("user_id", "event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"), F.unix_micros("at").alias("t"), "at")
    return rows.groupBy("user_id").applyInPandasWithState(run, f"user_id long, {out}", f"until long, {state}", "append", GroupStateTimeout.EventTimeTimeout)


def reap(state, kind, t, event, value):
    """Claims (signup), signs of life (view) and ends (purchase) of a user's job."""
    if kind == "signup":
        return (event, t), t + SILENT, []
    if state is None or kind == "purchase":
        return None, None, []
    if kind == "view":
        return (state[0], t), t + SILENT, []
    return state, state[1] + SILENT, []


def reaped(state):
    return [(state[0], state[1], state[1] + SILENT)]


def remember(state, kind, t, event, value):
    """What was told last (click) is known to those who ask (view) until it is out of date."""
    if kind == "click":
        return (event, t), t + KNOWN, []
    answer = [(event, None if state is None else state[0])] if kind == "view" else []
    return state, None if state is None else state[1] + KNOWN, answer


def nothing(state):
    return []


def estimate(state, kind, t, event, value):
    """The median of the LAST durations (purchase), which those who ask (view) see as it was up to FRESH ago."""
    durations, kept, at = state or ([], None, None)
    durations, out = list(durations), []
    if kind == "purchase":
        durations = [*durations, value][-LAST:]
    elif kind == "view":
        fresh = at is not None and t - at < FRESH
        if not fresh and durations:
            kept, at = float(median(durations)), t
        out = [(event, kept if fresh or durations else None, fresh)]
    return ((durations, kept, at) if durations else None), None, out


def beat(state, kind, t, event, value):
    """A claim (signup) opens a lease and each heartbeat (view) lengthens it, unless it has run out or a cancel
    (error) has come; a heartbeat is told so, how many there were, and late data (purchase)."""
    until, cancelled, progress, meta = state or (None, False, 0, None)
    out = []
    if kind == "signup":
        until, cancelled, progress, meta = t + HELD, False, 0, None
    elif kind == "error":
        cancelled = True
    elif kind == "purchase":
        meta = event
    elif kind == "view":
        held = until is not None and t <= until
        if held and not cancelled:
            until, progress = t + HELD, progress + 1
        out.append((event, held, cancelled, progress, meta if held and not cancelled else None))
    return (until, cancelled, progress, meta), t + KEPT, out


def wait(state, kind, t, event, value):
    """A job (signup) waits for its late data (purchase), a cancel (error), or another job of the user."""
    out = []
    if state is not None and kind in ("purchase", "error", "signup"):
        out = [(state[0], event if kind == "purchase" else None, {"purchase": "met", "error": "cancelled", "signup": "without"}[kind])]
        state = None
    if kind == "signup":
        state = (event, t)
    return state, None if state is None else state[1] + PATIENCE, out


def gone_without(state):
    return [(state[0], None, "without")]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).withWatermark("at", LATE)


def reaper_stream(events: DataFrame) -> DataFrame:
    """user_id, job, last, reaped: jobs of which there was no sign for SILENT."""
    return with_end(events, reap, reaped, "job long, last long, reaped long", "job long, last long", ("signup", "view", "purchase"))


def memory_stream(events: DataFrame) -> DataFrame:
    """user_id, event_id, known: what each who asks is told."""
    return with_end(events, remember, nothing, "event_id long, known long", "told long, at long", ("click", "view"))


def estimate_stream(events: DataFrame) -> DataFrame:
    """user_id, event_id, eta, kept: what each who asks is told, and whether it is an earlier answer."""
    return with_end(events, estimate, nothing, "event_id long, eta double, kept boolean", "durations array<double>, value double, at long")


def heartbeat_stream(events: DataFrame) -> DataFrame:
    """user_id, event_id, held, cancelled, progress, meta: what each heartbeat is told."""
    return with_end(events, beat, nothing, "event_id long, held boolean, cancelled boolean, progress long, meta long", "lease long, cancelled boolean, progress long, meta long")


def late_data_stream(events: DataFrame) -> DataFrame:
    """user_id, job, data, outcome: what a job met while it waited, or that it goes on without."""
    return with_end(events, wait, gone_without, "job long, data long, outcome string", "job long, at long", ("signup", "purchase", "error"))


_ROWS = "e AS (SELECT user_id, event_id, event_type AS k, value, epoch_us(ts) AS t FROM events)"
QUERIES = {
    "stream_reaper": (
        lambda spark, d: available(reaper_stream(_events(spark, d))),
        f"WITH RECURSIVE {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e WHERE k IN ('signup', 'view', 'purchase')), f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS job, NULL::BIGINT AS last, NULL::BIGINT AS gone, NULL::BIGINT AS gone_at FROM r UNION ALL SELECT user_id, i, CASE WHEN k = 'signup' THEN event_id WHEN k = 'purchase' OR over THEN NULL ELSE job END, CASE WHEN k = 'signup' OR k = 'view' AND job IS NOT NULL AND NOT over THEN t END, CASE WHEN over THEN job END, CASE WHEN over THEN last END FROM (SELECT r.*, f.job, f.last, coalesce(r.t > f.last + {SILENT}, false) AS over FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)) SELECT user_id, gone AS job, gone_at AS last, gone_at + {SILENT} AS reaped FROM f WHERE gone IS NOT NULL UNION ALL SELECT user_id, job, last, last + {SILENT} FROM (SELECT user_id, max_by(job, i) AS job, max_by(last, i) AS last FROM (SELECT user_id, i, coalesce(job, -1) AS job, coalesce(last, -1) AS last FROM f) GROUP BY 1) WHERE job >= 0 AND (last + {SILENT}) // 1000 * 1000 + 1000 < {FINAL}",
    ),
    "stream_memory": (
        lambda spark, d: available(memory_stream(_events(spark, d))),
        f"WITH {_ROWS} SELECT user_id, event_id, CASE WHEN t - told.t <= {KNOWN} THEN told.event_id END AS known FROM (SELECT *, last_value(CASE WHEN k = 'click' THEN {{'t': t, 'event_id': event_id}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS told FROM e WHERE k IN ('click', 'view')) WHERE k = 'view'",
    ),
    "stream_estimates": (
        lambda spark, d: available(estimate_stream(_events(spark, d))),
        f"WITH RECURSIVE {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e WHERE k = 'view'), m AS (SELECT r.user_id, r.i, list_reverse_sort(list({{'t': p.t, 'id': p.event_id, 'v': p.value}}) FILTER (p.t IS NOT NULL))[:{LAST}] AS p FROM r LEFT JOIN e p ON p.user_id = r.user_id AND p.k = 'purchase' AND (p.t, p.event_id) < (r.t, r.event_id) GROUP BY 1, 2), n AS (SELECT r.*, list_median(list_transform(p, lambda x: x.v)) AS med FROM r JOIN m USING (user_id, i)), f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, NULL::BIGINT AS since, NULL::DOUBLE AS eta, false AS kept FROM n UNION ALL SELECT user_id, i, event_id, CASE WHEN fresh OR med IS NULL THEN value ELSE med END, CASE WHEN fresh OR med IS NULL THEN since ELSE t END, CASE WHEN fresh THEN value ELSE med END, fresh FROM (SELECT n.user_id, n.i, n.event_id, n.t, n.med, f.value, f.since, coalesce(n.t - f.since < {FRESH}, false) AS fresh FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)) SELECT user_id, event_id, eta, kept FROM f WHERE i > 0",
    ),
    "stream_late_data": (
        lambda spark, d: available(late_data_stream(_events(spark, d))),
        f"WITH {_ROWS}, n AS (SELECT *, lead(k) OVER w AS n_k, lead(t) OVER w AS n_t, lead(event_id) OVER w AS n_id FROM e WHERE k IN ('signup', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), a AS (SELECT user_id, event_id, t, coalesce(n_t <= t + {PATIENCE}, false) AS heard, n_k, n_id, n_t FROM n WHERE k = 'signup') SELECT user_id, event_id AS job, CASE WHEN heard AND n_k = 'purchase' THEN n_id END AS data, CASE WHEN heard AND n_k = 'purchase' THEN 'met' WHEN heard AND n_k = 'error' THEN 'cancelled' ELSE 'without' END AS outcome FROM a WHERE n_t IS NOT NULL OR (t + {PATIENCE}) // 1000 * 1000 + 1000 < {FINAL}",
    ),
    "stream_heartbeats": (
        lambda spark, d: available(heartbeat_stream(_events(spark, d))),
        f"WITH RECURSIVE r AS (SELECT user_id, event_id, event_type AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS k, NULL::BIGINT AS t, NULL::BIGINT AS lease, false AS cancelled, 0::BIGINT AS progress, NULL::BIGINT AS meta, false AS held FROM r UNION ALL SELECT user_id, i, event_id, k, t, CASE WHEN k = 'signup' OR k = 'view' AND t <= lease AND NOT cancelled THEN t + {HELD} ELSE lease END, CASE k WHEN 'signup' THEN false WHEN 'error' THEN true ELSE cancelled END, CASE WHEN k = 'signup' THEN 0 WHEN k = 'view' AND t <= lease AND NOT cancelled THEN progress + 1 ELSE progress END, CASE k WHEN 'signup' THEN NULL WHEN 'purchase' THEN event_id ELSE meta END, coalesce(t <= lease, false) FROM (SELECT r.*, CASE WHEN r.t <= f.t + {KEPT} THEN lease END AS lease, CASE WHEN r.t <= f.t + {KEPT} THEN cancelled ELSE false END AS cancelled, CASE WHEN r.t <= f.t + {KEPT} THEN progress ELSE 0 END AS progress, CASE WHEN r.t <= f.t + {KEPT} THEN meta END AS meta FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)) SELECT user_id, event_id, held, cancelled, progress, CASE WHEN held AND NOT cancelled THEN meta END AS meta FROM f WHERE k = 'view'",
    ),
}
