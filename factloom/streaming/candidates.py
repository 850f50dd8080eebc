"""The life of a candidate as keyed state: observations in order of event time, and deadlines between them.

`lives` works it out for whole tables with windows; `follow` keeps it in a stream, with
value, list and map state and event-time timers. Both give the same rows, in whatever
order and however often observations arrive.

A candidate begins with its first lead. An observation key counts once, at its earliest time. What is known
of its publication is what the first lead says that says anything. Its life ends, and it is a tombstone, at the first of

- the end of quarantine, a week after it was first seen, if no publication date is known by then;
- the first day, in Tokyo, on which its date is out of the retention window of six months;
- a lead that says it is published in the future.

After the end, observations move last_seen_at and nothing else. Without an official origin a candidate is stale
once nobody has seen it for more than 30 days; it stays so, though it may be seen again.
Of the texts the longest stays, of URLs the first, of origins the strongest, of priorities the most urgent; a place
in Japan stays, else the latest place. A presence counts as an observation and brings
no values; before the first lead it is nothing, though its key is used up.

Events have identity, observation_key, ts (a timestamp with zone), kind (lead or presence), origin, company, title,
official_url, priority, location_state, published_on (a date) and authoritative (whether a finished run vouches for it);
any but identity, observation_key, ts and kind may be null.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.functions.dates import GRACE_DAYS, RETENTION_MONTHS
from factloom.streaming.state import ORIGINS

EVENT = "identity string, observation_key string, ts timestamp, kind string, origin string, company string, title string, official_url string, priority string, location_state string, published_on date, authoritative boolean"
LIFE = (
    "identity string, state string, reason string, ended_at timestamp, stale_at timestamp, observation_count long, first_seen_at timestamp, last_seen_at timestamp, last_authoritative_seen_at timestamp, "
    "origin string, company string, title string, official_url string, priority string, location_state string, published_on date"
)
#: Days after which a candidate of no official origin is stale.
STALE_DAYS = 30
DAY, TOKYO = 86_400_000_000, 9 * 3_600_000_000
OLD, FUTURE, UNKNOWN = "published_older_than_retention_window", "published_in_future", "publication_date_unknown_after_grace"
FIELDS = ("origin", "company", "title", "official_url", "priority", "location_state", "published_on", "authoritative")


# --- whole tables ---------------------------------------------------------------------------------------------


def _tokyo_day(us: Column) -> Column:
    return F.date_from_unix_date(F.floor((us + TOKYO) / DAY).cast("int"))


def _out_of_window(published: Column) -> Column:
    """Microseconds at which the first Tokyo day begins whose window of retention no longer has the date."""
    first = F.date_add(F.add_months(published, RETENTION_MONTHS), 1)
    # at most three days later, where the month before is shorter
    day = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.date_add(first, i)), lambda d: F.add_months(d, -RETENTION_MONTHS) > published), 0)
    return F.unix_date(day).cast("long") * DAY - TOKYO


def _time(us: Column) -> Column:
    return F.timestamp_micros(us)


def lives(events: DataFrame, as_of: Column, stored: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Candidates (LIFE) as they stand at a time, from all events up to it; one shuffle by identity and key, one by identity.

    stored: what `lives` gave for an earlier time, of which events are all after; known: identity and observation_key that it counted.
    An identity is worked out by windows over its distinct observations, which Spark streams and spills; it is no group in memory.
    An empty table gives an empty table; an identity with presences alone is no candidate.
    """
    until = F.unix_micros(as_of.cast("timestamp"))
    at = F.unix_micros("ts")
    rows = events.where(at <= until).select("identity", "observation_key", F.struct(at.alias("at"), (F.col("kind") == "presence").cast("int").alias("presence"), *FIELDS).alias("x"))
    if known is not None:
        rows = rows.join(known.select("identity", "observation_key"), ["identity", "observation_key"], "left_anti")
    once = rows.groupBy("identity", "observation_key").agg(F.min("x").alias("x")).select("identity", "observation_key", "x.*")
    none = F.lit(None).cast("long")
    once = once.select(F.lit(1).alias("ord"), "*", F.lit(1).cast("long").alias("n"), F.col("at").alias("first"), F.when(F.col("authoritative"), F.col("at")).alias("auth"), none.alias("ended"), F.lit(None).cast("string").alias("reason"), none.alias("stale"))
    if stored is not None:
        us = lambda c: F.unix_micros(c)
        before = stored.select(
            F.lit(0).alias("ord"), "identity", F.lit("").alias("observation_key"), us("last_seen_at").alias("at"), F.lit(0).alias("presence"), *[c for c in FIELDS if c != "authoritative"], F.lit(False).alias("authoritative"),
            F.col("observation_count").alias("n"), us("first_seen_at").alias("first"), us("last_authoritative_seen_at").alias("auth"), us("ended_at").alias("ended"), "reason", us("stale_at").alias("stale"))
        once = once.unionByName(before)
    whole = Window.partitionBy("identity")
    order = whole.orderBy("ord", "at", "presence", "observation_key")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.min(F.when(F.col("ord") == 0, F.lit(-(1 << 62))).when(F.col("presence") == 0, F.col("at"))).over(whole)
    seen = once.withColumn("begun", begun).where(F.col("at") >= F.col("begun"))
    official = F.max((F.coalesce("origin", F.lit("")) == "official_collection").cast("int")).over(run)
    seen = seen.withColumns({"known_on": F.first("published_on", ignorenulls=True).over(run), "official": official, "begin": F.min("first").over(whole), "next": F.coalesce(F.lead("at").over(order), until), "last": F.lead("at").over(order).isNull(), "i": F.row_number().over(order), "was": F.max("ended").over(whole), "had": F.max("reason").over(whole)})
    future = F.coalesce(F.col("known_on") > _tokyo_day(F.col("at")), F.lit(False))
    due = F.when(F.col("known_on").isNull(), F.col("begin") + GRACE_DAYS * DAY).otherwise(_out_of_window(F.col("known_on")))
    falls = F.when(future, F.col("at")).otherwise(F.greatest(due, "at"))
    why = F.when(future, FUTURE).when(F.col("known_on").isNull(), UNKNOWN).otherwise(OLD)
    fired = F.when(F.col("was").isNull() & (falls <= F.col("next")), F.struct(falls.alias("at"), F.col("i").alias("i"), why.alias("why")))
    ended = seen.withColumn("fired", F.min(fired).over(whole)).withColumns({"end": F.coalesce("was", F.col("fired.at")), "why": F.coalesce("had", F.col("fired.why"))})
    alive = (F.col("ord") == 0) | F.col("end").isNull() | (F.col("at") < F.col("end"))
    silent = F.col("at") + STALE_DAYS * DAY
    stale = F.when(alive & F.col("was").isNull() & (F.col("official") == 0) & (silent < F.col("next")) & (F.col("end").isNull() | (silent < F.col("end"))), silent)
    ended = ended.withColumns({"alive": alive, "silent": F.coalesce("stale", stale)})
    own = lambda c: F.when(F.col("alive"), c)
    place = F.struct("ord", "at", "presence", "observation_key")
    longest = lambda c: F.min_by(c, own(F.when(F.col(c).isNotNull(), F.struct((-F.char_length(c)).alias("l"), place.alias("p"))))).alias(c)
    rank = F.coalesce(*[F.when(F.col("origin") == k, v) for k, v in ORIGINS.items()], F.when(F.col("origin").isNotNull(), 0))
    japan = F.bool_or(own(F.col("location_state") == "japan"))
    latest = F.max_by("location_state", own(F.when((F.col("presence") == 0) & F.col("location_state").isNotNull(), place)))
    one = ended.groupBy("identity").agg(
        F.max("end").alias("end"), F.max("why").alias("why"), F.min("silent").alias("silent"), F.coalesce(F.sum(own(F.col("n"))), F.lit(0)).alias("observation_count"), F.min(own(F.col("first"))).alias("first"), F.max("at").alias("at"), F.max(own(F.col("auth"))).alias("auth"),
        F.max_by("origin", own(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("origin"))))).alias("origin"), longest("company"), longest("title"), F.min_by("official_url", own(F.when(F.col("official_url").isNotNull(), place))).alias("official_url"),
        F.min(own(F.col("priority"))).alias("priority"), F.when(japan, "japan").otherwise(latest).alias("location_state"), F.min_by("published_on", own(F.when(F.col("published_on").isNotNull(), place))).alias("published_on"))
    state = F.when(F.col("end").isNotNull(), "tombstoned").when(F.col("silent").isNotNull(), "expired").when(F.col("published_on").isNull(), "quarantined").otherwise("admitted")
    return one.select("identity", state.alias("state"), F.col("why").alias("reason"), _time(F.col("end")).alias("ended_at"), _time(F.col("silent")).alias("stale_at"), "observation_count", _time(F.col("first")).alias("first_seen_at"), _time(F.col("at")).alias("last_seen_at"), _time(F.col("auth")).alias("last_authoritative_seen_at"),
                      "origin", "company", "title", "official_url", "priority", "location_state", "published_on")


# --- a stream -------------------------------------------------------------------------------------------------


def add_months(day: dt.date, months: int) -> dt.date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def out_of_window(published: dt.date) -> int:
    day = add_months(published, RETENTION_MONTHS) + dt.timedelta(days=1)
    while add_months(day, -RETENTION_MONTHS) <= published:
        day += dt.timedelta(days=1)
    return (day - dt.date(1970, 1, 1)).days * DAY - TOKYO


def tokyo_day(us: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=(us + TOKYO) // DAY)


@dataclass(frozen=True)
class Life:
    """A candidate; times in microseconds. Advanced by `until` (time passes) and `observed`."""

    n: int = 0
    first: int | None = None
    last: int | None = None
    auth: int | None = None
    ended: int | None = None
    reason: str | None = None
    stale: int | None = None
    origin: str | None = None
    company: str | None = None
    title: str | None = None
    official_url: str | None = None
    priority: str | None = None
    location_state: str | None = None
    published_on: str | None = None

    def due(self) -> tuple[int, str]:
        """When its life ends if nothing more is heard, and why."""
        if self.published_on:
            return max(out_of_window(dt.date.fromisoformat(self.published_on)), self.last), OLD
        return max(self.first + GRACE_DAYS * DAY, self.last), UNKNOWN

    def timers(self) -> list[int]:
        """When it is to be looked at again."""
        return [] if self.ended is not None else [self.due()[0], *([self.last + STALE_DAYS * DAY + 1] if self.stale is None and self.origin != "official_collection" else [])]

    def until(self, at: int) -> Life:
        if self.ended is not None or self.first is None:
            return self
        end, why = self.due()
        silent = self.last + STALE_DAYS * DAY
        now = self
        if self.stale is None and self.origin != "official_collection" and silent < min(at, end):
            now = replace(now, stale=silent)
        return replace(now, ended=end, reason=why) if end <= at else now

    def observed(self, at: int, presence: bool, e: dict) -> Life:
        now = self.until(at)
        if now.ended is not None:
            return replace(now, last=max(now.last, at))
        published = now.published_on or e["published_on"]
        if published and dt.date.fromisoformat(published) > tokyo_day(at):
            return replace(now, ended=at, reason=FUTURE, last=max(now.last or at, at))
        if published and out_of_window(dt.date.fromisoformat(published)) <= at:
            return replace(now, ended=at, reason=OLD, last=max(now.last or at, at))
        longer = lambda a, b: b if b is not None and (a is None or len(b) > len(a)) else a
        rank = lambda o: -1 if o is None else ORIGINS.get(o, 0)
        origin = e["origin"] if (rank(e["origin"]), e["origin"] or "") > (rank(now.origin), now.origin or "") else now.origin
        place = now.location_state if now.location_state == "japan" or (presence and e["location_state"] != "japan") or e["location_state"] is None else e["location_state"]
        return Life(
            now.n + 1, at if now.first is None else min(now.first, at), at if now.last is None else max(now.last, at), max(now.auth or at, at) if e["authoritative"] else now.auth, None, None, now.stale, origin,
            longer(now.company, e["company"]), longer(now.title, e["title"]), now.official_url or e["official_url"], min(filter(None, (now.priority, e["priority"])), default=None), place, published)

    def row(self, identity: str) -> dict:
        state = "tombstoned" if self.ended is not None else "expired" if self.stale is not None else "admitted" if self.published_on else "quarantined"
        time = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        return {"identity": identity, "state": state, "reason": self.reason, "ended_at": time(self.ended), "stale_at": time(self.stale), "observation_count": self.n, "first_seen_at": time(self.first), "last_seen_at": time(self.last), "last_authoritative_seen_at": time(self.auth),
                "origin": self.origin, "company": self.company, "title": self.title, "official_url": self.official_url, "priority": self.priority, "location_state": self.location_state, "published_on": self.published_on and dt.date.fromisoformat(self.published_on)}


def _none(x):
    return None if x is None or x is pd.NaT or x != x else x


def _micros(x) -> int | None:
    return None if _none(x) is None else pd.Timestamp(x).value // 1000


LIFE_STATE = "n long, first long, last long, auth long, ended long, reason string, stale long, origin string, company string, title string, official_url string, priority string, location_state string, published_on string"
PENDING = "at long, presence int, observation_key string, origin string, company string, title string, official_url string, priority string, location_state string, published_on string, authoritative boolean"


class Follower(StatefulProcessor):
    """One candidate: its life (value state), observation keys that count (map state), observations that wait for the watermark (list state).

    Observations wait so that they are taken in order of event time; each sets a timer, and so does the life for its next deadline.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE_STATE)
        self.keys = handle.getMapState("keys", "observation_key string", "at long")
        self.waiting = handle.getListState("waiting", PENDING)

    def _held(self) -> Life:
        return Life(*self.life.get()) if self.life.exists() else Life()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for batch in rows:
            for r in batch.to_dict("records"):
                at, day = _micros(r["ts"]), _none(r["published_on"])
                new.append((at, int(r["kind"] == "presence"), r["observation_key"], *(_none(r[c]) for c in FIELDS[:6]), day and pd.Timestamp(day).date().isoformat(), None if _none(r["authoritative"]) is None else bool(r["authoritative"])))
        self.waiting.appendList(new)
        for ms in {e[0] // 1000 + 1 for e in new}:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000  # later events are still to come at this time, but none before
        old = life = self._held()
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((e for e in waiting if e[0] < now), key=lambda e: [(x is not None, x) for x in e])
        for e in ready:
            if self.keys.containsKey((e[2],)):
                continue
            self.keys.updateValue((e[2],), (e[0],))
            if life == Life() and e[1]:  # a presence before the first lead
                continue
            life = life.observed(e[0], bool(e[1]), dict(zip(FIELDS, e[3:], strict=True)))
        life = life.until(now)
        if ready:
            self.waiting.put([e for e in waiting if e[0] >= now]) if len(ready) < len(waiting) else self.waiting.clear()
        if life == old:
            return
        self.life.update(astuple(life))
        for us in life.timers():
            if us >= now:
                self.handle.registerTimer(us // 1000 + 1)
        yield pd.DataFrame([life.row(key[0])])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """A stored candidate (LIFE) or tombstone, whose deadlines go on."""
        r = initialState.to_dict("records")[0]
        day = _none(r["published_on"])
        life = Life(int(r["observation_count"]), _micros(r["first_seen_at"]), _micros(r["last_seen_at"]), _micros(r["last_authoritative_seen_at"]), _micros(r["ended_at"]), _none(r["reason"]), _micros(r["stale_at"]), *(_none(r[c]) for c in FIELDS[:6]), day and pd.Timestamp(day).date().isoformat())
        self.life.update(astuple(life))
        for us in life.timers():
            self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


assert [f.name for f in fields(Life)] == [c.split()[0] for c in LIFE_STATE.split(", ")]


def follow(stream: DataFrame, delay: str = "3 days", stored: DataFrame | None = None) -> DataFrame:
    """A row (LIFE) of each candidate whenever the watermark, delay behind the latest event, has passed something of it.

    The session's state store is to be RocksDB's, which keeps values, lists, maps and timers. stored: candidates of `lives` to begin from.
    """
    keyed = stream.withWatermark("ts", delay).groupBy("identity")
    begin = None if stored is None else stored.groupBy("identity")
    return keyed.transformWithStateInPandas(statefulProcessor=Follower(), outputStructType=LIFE, outputMode="Update", timeMode="EventTime", initialState=begin)


#: What a session needs for `follow`.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
