"""Current directors over a stream of what filings say of them, in whatever order it comes.

The state of a folder is what its rows lead to so far, the rows themselves, and a base.
Rows of days after the last one applied are folded on; a row of that day or before it
makes the folder's rows be folded again from the base, in their order.  When the watermark
has passed a day nothing can come behind it: a timer settles the rows of such days in the
base and forgets them, so that state grows with the lateness allowed and not with time.
Days before the last profile have no say any more: their rows are dropped as they come, and
forgotten when a later profile comes.
A row that is delivered again is the same entry of the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from karst.records.state import OFFICER_FIELDS, apply

#: A state store that keeps more than memory holds; the session's setting ``spark.sql.streaming.stateStore.providerClass``.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACT = ("path", "kind", "at", "s", "q", "r", "key", *OFFICER_FIELDS)
_ISSUE = "struct<severity:string,code:string,source_path:string,effective_date:string>"
_PERSON = f"struct<key:string,{','.join(f'{f}:string' for f in OFFICER_FIELDS)}>"
_NOTHING = {"now": {}, "since": None, "day": None, "issues": []}


def outcome(start: dict, rows: list[SimpleNamespace]) -> dict:
    """The state after ``rows``, all of them of later days than ``start``.

    The last profile is the start; events on its day and after are applied by date,
    quality, reference, path, kind and key.  Events of different kinds for one person on
    one day are left out.
    """
    now, since, issues = dict(start["now"]), start["since"], list(start["issues"])
    profiles = [r for r in rows if r.kind == "SNAPSHOT"]

    def say(code: str, severity: str, row: SimpleNamespace) -> None:
        issues.append([severity, code, row.path, row.at])

    if profiles:
        order = lambda r: (r.at, r.s, r.q, r.r, r.path)
        last = max(map(order, profiles))
        now, since, issues = {}, last[0], []
        for r in sorted((r for r in profiles if order(r) == last), key=lambda r: r.key):
            apply(now, r, say)
    events = [r for r in rows if r.kind != "SNAPSHOT" and (since is None or r.at >= since)]
    kinds: dict[tuple[str, str], set[str]] = {}
    for r in events:
        kinds.setdefault((r.at, r.key), set()).add(r.kind)
    clash = {k for k, v in kinds.items() if k[1] and len(v) > 1}
    for at, key in sorted(clash):
        issues.append(["CRITICAL", "SAME_DATE_DIRECTOR_CONFLICT", min(r.path for r in events if (r.at, r.key) == (at, key)), at])
    for r in sorted((r for r in events if (r.at, r.key) not in clash), key=lambda r: (r.at, r.q, r.r, r.path, r.kind, r.key)):
        apply(now, r, say)
    return {"now": now, "since": since, "day": max([r.at for r in rows] + ([start["day"]] if start["day"] else []), default=None), "issues": issues}


def _row(text: str) -> SimpleNamespace:
    return SimpleNamespace(**json.loads(text))


def _day(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).date().isoformat()


class Fold(StatefulProcessor):
    """Rows of one folder to its directors, as the module says."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getMapState("log", "row string", "day string")
        self.base = handle.getValueState("base", "state string")
        self.state = handle.getValueState("state", "state string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, version = self.state.get() if self.state.exists() else (json.dumps(_NOTHING), 0)
        state = json.loads(before)
        since, met = state["since"], {}
        for frame in rows:
            frame = frame[list(FACT)]
            profiles = frame.loc[frame["kind"] == "SNAPSHOT", "at"]
            if len(profiles) and (since is None or profiles.max() > since):
                since = profiles.max()
                met = {t: at for t, at in met.items() if at >= since}
            if since is not None:
                frame = frame[frame["at"] >= since]
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                text = json.dumps({k: str(v) if k == "at" else int(v) if k in ("s", "q") else v for k, v in r.items()}, sort_keys=True, ensure_ascii=False)
                met[text] = r["at"]
        met = {t: at for t, at in met.items() if not self.log.containsKey((t,))}
        if not met:
            return
        if state["since"] != since:
            for t in [k[0] for k, v in self.log.iterator() if v[0] < since]:
                self.log.removeKey((t,))
        for t, at in met.items():
            self.log.updateValue((t,), (at,))
        if state["day"] is None or min(met.values()) > state["day"]:
            state = outcome(state, [_row(t) for t in met])
        else:
            state = outcome(self._base(), [_row(k[0]) for k in self.log.keys()])
        self.state.update((json.dumps(state), version + 1))
        last = date.fromisoformat(max(met.values())) + timedelta(days=1)
        self.handle.registerTimer(int(datetime(last.year, last.month, last.day, tzinfo=UTC).timestamp() * 1000))
        yield self._told(key, state, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = _day(timerValues.getCurrentWatermarkInMs())
        old = [k[0] for k, v in self.log.iterator() if v[0] < passed]
        if old:
            self.base.update((json.dumps(outcome(self._base(), [_row(t) for t in old])),))
            for t in old:
                self.log.removeKey((t,))
        yield from ()

    def _base(self) -> dict:
        return json.loads(self.base.get()[0]) if self.base.exists() else dict(_NOTHING)

    def _told(self, key, state: dict, version: int) -> pd.DataFrame:
        people = [{"key": k, **{f: p.get(f, "") for f in OFFICER_FIELDS}} for k, p in sorted(state["now"].items())]
        issues = [dict(zip(("severity", "code", "source_path", "effective_date"), i, strict=True)) for i in state["issues"]]
        return pd.DataFrame({"folder": [key[0]], "version": [version], "directors": [json.dumps(people)], "issues": [json.dumps(issues)]})

    def close(self) -> None:
        pass


def follow(facts: DataFrame, late: str = "90 days") -> DataFrame:
    """A stream of (folder, version, directors, issues) from one of ``state.director_facts``; the highest version of a folder counts.

    Rows later than ``late`` behind the last day seen are dropped by the watermark, which
    counts them.  Null dates have no place in the order and are left out.  The session
    needs the state store ``STORE``.
    """
    dated = facts.where("at IS NOT NULL").withColumn("day", F.col("at").cast("timestamp")).withColumn("at", F.col("at").cast("string")).withWatermark("day", late)
    out = dated.groupBy("folder").transformWithStateInPandas(Fold(), "folder string, version long, directors string, issues string", "Update", "EventTime")
    return out.select("folder", "version", F.from_json("directors", f"array<{_PERSON}>").alias("directors"), F.from_json("issues", f"array<{_ISSUE}>").alias("issues"))
