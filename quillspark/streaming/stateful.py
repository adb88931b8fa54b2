"""Stories and admission as keyed state that goes on from batch to batch and is dropped by event time.

Both need the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.times import SEOUL
from quillspark.operators.assign import ACTIVE_HOURS, CENTROID, LEAD, REPRESENTATIVE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, MINUTE, DAY = 3_600_000, 60_000, 86_400_000


class OpenStories:
    """Stories that an article may still join, with unit vectors of centroid and first article side by side."""

    def __init__(self, rows: Iterable[tuple] = (), centroid: float = CENTROID, representative: float = REPRESENTATIVE, lead: float = LEAD) -> None:
        """rows: story, sum of its vectors, first vector, last report in milliseconds."""
        self.limits = centroid, representative, lead
        self.rows = {r[0]: [np.asarray(r[1], float), np.asarray(r[2], float), int(r[3])] for r in rows}

    def rows_out(self) -> list[tuple]:
        return [(name, total.tolist(), first.tolist(), last) for name, (total, first, last) in self.rows.items()]

    def forget(self, before: int) -> None:
        """Leave out stories whose last report is older than any article to come can reach."""
        self.rows = {k: v for k, v in self.rows.items() if v[2] + ACTIVE_HOURS * HOUR >= before}

    def take(self, article: str, at: int, vector: np.ndarray) -> str:
        """The story of an article: a near one with a lead over the next, or one of its own."""
        names = sorted(k for k, v in self.rows.items() if 0 <= at - v[2] <= ACTIVE_HOURS * HOUR)
        if names:
            near = _cosines(np.stack([self.rows[n][0] for n in names]), vector)
            best = int(np.argmax(near))  # the first by name among equals
            gap = near[best] - np.delete(near, best).max() if len(names) > 1 else np.inf
            total, first, last = self.rows[names[best]]
            if near[best] >= self.limits[0] and gap >= self.limits[2] and _cosines(first[None], vector)[0] >= self.limits[1]:
                self.rows[names[best]] = [total + vector, first, max(last, at)]
                return names[best]
        self.rows[f"s-{article}"] = [vector, vector, at]
        return f"s-{article}"


def _cosines(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(many, axis=1) * np.linalg.norm(one)
    return np.divide(many @ one, norms, out=np.zeros(len(many)), where=norms > 0)


def fold(rows: pd.DataFrame, stories: OpenStories) -> pd.DataFrame:
    """article, story of rows(article, at, vector) in the order of time and id; stories go on changing."""
    ordered = rows.sort_values(["at", "article"])
    return pd.DataFrame({"article": ordered.article, "story": [stories.take(r.article, int(r.at), np.asarray(r.vector, float)) for r in ordered.itertuples()]}, columns=["article", "story"])


def cluster_batch(articles: DataFrame, block: str) -> DataFrame:
    """article, story of all that is there at once, block by block, each of which starts empty; arguments as of cluster_stream."""
    typed = articles.select(F.col("article").cast("string").alias("article"), F.unix_millis(F.col("published_at").cast("timestamp")).alias("at"), "vector", F.col(block).alias("block"))
    return typed.groupBy("block").applyInPandas(lambda rows: fold(rows, OpenStories()), "article string, story string")


class _Clusters(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "story string, sum array<double>, first array<double>, last long")

    def _keep(self, stories: OpenStories, watermark: int) -> None:
        stories.forget(watermark)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.open.clear()
        if stories.rows:
            self.open.put(stories.rows_out())
            self.handle.registerTimer(max(watermark, min(v[2] for v in stories.rows.values()) + ACTIVE_HOURS * HOUR) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        stories = OpenStories(self.open.get())
        out = fold(pd.concat(list(rows)), stories)
        self._keep(stories, timerValues.getCurrentWatermarkInMs())
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self._keep(OpenStories(self.open.get()), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"article": [], "story": []}, dtype="object")

    def close(self) -> None: ...


def cluster_stream(articles: DataFrame, block: str, late: str = "1 hour") -> DataFrame:
    """article, story of a stream of articles(article, published_at, vector, block); stories of earlier batches are open to later ones.

    A block (a topic, say) is one task and holds its stories of the last 72 hours; articles later than `late` are left out.
    """
    typed = articles.select(F.col("article").cast("string").alias("article"), F.col("published_at").cast("timestamp").alias("t"), F.col("vector").cast("array<double>").alias("vector"), F.col(block).cast("string").alias("block"))
    stamped = typed.withWatermark("t", late).withColumn("at", F.unix_millis("t"))
    return stamped.groupBy("block").transformWithStateInPandas(statefulProcessor=_Clusters(), outputStructType="article string, story string", outputMode="append", timeMode="eventTime")


class _Admission(StatefulProcessor):
    """All-or-nothing: a request that any limit turns away counts for none."""

    def __init__(self, per_minute: int, per_day: int, at_once: int, cap: float, lease_ms: int) -> None:
        self.per_minute, self.per_day, self.at_once, self.cap, self.lease_ms = per_minute, per_day, at_once, cap, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "user string, ends long, day boolean", "n long")
        self.running = handle.getMapState("running", "user string", "idents array<string>, expires array<long>")
        self.budgets = handle.getMapState("budgets", "ends long", "reserved double, spent double")
        self.requests = handle.getMapState("requests", "ident string", "user string, day_ends long, reserved double, keep_to long")

    def _ask(self, ident: str, user: str, at: int, reserve: float) -> str:
        minute, day = at - at % MINUTE + MINUTE, _day_end(at)
        windows = [((user, minute, False), self.per_minute), ((user, day, True), self.per_day)]
        used = [self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0 for k, _ in windows]
        if any(n >= most for n, (_, most) in zip(used, windows, strict=True)):
            return "rate-limited"
        alive = [(i, e) for i, e in zip(*self.running.getValue((user,)), strict=True) if e > at] if self.running.containsKey((user,)) else []
        if len(alive) >= self.at_once:
            return "concurrency"
        reserved, spent = self.budgets.getValue((day,)) if self.budgets.containsKey((day,)) else (0.0, 0.0)
        if round(reserved + spent + reserve, 9) > self.cap:
            return "budget-exhausted"
        for n, (k, _) in zip(used, windows, strict=True):
            self.counts.updateValue(k, (n + 1,))
        self._run(user, [*alive, (ident, at + self.lease_ms)])
        self.budgets.updateValue((day,), (reserved + reserve, spent))
        return "admitted"

    def _run(self, user: str, alive: list[tuple[str, int]]) -> None:
        if alive:
            self.running.updateValue((user,), ([i for i, _ in alive], [e for _, e in alive]))
        elif self.running.containsKey((user,)):
            self.running.removeKey((user,))

    def _settle(self, ident: str, at: int, paid: float) -> None:
        """An admitted request ends: its place is free, its reservation is given back and what it cost is spent. Once."""
        if not self.requests.containsKey((ident,)):
            return
        user, day, held, keep = self.requests.getValue((ident,))
        if held is None:
            return
        if self.running.containsKey((user,)):
            self._run(user, [(i, e) for i, e in zip(*self.running.getValue((user,)), strict=True) if i != ident])
        if self.budgets.containsKey((day,)):
            reserved, spent = self.budgets.getValue((day,))
            self.budgets.updateValue((day,), (max(0.0, reserved - held), spent + paid))
        self.requests.updateValue((ident,), (user, day, None, max(keep, at)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        batch = pd.concat(list(rows))
        for r in batch.sort_values(["at", "action", "ident"]).itertuples():
            if r.action == "settle":
                self._settle(r.ident, int(r.at), float(r.amount))
            elif not self.requests.containsKey((r.ident,)):
                reason, day = self._ask(r.ident, r.user, int(r.at), float(r.amount)), _day_end(int(r.at))
                open_ = reason == "admitted"
                self.requests.updateValue((r.ident,), (r.user, day, float(r.amount) if open_ else None, day + DAY if open_ else int(r.at)))
                out.append((r.ident, open_, None if open_ else reason))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(batch["at"].min())) + HOUR)
        yield pd.DataFrame(out, columns=["ident", "admitted", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Once an hour: what no event to come can ask for goes."""
        now = timerValues.getCurrentWatermarkInMs()
        old = [
            (self.counts, [k for k in self.counts.keys() if k[1] <= now]),  # noqa: SIM118
            (self.budgets, [k for k in self.budgets.keys() if k[0] + DAY <= now]),  # noqa: SIM118
            (self.requests, [k for k, v in self.requests.iterator() if v[3] < now]),
            (self.running, [k for k, v in self.running.iterator() if max(v[1]) <= now]),
        ]
        for state, keys in old:
            for k in keys:
                state.removeKey(k)
        if any(state.exists() for state, _ in old):
            self.handle.registerTimer(now + HOUR)
        yield pd.DataFrame({"ident": pd.Series(dtype="object"), "admitted": pd.Series(dtype="bool"), "reason": pd.Series(dtype="object")})

    def close(self) -> None: ...


def _day_end(at: int) -> int:
    shifted = at + SEOUL * HOUR
    return shifted - shifted % DAY + DAY - SEOUL * HOUR


def admission_stream(requests: DataFrame, per_minute: int, per_day: int, at_once: int, cap: float, lease_seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """ident, admitted, reason (rate-limited, concurrency, budget-exhausted) of a stream of requests(kind, ident, user, at, action, amount).

    action ask: amount is what is reserved; action settle: what the admitted request of that ident cost. Limits are a user's, the cap
    of a Seoul day is the kind's, so a kind is one task. Repeated idents are answered once, events later than `late` not at all.
    """
    typed = requests.select(F.col("kind").cast("string").alias("kind"), F.col("ident").cast("string").alias("ident"), F.col("user").cast("string").alias("user"), F.col("at").cast("timestamp").alias("t"), "action", F.col("amount").cast("double").alias("amount"))
    stamped = typed.withWatermark("t", late).withColumn("at", F.unix_millis("t"))
    processor = _Admission(per_minute, per_day, at_once, cap, lease_seconds * 1000)
    return stamped.groupBy("kind").transformWithStateInPandas(statefulProcessor=processor, outputStructType="ident string, admitted boolean, reason string", outputMode="append", timeMode="eventTime")
