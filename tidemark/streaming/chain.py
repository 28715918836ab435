"""The whole live chain as one stateful operator: ticks become value bars, bars feed the windows of indicators and the CUSUM filter, those
raise events, and events wait for their barriers.

The state of a symbol is its open bar, the last returns, the two sums and the events that are still open, all of bounded size;
a micro-batch works on its new ticks only. State is kept in RocksDB and survives restarts with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, kind string, uid long, nticks long, high double, low double, wprice double, sigma double, event int, vertbar int, side int, ret double, tdone long"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_OPEN = "uid long, money long, cents long, volume long, open double, high double, low double, high_at long, low_at long, n long"
_EMPTY = (0, 0.0, float("-inf"), float("inf"), 0, 0, 0)  # volume, open, high, low, high_at, low_at, n


def _share(a: float, b: float) -> float:
    return a / b if b else np.nan


class _Bars:
    """Closed bars of new ticks, and the open one."""

    @staticmethod
    def of(t: pd.DataFrame, state: tuple, size: int) -> tuple[list[tuple], tuple]:
        uid, money, cents, *rest = state
        seq, last, volume = t["seq"].to_numpy(), t["last"].to_numpy(), t["volume"].to_numpy()
        worth = t["cents"].to_numpy() * volume
        total = money + np.cumsum(worth)
        own, upto = uid + (total - worth) // size, uid + total // size
        start = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        end = np.append(start[1:], len(own))
        bars = []
        for a, b in zip(start.tolist(), end.tolist()):
            if own[a] != uid or not rest[-1]:
                cents, rest = 0, list(_EMPTY)
            v, opened, high, low, high_at, low_at, n = rest
            hi, lo = a + int(last[a:b].argmax()), a + int(last[a:b].argmin())
            if last[hi] > high:
                high, high_at = float(last[hi]), int(seq[hi])
            if last[lo] < low:
                low, low_at = float(last[lo]), int(seq[lo])
            cents, v, n, opened = cents + int(worth[a:b].sum()), v + int(volume[a:b].sum()), n + b - a, opened if n else float(last[a])
            rest = [v, opened, high, low, high_at, low_at, n]
            for k in range(int(own[a]), int(upto[b - 1])):  # a deal that closes several bars leaves bars without ticks
                bars.append((k, opened, high, low, int(high_at < low_at), cents / v / 100, n if k == own[a] else 0))
        done = int(upto[-1]) > int(own[-1])
        return bars, (int(upto[-1]), int(total[-1] % size), 0 if done else cents, *(_EMPTY if done else rest))


class Chain(StatefulProcessor):
    """See labels()."""

    def __init__(self, size: int, window: int, h: float | None, multiple: float, first: int, step: int, count: int, idle_ms: int | None):
        self.size, self.window, self.h, self.multiple, self.idle_ms = size, window, h, multiple, idle_ms
        self.vertical = [first + step * k for k in range(count)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", _OPEN)
        self.last = handle.getValueState("last", "bars long, high double, low double, highfirst int, wprice double, up double, down double")
        self.returns = handle.getListState("returns", "ret double")
        self.waiting = handle.getListState("waiting", "twhen long, entry double, width double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values("seq")
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(t["time_msc"].max()) + self.idle_ms)
        bars, open_bar = _Bars.of(t, self.bar.get() or (0, 0, 0, *_EMPTY), self.size)
        self.bar.update(open_bar)
        if bars:
            yield pd.DataFrame(self._follow(key[0], bars), columns=_NAMES).astype({c: "Int64" for c in ("uid", "nticks", "event", "vertbar", "side", "tdone")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.bar, self.last, self.returns, self.waiting):
            state.clear()
        yield pd.DataFrame([(key[0], "idle", *[None] * 11)], columns=_NAMES).astype({c: "Int64" for c in ("uid", "nticks", "event", "vertbar", "side", "tdone")})

    def _follow(self, symbol: str, bars: list[tuple]) -> list[tuple]:
        n, ph, pl, pf, pw, up, down = self.last.get() or (0, 0.0, 0.0, 0, 0.0, 0.0, 0.0)
        recent = [r[0] for r in self.returns.get()] if n else []
        waiting = [tuple(e) for e in self.waiting.get()] if n else []
        out = []
        for uid, opened, high, low, highfirst, wprice, ticks in bars:
            c1, c2 = (high, low) if highfirst else (low, high)
            ret, event = np.nan, 0
            if n:
                ret = (0.75 * (_share(opened, pl if pf else ph) - 1) + 0.85 * (_share(c1, opened) - 1) + (_share(c2, c1) - 1)) / 2.6
                up, down = max(0.0, up + wprice - pw), min(0.0, down + wprice - pw)
                if self.h is not None and up > self.h:
                    event, up = 1, 0.0
                elif self.h is not None and down < -self.h:
                    event, down = -1, 0.0
            recent, n = [*recent, ret][-self.window :], n + 1
            known = np.array([r for r in recent if r == r])
            sigma = float(known.std()) if n > self.window and len(known) else np.nan
            out.append((symbol, "bar", uid, ticks, high, low, wprice, None if np.isnan(sigma) else sigma, event, *[None] * 4))
            if self.h is None or event:
                waiting.append((uid, wprice, sigma))
            if waiting:
                out += [(symbol, "label", e[0], *[None] * 6, *label) for e, label in self._reached(waiting, uid, (opened, c1, c2))]
                waiting = [e for e, keep in zip(waiting, self._open) if keep]
            ph, pl, pf, pw = high, low, highfirst, wprice
        self.last.update((n, ph, pl, pf, pw, up, down))
        self.returns.put([(float(r),) for r in recent])
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        return out

    def _reached(self, waiting: list[tuple], uid: int, prices: tuple) -> list[tuple]:
        """(event, (vertbar, side, ret, tdone)) of the events for which this bar decides; marks those that stay open."""
        twhen, entry, width = (np.array(x) for x in zip(*waiting))
        with np.errstate(divide="ignore", invalid="ignore"):
            ret = np.array(prices)[None] / entry[:, None] - 1
            hit = np.abs(ret) >= self.multiple * width[:, None]
        away = uid - twhen
        found = []
        for i in np.flatnonzero(hit.any(axis=1) | np.isin(away, self.vertical)).tolist():
            r = float(ret[i, hit[i].argmax()] if hit[i].any() else ret[i, 2])
            vertbar = next(v for v in self.vertical if v >= away[i])
            found.append((waiting[i], (vertbar, 1 if r > 0 else -1, r, uid)))
        self._open = ~hit.any(axis=1) & (away < self.vertical[-1])
        return found


def labels(ticks: DataFrame, size: int, window: int = 30, h: float | None = None, multiple: float = 2.0, first: int = 10, step: int = 10, count: int = 3, idle: str | None = None) -> DataFrame:
    """Bars and labels (kind says which) of a stream of ticks (symbol, seq, time, time_msc, last, cents, volume), as they come about.

    bar: a closed value bar of ``size`` with the deviation of the last ``window`` returns and the event (1, -1) that the CUSUM filter of
    its wprice, with bound ``h``, gives. label: of the event at bar ``uid``, as labels.triple_barrier() gives them, in the bar that
    decides (tdone). Events are the bars where the filter fires, or all bars without ``h``.

    Ticks of a symbol must come in the order of seq from batch to batch; within a batch they are sorted. idle: state of symbols
    without ticks for so long in event time (``10 minutes`` behind the newest) is dropped, and a row of kind idle says so; a symbol
    that comes back begins anew."""
    t = ticks.where("volume > 0")
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    if idle is not None:
        t = t.withWatermark("time", "10 minutes")
    t = t.select("symbol", "seq", "time_msc", "last", "cents", "volume", *(["time"] if idle is not None else []))
    return t.groupBy("symbol").transformWithStateInPandas(Chain(size, window, h, multiple, first, step, count, idle_ms), OUT, "Append", "None" if idle is None else "EventTime")
