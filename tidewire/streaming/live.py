"""Stateful operators of the live service. State lives in RocksDB; batches are taken in order of (ts, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import rules
from ..operators import moves as M
from ..operators import score

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT = "kind string, priority int, ts double, seq long, score double, reason string, symbols array<string>, headline string, source string, symbol string, ret double, window_s double, z double, volume_ratio double"

SIZE = ("ret", "window_s", "z", "volume_ratio")


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class MoveDetector(StatefulProcessor):
    """One symbol's detector: its ticks within the history and the scalars of the baseline."""

    def __init__(self, cfg: rules.MoveConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getListState("ticks", "ts double, price double, volume double")
        self.base = handle.getValueState("base", "var double, vol double, n long, up double, down double, last int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A backlog builds the baseline, the history and the cooldown; its moves aren't reported."""
        st = self._load()
        self._take(st, key, initialState)
        self._keep(st)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        st = self._load()
        found = self._take(st, key, pd.concat(list(rows)))
        self._keep(st)
        yield pd.DataFrame(found, columns=[c.split()[0] for c in M.MOVE.split(", ")])

    def _load(self) -> M.SymbolState:
        st = M.SymbolState()
        if self.base.exists():
            st.var, st.vol, st.n, up, down, st.last = self.base.get()
            st.fired = {1: up, -1: down}
            st.ticks.extend(self.ticks.get())
        return st

    def _take(self, st: M.SymbolState, key, rows: pd.DataFrame) -> list[dict]:
        found = []
        for row in rows.sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
            move = M.detect(st, float(row.ts), float(row.price), float(row.volume), self.cfg)
            if move:
                found.append({"symbol": key[0], "seq": int(row.seq)} | move)
        return found

    def _keep(self, st: M.SymbolState) -> None:
        self.base.update((st.var, st.vol, st.n, st.fired[1], st.fired[-1], st.last))
        if st.ticks:
            self.ticks.put([tuple(t) for t in st.ticks])

    def close(self) -> None:
        pass


def live_moves(ticks: DataFrame, cfg: rules.MoveConfig | None = None, backlog: DataFrame | None = None) -> DataFrame:
    """Moves of a stream of ticks (symbol, seq, ts, price, volume), primed by a backlog of the same columns if there is one."""
    initial = None if backlog is None else backlog.groupBy("symbol")
    return ticks.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=MoveDetector(cfg or rules.MoveConfig()), outputStructType=M.MOVE, outputMode="Append", timeMode="None", initialState=initial
    )


def new_items(bodies: DataFrame) -> DataFrame:
    """Headlines of a stream of feed bodies (source, body, polled_at), each id of a source once."""
    from ..sources import feeds

    return feeds.parse_feeds(bodies, F.unix_micros(F.current_timestamp()) / 1e6).dropDuplicates(["source", "id"])


def observed(rows: DataFrame, name: str = "counters") -> DataFrame:
    """rows with counters (rows, and those of each priority) that a StreamingQueryListener gets with every batch."""
    by = [F.count(F.when(F.col("priority") == k, 1)).alias(n.lower()) for k, n in enumerate(rules.PRIORITY_NAMES)]
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *by)


class Follower(StatefulProcessor):
    """Deduplicates relevant headlines against those kept within the time to live, and confirms headlines by moves and moves
    by headlines of their symbol, the last `ring` of each. Takes what the gate and the detector let through, so it is one key.
    """

    def __init__(self, cfg: rules.FollowConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ts double, headline string, shingles array<string>")
        self.news = handle.getListState("news", "symbol string, ts double, headline string, source string, score double")
        self.moves = handle.getListState("moves", "symbol string, ts double, said string, ret double, window_s double, z double, volume_ratio double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self.cfg
        kept = [(t, h, set(s)) for t, h, s in self.kept.get()]
        news, moves = [tuple(x) for x in self.news.get()], [tuple(x) for x in self.moves.get()]
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "is_move", "seq"], kind="stable").itertuples(index=False):
            if r.is_move:
                size = (r.ret, r.window_s, r.z, r.volume_ratio)
                moves = self._ring(moves, (r.symbol, r.ts, r.reason, *size))
                hit = next((n for n in reversed(news) if n[0] == r.symbol and r.ts - n[1] <= c.correlate_s), None)
                if hit:
                    out.append(("confirmed", rules.CRITICAL, r.ts, r.seq, min(100.0, hit[4] + 10), f"{r.reason} on: {hit[2]}", [r.symbol], hit[2], hit[3], r.symbol, *size))
                else:
                    level = rules.CRITICAL if r.hard else rules.IMPORTANT
                    out.append(("unexplained_move", level, r.ts, r.seq, r.score, f"{r.reason} with no matching headline" + (" (reversal)" if r.reversal else ""), [r.symbol], None, "tape", r.symbol, *size))
                continue
            kept = [k for k in kept if r.ts - k[0] <= c.news.ttl_s]
            own = set(r.shingles)
            if own and any(self._alike(own, k[2]) for k in kept):
                continue
            kept.append((r.ts, r.headline, own))
            names = [str(s) for s in r.symbols]
            for s in names:
                news = self._ring(news, (s, r.ts, r.headline, r.source, r.score))
            move = next((m for s in names for m in reversed(moves) if m[0] == s and r.ts - m[1] <= c.correlate_s), None)
            if move:
                out.append(("confirmed", rules.CRITICAL, r.ts, r.seq, min(100.0, r.score + 10), f"{r.reason}; price already moved: {move[2]}", names, r.headline, r.source, move[0], *move[3:]))
            elif r.priority >= c.min_priority:
                out.append(("news_critical", int(r.priority), r.ts, r.seq, r.score, r.reason, names, r.headline, r.source, None, None, None, None, None))
        for state, held in ((self.kept, [(t, h, sorted(s)) for t, h, s in kept]), (self.news, news), (self.moves, moves)):
            state.put(held) if held else state.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ALERT.split(", ")])

    def _ring(self, held: list, new: tuple) -> list:
        own = [k for k, x in enumerate(held) if x[0] == new[0]]
        return [x for k, x in enumerate(held) if len(own) < self.cfg.ring or k != own[0]] + [new]

    def _alike(self, a: set, b: set) -> bool:
        both = len(a & b)
        return both > 0 and (both / len(a | b) >= self.cfg.news.similarity or both / min(len(a), len(b)) >= self.cfg.news.containment)

    def close(self) -> None:
        pass


def live_alerts(items: DataFrame, ticks: DataFrame, cfg: rules.FollowConfig | None = None, backlog: DataFrame | None = None) -> DataFrame:
    """Alerts of a stream of headlines and a stream of ticks, in one query of two stateful steps: moves by symbol, then the
    follower on what passed the gates. Scoring is stateless and as parallel as its input."""
    from ..functions.text import shingles

    cfg = cfg or rules.FollowConfig()
    gate = score.relevant(score.score_news(items, cfg.news))
    news = gate.select(
        F.lit(False).alias("is_move"), "seq", F.col("ts").cast("double").alias("ts"), "headline", "source", F.col("all_symbols").alias("symbols"), shingles(F.col("headline")).alias("shingles"),
        F.col("score").cast("double").alias("score"), "priority", "reason", F.lit("").alias("symbol"), F.lit(False).alias("hard"), F.lit(False).alias("reversal"), *[F.lit(None).cast("double").alias(c) for c in SIZE],
    )
    none = F.expr("cast(array() as array<string>)")
    found = live_moves(ticks, cfg.move, backlog).select(
        F.lit(True).alias("is_move"), "seq", "ts", F.lit("").alias("headline"), F.lit("tape").alias("source"), none.alias("symbols"), none.alias("shingles"),
        F.least(F.lit(100.0), 45 + 4 * F.col("z") + 400 * F.abs("ret")).alias("score"), F.lit(0).alias("priority"),
        M.describe(F.col("symbol"), F.col("ret"), F.col("window_s"), F.col("z"), F.col("volume_ratio")).alias("reason"), "symbol", (F.abs("ret") >= cfg.move.hard_ret).alias("hard"), "reversal", *SIZE,
    )
    both = news.unionByName(found).withColumn("_all", F.lit(0))
    return both.groupBy("_all").transformWithStateInPandas(statefulProcessor=Follower(cfg), outputStructType=ALERT, outputMode="Append", timeMode="None")


def warm(ticks: DataFrame, cfg: rules.MoveConfig | None = None) -> DataFrame:
    """The detector's state (symbol, n, sigma_per_s, vol_per_s) after a backlog whose moves aren't reported: its last
    baseline by symbol."""
    base = M.baselines(ticks, cfg)
    return base.groupBy("symbol").agg(*[F.max_by(c, F.struct("ts", "seq")).alias(c) for c in ("n", "sigma_per_s", "vol_per_s")])
