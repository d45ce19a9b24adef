"""Where tape lines go: a terminal, a JSON log, a voice."""

from __future__ import annotations

import itertools
import os
import queue
import shutil
import subprocess
import sys
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .. import rules
from ..operators.score import priority_name

#: Terminal styles by priority.
RESET = "\033[0m"
STYLES = {rules.CRITICAL: "\033[1;97;41m", rules.IMPORTANT: "\033[1;93m", rules.NORMAL: "\033[0;37m", rules.LOW: "\033[2;37m"}
VOICES = (
    ("say", ("say", "-r", "{rate}", "{text}")), ("espeak-ng", ("espeak-ng", "-s", "{rate}", "{text}")), ("espeak", ("espeak", "-s", "{rate}", "{text}")),
    ("spd-say", ("spd-say", "-w", "-r", "0", "{text}")),
    ("powershell", ("powershell", "-NoProfile", "-Command", "Add-Type -AssemblyName System.Speech; (New-Object System.Speech.Synthesis.SpeechSynthesizer).Speak('{text}')")),
)


def log_rows(lines: DataFrame) -> DataFrame:
    """Tape lines as the log keeps them."""
    iso = F.date_format(F.timestamp_micros(F.floor(F.col("ts")).cast("long") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return lines.select("ts", iso.alias("iso"), priority_name(F.col("priority")).alias("priority"), "region", "org", "speaker", "body", "symbols", "source", "url", "note")


def append_log(lines: DataFrame, path: str) -> None:
    """Append to a folder of JSON lines."""
    log_rows(lines).write.mode("append").json(path)


def coloured(text: str, priority: int, colour: bool) -> str:
    return f"{STYLES.get(priority, '')}{text}{RESET}" if colour else text


def use_colour(stream) -> bool:
    return not os.environ.get("NO_COLOR") and bool(getattr(stream, "isatty", lambda: False)())


def terminal(stream=None, colour: bool | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: print each line of a batch, with its kind. A batch is what passed every gate, so few lines."""
    out = stream or sys.stdout
    shown = use_colour(out) if colour is None else colour

    def write(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("ts").toLocalIterator():
            print(coloured(f"{r['line']}  [{r['note']}]" if r["note"] else r["line"], r["priority"], shown), file=out, flush=True)

    return write


class Voice:
    """For foreachBatch: queues the lines that are urgent enough, and a thread of its own reads them out, the most urgent first,
    so no batch waits. A CRITICAL line stops a lesser one that is being read. Nothing where there is no voice."""

    def __init__(self, rate: int = 190, start: Callable = subprocess.Popen, find: Callable = shutil.which, min_priority: int = rules.IMPORTANT):
        self.argv = next((a for _, a in VOICES if find(a[0])), None)
        self.rate, self.start, self.min_priority = rate, start, min_priority
        self.due: queue.PriorityQueue = queue.PriorityQueue()
        self.order, self.lock = itertools.count(), threading.Lock()
        self.now: tuple[int, object] | None = None  # priority and process of what is being read
        self.thread = threading.Thread(target=self._read, daemon=True)
        if self.argv:
            self.thread.start()

    def __call__(self, batch: DataFrame, _: int) -> None:
        if self.argv is None:
            return
        due = batch.where((F.col("priority") >= self.min_priority) & (F.trim("spoken") != "")).orderBy(F.desc("priority"), "ts")
        for r in due.toLocalIterator():
            self.say(r["spoken"], r["priority"])

    def say(self, text: str, priority: int) -> None:
        self.due.put((-priority, next(self.order), text))
        with self.lock:
            if priority >= rules.CRITICAL and self.now and self.now[0] < priority:
                self.now[1].terminate()

    def close(self) -> None:
        """Read what is queued, and end."""
        if self.argv:
            self.due.put((1, 0, None))  # after every line
            self.thread.join()

    def _read(self) -> None:
        while (line := self.due.get())[2] is not None:
            text = line[2].replace("'", " ").replace('"', " ")
            try:
                with self.lock:
                    self.now = (-line[0], self.start([a.format(rate=self.rate, text=text) for a in self.argv]))
                self.now[1].wait()
            except OSError:
                pass  # the voice is gone; the tape goes on
            with self.lock:
                self.now = None


def banner(feeds: int, symbols: int, level: str) -> str:
    return f"tidewire: {feeds} feeds, {symbols} symbols, {level} and above"


class Counter(StreamingQueryListener):
    """Adds up what live.observed() counts in every batch."""

    def __init__(self):
        self.total: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("counters")
        for k, v in (row.asDict() if row else {}).items():
            self.total[k] = self.total.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def summary(self) -> str:
        return ", ".join(f"{n} {k}" for k, n in self.total.items() if n) or "nothing passed the gates"


def counts(lines: DataFrame) -> DataFrame:
    """Lines by priority."""
    return lines.groupBy(priority_name(F.col("priority")).alias("priority")).agg(F.count("*").alias("n"))
