"""Slowest stages from a Spark event log directory (as written with ``BENCH_EVENT_LOG_DIR``).

Usage: python tools/stage_times.py EVENT_LOG_DIR [n]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    """Lines of an event log file, zstd-compressed (Spark's default) or plain."""
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def stages(log_dir: str):
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(f) and os.path.basename(f).startswith(("events_", "app-", "local-"))]
    for path in sorted(files):
        for line in _lines(path):
            try:
                event = json.loads(line)
            except ValueError:
                continue
            if event.get("Event") == "SparkListenerStageCompleted":
                info = event["Stage Info"]
                took = (info.get("Completion Time") or 0) - (info.get("Submission Time") or 0)
                yield took / 1000.0, info["Number of Tasks"], info["Stage Name"]


def main() -> None:
    log_dir = sys.argv[1]
    n = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    rows = sorted(stages(log_dir), reverse=True)
    print(f"{len(rows)} stages, {sum(r[0] for r in rows):.1f} s in total")
    for took, tasks, name in rows[:n]:
        print(f"{took:8.2f} s  {tasks:5d} tasks  {name[:90]}")


if __name__ == "__main__":
    main()
