"""python -m ledgerloom.cli ROOT COMMAND: seed, current, fx, prices, import FILE, backfill, daily-snapshot."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ledgerloom.api import Portfolio
from ledgerloom.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("command", choices=["seed", "current", "fx", "prices", "import", "backfill", "daily-snapshot"])
    p.add_argument("file", nargs="?")
    p.add_argument("--lake")
    p.add_argument("--today")
    a = p.parse_args(argv)
    port = Portfolio(Store(SparkSession.builder.getOrCreate(), a.root), lake_root=a.lake)
    if a.command == "import" and not a.file:
        p.error("import needs a file")
    out = {
        "seed": lambda: {"new": port.seed_sleeves()},
        "current": lambda: port.current_risk(a.today).first().asDict(),
        "fx": port.refresh_fx,
        "prices": lambda: port.refresh_prices(today=a.today),
        "import": lambda: port.import_csv(a.file),
        "backfill": lambda: {"written": port.backfill(end=a.today)},
        "daily-snapshot": lambda: port.daily_job(today=a.today),
    }[a.command]()
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
