"""python -m signalpanel generate PATH [PROFILE] | check PATH | study PATH TARGET [HORIZON] [RUNS] | replay PATH RUNS RUN
| whatif RUNS RUN FIELD=VALUE... | runs RUNS | datasets PATH

RUNS is the folder that finished runs are stored in. whatif takes fields of the study's spec; VALUE is JSON."""

from __future__ import annotations

import json
import sys
from datetime import date

from pyspark.sql import SparkSession

from signalpanel.operators import quality
from signalpanel.plans import runs, study
from signalpanel.sources import world


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("generate", "check", "study", "replay", "whatif", "runs", "datasets"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    command, path, *rest = args
    if command == "generate":
        world.write(spark, world.World.profile(rest[0] if rest else "small"), path)
        return 0
    if command == "datasets":
        print("\n".join(runs.datasets(path)))
        return 0
    if command == "runs":
        for r in runs.Runs(spark, path).listing().collect():
            print(f"{r.run_id}  {r.kind or '':8} {r.status or '':8} {r.verdict or '':14} {r.capability or ''}")
        return 0
    if command == "whatif":
        store, parent = runs.Runs(spark, path), rest[0]
        result = study.whatif(spark, store.load(parent), **{k: json.loads(v) for k, v in (x.split("=", 1) for x in rest[1:])})
        store.save(result, "whatif", parent)
        print(study.render(spark, result))
        return 0
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    vehicles, signals, events, catalog = (read(n) for n in ("vehicles", "signals_daily", "events", "signal_catalog"))
    if command == "check":
        ids = [r.signal_id for r in catalog.select("signal_id").collect()]
        places = frozenset(r.signal_id for r in catalog.where("category = 'location_trips'").select("signal_id").collect())
        bad = [r for r in quality.schema_findings(vehicles, signals, events, ids).collect() if r["count"]]
        for r in bad:
            print(f"{r.level:8} {r.rule:28} {r['count']} {r.columns}")
        if bad:
            return 1
        rows = quality.findings(vehicles, signals, events, str(date.today()), ids, places).unionByName(quality.shape_findings(vehicles, signals, events)).collect()
        for r in rows:
            print(f"{r.level:8} {r.rule:28} {r['count']}")
        return int(any(r.level == "error" and r["count"] for r in rows))
    if command == "replay":
        store = runs.Runs(spark, rest[0])
        again, diff = study.replay(vehicles, signals, events, catalog, store.load(rest[1]), path)
        store.save(again, "replay", rest[1])
        rows = diff.orderBy("name").collect()
        for r in rows:
            print(f"{r.status:20} {r.name}")
        return int(any(r.status not in ("identical", "informational") for r in rows))
    target, horizon = rest[0], int(rest[1]) if len(rest) > 1 else 7
    result = study.run(vehicles, signals, events, catalog, study.Spec(target, target, horizon), path, print)
    if len(rest) > 2:
        runs.Runs(spark, rest[2]).save(result)
        print(runs.summary(result))
    print(study.render(spark, result))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
