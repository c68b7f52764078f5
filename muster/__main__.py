"""python -m muster run|validate|schema: what a scheduler calls."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="muster")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("schema", help="print the JSON schema of manifests")
    for name, what in (("run", "run a manifest"), ("validate", "columns after every step, without reading data")):
        own = sub.add_parser(name, help=what)
        own.add_argument("manifest")
        own.add_argument("--base", required=True, help="folder of the companies' files")
        own.add_argument("--organization", required=True)
        own.add_argument("--company", required=True)
    a = p.parse_args(args)

    from .plans.schemas import manifest_schema

    if a.what == "schema":
        print(json.dumps(manifest_schema(), indent=1))
        return 0

    from pyspark.sql import SparkSession

    from .plans.manifest import Environment, Manifest
    from .plans.run_log import ConfigStore, RunLog
    from .plans.runner import run, validate_pipeline
    from .sources.csv import Location

    spark = SparkSession.builder.appName("muster").getOrCreate()
    settings = ConfigStore(spark, f"{a.base}/_muster").get_settings(a.organization)
    env = Environment(spark, Location(a.base, a.organization, a.company), settings)
    manifest = Manifest.parse("".join(r[0] for r in spark.read.text(a.manifest, wholetext=True).collect()))
    if a.what == "validate":
        print(json.dumps(asdict(validate_pipeline(manifest, env))))
        return 0
    got = run(manifest, env, RunLog(spark, f"{a.base}/_muster/runs", a.organization, a.company))
    print(json.dumps(asdict(got)))
    return int(got.status != "success")


if __name__ == "__main__":
    sys.exit(main())
