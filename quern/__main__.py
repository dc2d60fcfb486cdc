"""python -m quern identity|pack|plan|list|segments|extract|verify: see --help."""

from __future__ import annotations

import argparse
import json
import sys

from quern import api
from quern.errors import InvalidInput, ReleaseError
from quern.plans.pack import Options
from quern.schema import MIB
from quern.sources import identity, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--project", default="project")
    p.add_argument("--keys", help="file with the publisher's identity or, to read, with the keys of readers")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("identity", help="make a publisher's identity, or the keys of its readers")
    v.add_argument("what", choices=("create", "export"))
    v.add_argument("file")
    v.add_argument("to", nargs="?")
    for verb in ("pack", "plan"):
        v = verbs.add_parser(verb)
        v.add_argument("source")
        v.add_argument("output")
        v.add_argument("--deferred", action="append", default=[], help="prefix of assets that may be installed later")
        v.add_argument("--full", action="store_true", help="reuse nothing of the last release")
        v.add_argument("--dev-cache", action="store_true", help="do not read files again whose stamp is unchanged")
        v.add_argument("--zstd-level", type=int, default=3)
        v.add_argument("--segment-mib", type=int, default=512)
    for verb in ("list", "segments", "verify"):
        v = verbs.add_parser(verb)
        v.add_argument("output")
        v.add_argument("--at-least", type=int, help="refuse a release older than this")
    v = verbs.add_parser("extract")
    v.add_argument("output")
    v.add_argument("target")
    return p


def run(a: argparse.Namespace, spark) -> None:
    show = lambda df: [print(json.dumps(r.asDict())) for r in df.toLocalIterator()]
    if a.verb == "identity":
        if a.what == "create":
            made = identity.Publisher.create(spark)
            identity.save(made, a.file)
            print(json.dumps({"created": a.file, "project": made.project, "public": made.public}))
        elif a.to is None:
            raise InvalidInput("identity export needs the file to write")
        else:
            identity.save(_publisher(a.file).reader(), a.to)
            print(json.dumps({"created": a.to}))
        return
    keys = identity.load(a.keys) if a.keys else None
    project = keys.project if keys else a.project
    if a.verb in ("pack", "plan"):
        options = Options(deferred=a.deferred, segment_target=a.segment_mib * MIB, zstd_level=a.zstd_level, development_cache=a.dev_cache)
        api.check_places(a.source, a.output, a.keys)
        if a.verb == "plan":
            show(api.plan_directory(spark, a.source, a.output, project, options, keys).orderBy("path"))
        else:
            said = lambda phase: print(phase, file=sys.stderr)
            print(json.dumps(api.pack_directory(spark, a.source, a.output, project, options, not a.full, said, _publisher(a.keys) if a.keys else None)))
    elif a.verb == "list":
        show(store.open_release(spark, a.output, project, a.at_least, keys).list_assets())
    elif a.verb == "segments":
        show(store.open_release(spark, a.output, project, a.at_least, keys).list_segments())
    elif a.verb == "extract":
        show(api.extract_release(spark, a.output, a.target, project, keys))
    else:
        print(api.verify_release(spark, a.output, project, a.at_least, keys), "blocks verified")


def _publisher(file: str) -> identity.Publisher:
    keys = identity.load(file)
    if not isinstance(keys, identity.Publisher):
        raise InvalidInput(f"not a publisher's identity: {file}")
    return keys


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    try:
        run(a, SparkSession.builder.getOrCreate())
    except (ReleaseError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
