"""Command line: lint and check requirements, compile and inspect runs. `python -m runlens.cli check runs.parquet reqs.csv`."""

from __future__ import annotations

import argparse
import json
import sys

from runlens import api, sinks
from runlens.plans.compile import manifest
from runlens.plans.policy import PolicyError
from runlens.reqs import config
from runlens.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="runlens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("check", ("frame", "requirements")), ("lint", ("frame", "requirements")), ("compile", ("samples", "policy")), ("inspect", ("samples",))):
        c = commands.add_parser(name)
        for w in words:
            c.add_argument(w)
        c.add_argument("--output")
        if name in ("check", "lint"):
            c.add_argument("--mapping", action="append", default=[])
            c.add_argument("--set", action="append", default=[], dest="overrides")
            c.add_argument("--fail-on", default="fail", choices=("fail", "warn"))
            c.add_argument("--xlsx")
        if name == "compile":
            c.add_argument("--max-size")
    args = parser.parse_args(argv)
    spark = get_session()
    try:
        if args.command in ("check", "lint"):
            from runlens.plans.policy import parse

            doc = config.layer(*[parse(open(m).read())[0] for m in args.mapping], overrides=tuple(args.overrides))
            frame = spark.read.parquet(args.frame)
            scope = config.scope_of(doc, frame)
            frame = config.attach_events(frame, doc, scope)
            reqs = api.load(args.requirements)
            if args.command == "lint":
                issues = api.lint(reqs, frame, scope)
                print("\n".join(issues))
                return api.EXIT_USAGE if issues else api.EXIT_OK
            out = api.check(frame, reqs, scope, config.rules_of(doc))
            if args.output:
                sinks.write_runs(out.results, args.output)
            if args.xlsx:
                sinks.write_atomic(args.xlsx, sinks.results_workbook(out.results, out.stats))
            print(json.dumps(sinks.summary(out.results)))
            return out.exit_code(args.fail_on)
        samples = spark.read.parquet(args.samples)
        if args.command == "inspect":
            api.inspect(samples).orderBy("run_id", "signal").show(100, False)
            return api.EXIT_OK
        compiled, policy = api.compile_runs(samples, open(args.policy).read(), max_size=args.max_size)
        if args.output:
            sinks.write_retained(compiled.retained, args.output)
        rows = [r.asDict() for r in manifest(samples, compiled, policy).collect()]
        print(json.dumps(rows, default=str))
        return api.EXIT_INFEASIBLE if any(r["status"] == "infeasible" for r in rows) else api.EXIT_OK
    except (PolicyError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return api.EXIT_USAGE


if __name__ == "__main__":
    sys.exit(main())
