"""Command line: health, scan, analyze. Errors never repeat what was typed."""

from __future__ import annotations

import argparse
import sys

from .errors import EngineError, InvalidArguments, envelope


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise InvalidArguments()


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="lumenveil", add_help=True)
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("health", "scan", "analyze"):
        sub = commands.add_parser(name)
        sub.add_argument("--json", action="store_true")
        if name != "health":
            sub.add_argument("--path", required=True)
            sub.add_argument("--policy")
            sub.add_argument("--audit-log")
        if name == "analyze":
            sub.add_argument("--task", required=True)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    as_json = "--json" in args
    try:
        got = parser().parse_args(args)
        from .plans import api

        if got.command == "health":
            result = api.health()
        else:
            if spark is None:
                from pyspark.sql import SparkSession

                spark = SparkSession.builder.appName("lumenveil").getOrCreate()
            if got.command == "scan":
                result = api.scan(spark, got.path, got.policy, got.audit_log)
            else:
                result = api.analyze(spark, got.task, got.path, got.policy, got.audit_log)
        sys.stdout.write((api.to_json(result) if got.json else api.human_report(got.command, result)) + "\n")
        return 0
    except ModuleNotFoundError:
        from .errors import RuntimeUnavailable

        return _fail(RuntimeUnavailable(), as_json, 2)
    except EngineError as error:
        return _fail(error, as_json, 1)
    except Exception as error:
        return _fail(error, as_json, 1)


def _fail(error: BaseException, as_json: bool, code: int) -> int:
    body = envelope(error)
    if as_json:
        from .operators.capsule import stable_json

        sys.stderr.write(stable_json(body) + "\n")
    else:
        sys.stderr.write(f"ERROR {body['error']['code']}: {body['error']['message']}\n")
    return code


if __name__ == "__main__":
    raise SystemExit(main())
