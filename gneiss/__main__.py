"""The gateway from a shell: ``python -m gneiss tools | call TOOL JSON | serve``.

``serve`` reads one JSON request a line ({"id", "tool", "arguments"}) from standard
input and writes one answer a line; it ends with the input. Settings come from
flags, else from GNEISS_NAME, GNEISS_PAGE_SIZE, GNEISS_QUERY_TIMEOUT and
GNEISS_READ_ONLY, else from GatewayConfig.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from gneiss.config import GatewayConfig
from gneiss.errors import SqlError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gneiss", description="SQL gateway over a Spark session")
    out.add_argument("--name", help="the gateway's own database")
    out.add_argument("--page-size", type=int)
    out.add_argument("--query-timeout", type=float, help="seconds; 0: none")
    out.add_argument("--read-only", choices=("true", "false"))
    out.add_argument("--data", help="a folder of Parquet tables to serve as views")
    todo = out.add_subparsers(dest="todo", required=True)
    todo.add_parser("tools")
    todo.add_parser("serve")
    call = todo.add_parser("call")
    call.add_argument("tool")
    call.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    return out


def answer(registry, request: dict) -> dict:
    """The reply to one request; errors are replies too."""
    told = {"id": request.get("id")}
    try:
        return told | {"result": registry.call_tool(request["tool"], **request.get("arguments", {}))}
    except SqlError as e:
        return told | {"error": {"code": e.code, "kind": type(e).__name__, "message": str(e)}}
    except (KeyError, TypeError) as e:
        return told | {"error": {"code": -32602, "kind": "InvalidRequest", "message": str(e)}}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    given = {"name": args.name, "page_size": args.page_size, "query_timeout": args.query_timeout, "read_only": args.read_only and args.read_only == "true"}
    config = GatewayConfig.from_environment(**{k: v for k, v in given.items() if v is not None}).validate()

    from gneiss import sources
    from gneiss.gateway import Gateway
    from gneiss.operators.registry import Registry
    from gneiss.session import build_session

    spark = build_session()
    if args.data:
        sources.register_folder(spark, args.data)
    registry = Registry(Gateway(spark, config))
    if args.todo == "tools":
        for tool in registry.list_tools():
            print(json.dumps(asdict(tool)))
        return 0
    if args.todo == "call":
        told = answer(registry, {"tool": args.tool, "arguments": json.loads(args.arguments)})
        print(json.dumps(told.get("result", told.get("error"))))
        return "error" in told
    for line in sys.stdin:
        if line.strip():
            print(json.dumps(answer(registry, json.loads(line))), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
