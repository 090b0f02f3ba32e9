"""python -m tidemark analyze|scan|explain|multi|watch ..."""

from __future__ import annotations

import argparse
import json
import sys

from tidemark.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("command", choices=["analyze", "scan", "explain", "multi", "watch"])
    parser.add_argument("sources", nargs="+")
    parser.add_argument("--mode", default="fast", choices=["fast", "exact"])
    parser.add_argument("--sensitivity", default="normal", choices=["low", "normal", "high"])
    parser.add_argument("--format")
    parser.add_argument("--html")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--fail-on")
    parser.add_argument("--limit", type=int, default=20)
    a = parser.parse_args(argv)
    from tidemark import api

    spark = session()
    first = a.sources[0]
    if a.command == "multi":
        from tidemark.plans import multisource
        from tidemark.sources import files

        named = {s.id: api.entries(files.dispatch(spark, s.target, s.id), a.format) for s in files.parse_specs(a.sources)}
        scored, cross = multisource.analyse(named)
        multisource.summary(scored).show(a.limit, False)
        cross.show(a.limit, False)
        return 0
    if a.command == "scan":
        api.analyse(spark, first, mode="turbo", sensitivity=a.sensitivity, fmt=a.format).show(a.limit, False)
        return 0
    if a.command == "watch":
        from tidemark.streaming.watch import watch

        said = watch(spark, " ".join(a.sources), lambda rows: [print(f"{r['score']:.2f} {r['level']} {r['service']}: {r['message']}", flush=True) for r in rows], a.format)
        print(json.dumps(said.summary() | {"load": said.load.to_dict()}))
        return 2 if a.fail_on and said.hits else 0
    found = api.analyse(spark, first, mode=a.mode, sensitivity=a.sensitivity, fmt=a.format)
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(found.to_html())
    if a.json:
        print(found.to_json())
    elif a.command == "explain":
        found.explain().show(a.limit, False)
    else:
        found.families.limit(a.limit).show(a.limit, False)
    return 2 if a.fail_on and found.fails(a.fail_on) else 0


if __name__ == "__main__":
    sys.exit(main())
