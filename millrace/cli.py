"""python -m millrace.cli submit|run|cancel|status|results|jobs: one JSON line for each answer or record."""

from __future__ import annotations

import argparse
import json
import secrets
import sys
from pathlib import Path
from typing import TextIO

from millrace import results
from millrace.errors import MillraceError
from millrace.jobs import Catalogue
from millrace.limits import DEFAULT
from millrace.session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    top.add_argument("--root", required=True, help="folder of the job catalogue")
    top.add_argument("--master", default=None)
    commands = top.add_subparsers(dest="command", required=True)
    submit = commands.add_parser("submit", help="store a job; --run also runs it")
    submit.add_argument("--topology", required=True, help="JSON document of the job graph")
    submit.add_argument("--state", required=True, help="file that keeps the client's id and last sequence number")
    submit.add_argument("--run", action="store_true")
    for name in ("run", "status", "cancel", "results"):
        own = commands.add_parser(name)
        own.add_argument("--job", required=True)
        if name == "run":
            own.add_argument("--stream", action="store_true", help="in micro-batches, with progress in the status")
        if name == "cancel":
            own.add_argument("--expected-revision", type=int, required=True)
        if name == "results":
            own.add_argument("--page-bytes", type=int, default=DEFAULT.default_page_bytes)
            own.add_argument("--count-by", default="", help="print how often each value of this field occurs")
            own.add_argument("--top", type=int, default=0, help="with --count-by: only the most frequent (0: all)")
    commands.add_parser("jobs")
    commands.add_parser("overview", help="all jobs, and how many are in each state")
    return top


def _client(path: str) -> dict:
    file = Path(path)
    if not file.exists():
        file.write_text(json.dumps({"client": secrets.token_hex(16), "sequence": 0, "pending": None}))
    return json.loads(file.read_text())


def _submit(catalogue: Catalogue, topology: str, state: str) -> dict:
    """The request is kept until it is answered, so that a retry has the same identity."""
    own, document = _client(state), Path(topology).read_text()
    if own["pending"] is None:
        own |= {"sequence": own["sequence"] + 1, "pending": document}
        Path(state).write_text(json.dumps(own))
    try:
        answer = catalogue.submit(own["pending"], bytes.fromhex(own["client"]), own["sequence"])
    except MillraceError:
        Path(state).write_text(json.dumps(own | {"sequence": own["sequence"] - 1, "pending": None}))
        raise
    Path(state).write_text(json.dumps(own | {"pending": None}))
    return answer


def show_results(catalogue: Catalogue, job: str, page_bytes: int, field: str, top: int, out: TextIO) -> None:
    found, sink, total = catalogue.results(job), catalogue.sink_stage(job), 0
    if field:
        total, distinct = results.totals(found.rows, field)
        print(f"{'count':>8}  {field}", file=out)
        for row in results.count_by(found.rows, field, top).toLocalIterator():
            print(f"{row['count']:>8}  {row[field]}", file=out)
        print(f"{total:>8}  records, {distinct} distinct {field}", file=out)
    else:
        for row in results.pages(found, page_bytes):
            print(json.dumps(results.rendered(row, job, sink)), file=out)
            total += 1
    print(json.dumps({"command": "results", "job_id": job, "records": total, "complete": True}), file=out)


def main(args: list[str] | None = None, out: TextIO = sys.stdout) -> int:
    own = parser().parse_args(args)
    catalogue = Catalogue(session(master=own.master), own.root)
    try:
        if own.command == "submit":
            answer = _submit(catalogue, own.topology, own.state)
            print(json.dumps(answer), file=out)
            if own.run:
                print(json.dumps(catalogue.run(answer["job_id"])), file=out)
        elif own.command == "results":
            show_results(catalogue, own.job, own.page_bytes, own.count_by, own.top, out)
        elif own.command == "cancel":
            print(json.dumps(catalogue.cancel(own.job, own.expected_revision)), file=out)
        elif own.command == "run":
            print(json.dumps(catalogue.run(own.job, own.stream)), file=out)
        else:
            print(json.dumps(catalogue.status(own.job) if own.command == "status" else getattr(catalogue, own.command)()), file=out)
    except MillraceError as error:
        print(json.dumps({"error": type(error).__name__, "message": str(error), "retryable": error.retryable}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
