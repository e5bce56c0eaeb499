"""The operators over HTTP, with the standard library's server: ``python -m ledgerloom.service --work FOLDER``.

Bodies and answers are JSON; tables travel as CSV text inside them. What comes in is written to a folder of its own below
``--work``, which must be one that Spark's executors reach, and goes when the answer is out. One session serves all.

    GET /  GET /health  GET /rulepacks
    POST /rules/validate  {"rules"}
    POST /process    {"input", "rules", "packs", "audit_mode", "verify", + reading options}
    POST /discover   {"input", "min_count", "min_amount", "since", "top_k"}
    POST /suggest    {"candidates": [rows], "existing", "prefix", "category", "emit_match"}
    POST /reconcile  {"input", "rules", "packs", "external", "fields", "key", "identity_fields", "date_format"}
    POST /impact     {"input", "rules", "packs", "candidate"}

200: done, with ``exit_code`` 3 where there is something to review; 400 and 422: a request or rows that aren't valid; 401: no
or another key; 413: too large; 504: stopped after ``--seconds``, its Spark jobs with it.
"""

from __future__ import annotations

import argparse
import csv
import hmac
import json
import os
import shutil
import tempfile
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerloom import cli
from ledgerloom.operators.discover import suggest
from ledgerloom.plans.packs import PACKS, as_text, pack
from ledgerloom.plans.rules import RuleError, inert, parse_rules

LIMIT, SECONDS = 100 << 20, 300
READING = ("encoding", "delimiter", "decimal", "thousands", "date_format", "fail_threshold")


class Problem(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def csv_rows(folder: Path) -> list[dict]:
    return [row for path in sorted(folder.glob("*.csv")) for row in csv.DictReader(path.open(encoding="utf-8", newline=""))]


class Service:
    """The endpoints as functions of a request's body."""

    def __init__(self, spark: SparkSession | None, work: str, seconds: float = SECONDS):
        self.spark, self.work, self.seconds = spark, Path(work), seconds

    def get(self, path: str) -> dict:
        if path == "/":
            return {"service": "ledgerloom", "endpoints": ["/health", "/rulepacks", *self.posts()]}
        if path == "/health":
            return {"status": "ok"}
        if path == "/rulepacks":
            return {"packs": {name: len(pack(name)) for name in PACKS}}
        raise Problem(404, f"no {path}")

    def posts(self) -> dict:
        return {"/rules/validate": self.validate, "/process": self.process, "/discover": self.discover, "/suggest": self.suggest, "/reconcile": self.reconcile, "/impact": self.impact}

    def post(self, path: str, body: dict) -> dict:
        if path not in self.posts():
            raise Problem(404, f"no {path}")
        self.work.mkdir(parents=True, exist_ok=True)
        folder = Path(tempfile.mkdtemp(dir=self.work))
        try:
            return self.posts()[path](body, folder)
        except RuleError as error:
            raise Problem(422, str(error)) from None
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def _files(self, body: dict, folder: Path, *names: str) -> list[str]:
        for name in names:
            if not isinstance(body.get(name), str):
                raise Problem(400, f"{name!r} is missing")
            (folder / name).write_text(body[name], encoding="utf-8")
        rules = [parse_rules(body.get("rules") or "")] if "rules" in body else []
        (folder / "rules").write_text(body.get("rules") or "", encoding="utf-8")
        options = [x for name in READING if body.get(name) is not None for x in (f"--{name.replace('_', '-')}", str(body[name]))]
        options += [f"--{name}" for name in ("dayfirst", "strict-parse") if body.get(name.replace("-", "_"))]
        if rules or body.get("packs"):
            options += ["--rules", str(folder / "rules"), *(x for name in body.get("packs") or () for x in ("--pack", name))]
        return ["--input", str(folder / "input"), *options]

    def _run(self, args: list[str]) -> int:
        late, group, context = threading.Event(), uuid.uuid4().hex, self.spark.sparkContext

        def stop() -> None:
            late.set()
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)

        timer = threading.Timer(self.seconds, stop)
        context.setJobGroup(group, args[0], interruptOnCancel=True)
        timer.start()
        try:
            code = cli.main(args, self.spark)
        except Exception:
            if late.is_set():
                raise Problem(504, f"stopped after {self.seconds} s") from None
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if code in (cli.FAILED, cli.INVALID):
            raise Problem(422, "the input can't be used with these options")
        return code

    def validate(self, body: dict, folder: Path) -> dict:
        rules = parse_rules(body.get("rules") or "")
        shown = [{"name": r.name, "match": [c.source for c in r.match], "set": [a.source for a in r.set]} for r in rules]
        return {"valid": True, "rules": shown, "inert": inert(rules)}

    def process(self, body: dict, folder: Path) -> dict:
        mode = body.get("audit_mode", "lite")
        args = ["categorise", *self._files(body, folder, "input"), "--output", str(folder / "out"), "--audit", str(folder / "audit.json"), "--audit-mode", mode, "--report-dir", str(folder / "report")]
        code = self._run(args + (["--verify", body["verify"]] if body.get("verify") else []))
        audit, report = folder / "audit.json", folder / "report" / "verify_report.json"
        return {"exit_code": code, "rows": csv_rows(folder / "out"), "audit": json.loads(audit.read_text()) if audit.exists() else [], "verify": json.loads(report.read_text()) if report.exists() else None}

    def discover(self, body: dict, folder: Path) -> dict:
        options = [x for name in ("min_count", "min_amount", "since", "top_k") if body.get(name) is not None for x in (f"--{name.replace('_', '-')}", str(body[name]))]
        self._run(["discover", *self._files(body, folder, "input"), "--output", str(folder / "out"), *options])
        return {"candidates": csv_rows(folder / "out")}

    def suggest(self, body: dict, folder: Path) -> dict:
        drafts = suggest(body.get("candidates") or [], body.get("prefix", "Suggested"), body.get("category", "Review"), body.get("existing", ""), body.get("emit_match", "fuzzy"))
        return {"rules": "\n".join(d.text for d in drafts), "count": len(drafts)}

    def reconcile(self, body: dict, folder: Path) -> dict:
        args = ["reconcile", *self._files(body, folder, "input", "external"), "--external", str(folder / "external"), "--report-dir", str(folder / "report")]
        for name, option in (("fields", "--fields"), ("key", "--key"), ("identity_fields", "--identity-fields"), ("date_format", "--external-date-format")):
            args += [option, str(body[name])] if body.get(name) else []
        code, report = self._run(args), folder / "report"
        return {"exit_code": code, "report": json.loads((report / "reconcile_report.json").read_text()), **{k: csv_rows(report / f"reconcile_{k}") for k in ("mismatches", "orphans_ledger", "orphans_external")}}

    def impact(self, body: dict, folder: Path) -> dict:
        args = ["impact", *self._files(body | {"rules": (body.get("rules") or "") + "\n" + as_text([r for name in body.get("packs") or () for r in pack(name)]), "packs": []}, folder, "input", "candidate"), "--candidate", str(folder / "candidate"), "--report-dir", str(folder / "report")]
        code = self._run(args)
        return {"exit_code": code, "report": json.loads((folder / "report" / "impact_report.json").read_text()), "changes": csv_rows(folder / "report" / "impact_changes")}


def server(service: Service, host: str = "127.0.0.1", port: int = 0, key: str | None = None, limit: int = LIMIT) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, content: dict) -> None:
            data = json.dumps(content, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_one(self, run) -> None:
            try:
                if key and self.path not in ("/", "/health") and not hmac.compare_digest(self.headers.get("X-API-Key", ""), key):
                    raise Problem(401, "no or another key")
                self.answer(200, run())
            except Problem as problem:
                self.answer(problem.status, {"error": str(problem)})
            except Exception as error:
                self.answer(500, {"error": type(error).__name__})

        def do_GET(self) -> None:  # noqa: N802
            self.handle_one(lambda: service.get(self.path.partition("?")[0]))

        def do_POST(self) -> None:  # noqa: N802
            def run() -> dict:
                size = int(self.headers.get("Content-Length") or 0)
                if size > limit:
                    raise Problem(413, f"more than {limit} bytes")
                try:
                    body = json.loads(self.rfile.read(size) or b"{}")
                except ValueError:
                    raise Problem(400, "the body isn't JSON") from None
                if not isinstance(body, dict):
                    raise Problem(400, "the body isn't an object")
                return service.post(self.path, body)

            self.handle_one(run)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    options.add_argument("--work", required=True)
    options.add_argument("--host", default="127.0.0.1")
    options.add_argument("--port", type=int, default=8000)
    options.add_argument("--seconds", type=float, default=SECONDS, help="how long a request may take")
    args = options.parse_args()
    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    server(Service(spark, args.work, args.seconds), args.host, args.port, os.environ.get("LEDGER_API_KEY")).serve_forever()


if __name__ == "__main__":
    main()
