from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from ledgerloom.service import Problem, Service, server

INPUT = "date,counterparty,amount,memo\n2025-01-01,Yellow Cab,-5.00,a\n2025-01-02,Shop,10,b\n"
RULES = 'rule "Cab" {\n match:\n  - counterparty ~ "*cab*"\n set:\n  - category = "Transport"\n}\n'


@pytest.fixture(scope="module")
def call(spark, tmp_path_factory):
    http = server(Service(spark, str(tmp_path_factory.mktemp("work"))), key="k", limit=10_000)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def one(path, body=None, key="k"):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data, {"X-API-Key": key})
        try:
            with urllib.request.urlopen(request, timeout=300) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    yield one
    http.shutdown()


def test_plain_endpoints(call):
    assert call("/health", key="")[1] == {"status": "ok"}
    assert "/process" in call("/")[1]["endpoints"]
    assert call("/rulepacks")[1]["packs"]["retail"] == 7
    assert call("/rulepacks", key="x")[0] == 401
    assert call("/none")[0] == 404
    assert call("/none", {})[0] == 404
    assert call("/process", b"{")[0] == 400
    assert call("/process", {})[0] == 400
    assert call("/process", {"input": "x" * 20_000})[0] == 413
    assert call("/rules/validate", {"rules": RULES})[1]["rules"][0]["match"] == ['counterparty ~ "*cab*"']
    assert call("/rules/validate", {"rules": RULES.replace("category", "date")})[0] == 422


def test_operators(call):
    status, out = call("/process", {"input": INPUT, "rules": RULES, "audit_mode": "full", "verify": "fast"})
    assert status == 200
    assert [r["category"] for r in out["rows"]] == ["Transport", ""]
    assert out["audit"][0]["rule"] == "Cab"
    assert out["verify"]["success"]
    found = call("/discover", {"input": INPUT, "min_count": 1})[1]["candidates"]
    assert len(found) == 2
    drafts = call("/suggest", {"candidates": found, "existing": RULES.replace("cab", "CAB")})[1]
    assert drafts["count"] >= 1
    external = "date,counterparty,amount,category\n2025-01-01,yellow cab,-5,Taxi\n2025-01-02,shop,10,\n"
    out = call("/reconcile", {"input": INPUT, "rules": RULES, "external": external, "key": "date,amount,counterparty"})[1]
    assert (out["exit_code"], len(out["mismatches"])) == (3, 1)
    out = call("/impact", {"input": INPUT, "rules": RULES, "packs": ["sanity"], "candidate": RULES.replace("Transport", "Travel")})[1]
    assert (out["exit_code"], out["report"]["behavioural_changed"], len(out["changes"])) == (3, 1, 1)
    assert call("/process", {"input": "a,b\n1,2\n", "rules": RULES})[0] == 422


def test_a_request_that_takes_too_long_is_stopped(spark, tmp_path):
    service = Service(spark, str(tmp_path), seconds=0.05)
    with pytest.raises(Problem) as problem:
        service.post("/process", {"input": INPUT, "rules": RULES})
    assert problem.value.status == 504
    assert Service(spark, str(tmp_path)).post("/discover", {"input": INPUT, "min_count": 1})["candidates"]
