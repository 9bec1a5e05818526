"""The tools over HTTP and as JSON-RPC lines, and models of other libraries."""

import io
import json
import sys
import threading
import types
import urllib.error
import urllib.request

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.errors import EngineError
from tidemark.functions.numeric import z_of
from tidemark.operators import external, forecaster
from tidemark.plans import surface

ROWS = [{"unique_id": u, "ds": f"2024-01-{d:02d}", "y": float(d + k)} for k, u in enumerate(("east/a", "east/b", "west/c")) for d in range(1, 21)]


@pytest.fixture(scope="module")
def call(spark):
    with surface.http_server(spark, port=0) as httpd:
        threading.Thread(target=httpd.serve_forever, daemon=True).start()

        def send(path, body=None):
            raw = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{httpd.server_port}{path}", data=raw), timeout=120) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        yield send
        httpd.shutdown()


def test_routes(call):
    assert call("/health")[1]["status"] == "ok" and {m["name"] for m in call("/models")[1]} >= {"naive", "theta", "auto_select"} and len(call("/mappings")[1]) == 10
    status, p = call("/preview", {"records": ROWS})
    assert status == 200 and p["n_rows"] == 60 and p["series"] == ["east/a", "east/b", "west/c"] and len(p["head"]) == 10
    status, f = call("/forecast", {"records": ROWS, "model": "drift", "h": 2})
    assert status == 200 and len(f["forecast"]) == 6 and f["forecast"][0]["yhat"] == pytest.approx(21) and "lo_80" in f["forecast"][0]
    assert len(call("/forecast", {"records": ROWS, "h": 2, "model_params": {"candidates": ["naive", "drift"], "val_h": 3}})[1]["forecast"]) == 6
    status, c = call("/compare", {"records": ROWS, "models": ["naive", "drift"], "h": 2, "n_windows": 2})
    assert [r["model"] for r in c["leaderboard"]] == ["drift", "naive"] and c["failures"] == []
    status, q = call("/quota", {"records": ROWS, "model": "drift", "h": 2, "quota": {"east/a": 10, "nobody": 1}})
    assert status == 200 and q["attainment"][0]["probability"] > 0.99 and q["unmatched"][0]["unique_id"] == "nobody"
    assert len(call("/quota", {"records": ROWS, "model": "reconciled", "h": 1, "quota": {"total": 60}})[1]["attainment"]) == 1


@pytest.mark.parametrize(
    "path, body, said",
    [
        ("/forecast", {"records": ROWS, "h": True}, "h: must be a whole number"), ("/forecast", {"records": ROWS, "model": "nope"}, "unknown model"), ("/preview", {"csv_path": "/etc/passwd"}, "unknown parameter"),
        ("/quota", {"records": ROWS}, "missing"), ("/quota", {"records": ROWS, "quota": {"zz": 1}, "model": "naive"}, "match no forecast"), ("/forecast", {"records": ROWS, "model": "ses", "model_params": {"x": 1}}, "invalid parameters"),
        ("/preview", b"{", "Expecting"), ("/preview", [1], "must be an object"), ("/preview", {"records": [1]}, "records"), ("/forecast", {"records": ROWS, "level": [80.5], "model": "naive"}, "level"),
    ],
)
def test_callers_faults_are_400(call, path, body, said):
    status, got = call(path, body)
    assert status == 400 and said in got["error"]


def test_unknown_routes(call):
    assert call("/nothing")[0] == 404 and call("/health", {})[0] == 404


def test_lines(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    pd.DataFrame(ROWS).to_csv(path, index=False)
    sent = [
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "forecast", "arguments": {"csv_path": path, "model": "naive", "h": 1}}},
        {"id": 4, "method": "tools/call", "params": {"name": "quota", "arguments": {"csv_path": path}}}, {"id": 5, "method": "tools/call", "params": {"name": "zz"}}, {"id": 6, "method": "zz"}, {"id": 7, "method": "ping"},
    ]
    out = io.StringIO()
    surface.serve_lines(spark, [*[json.dumps(x) for x in sent], "", "{no"], out)
    got = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["result"]["protocolVersion"] == "x" and len(got) == 8 and got[None]["error"]["code"] == -32700
    listed = {t["name"]: t["inputSchema"] for t in got[2]["result"]["tools"]}
    assert len(listed) == 6 and listed["quota"]["required"] == ["quota"] and "csv_path" in listed["forecast"]["properties"]
    assert len(json.loads(got[3]["result"]["content"][0]["text"])["forecast"]) == 3 and not got[3]["result"]["isError"]
    assert got[4]["result"]["isError"] and "missing" in got[4]["result"]["content"][0]["text"]
    assert got[5]["error"]["code"] == -32602 and got[6]["error"]["code"] == -32601 and got[7]["result"] == {}


# ---- other libraries, by stand-ins for their packages ----


def test_absent_packages_say_so():
    assert external.register_external() == []
    for of in (external.StatsForecastModel, external.NeuralForecastModel):
        with pytest.raises(EngineError, match="not installed"):
            of().run(np.arange(9.0), 2)
    with pytest.raises(EngineError, match="API_KEY"):
        external.TimeGPTModel().run(np.arange(9.0), 2)


def test_frames_and_bounds_of_other_libraries(monkeypatch):
    class Flat:
        def __init__(self, season_length):
            self.m = season_length

        def forecast(self, y, h, level):
            return {"mean": np.full(h, y[-self.m]), "lo-80": np.full(h, y[-1] - z_of(80)), "hi-80": np.full(h, y[-1] + z_of(80))}

    package, models = types.ModuleType("statsforecast"), types.ModuleType("statsforecast.models")
    models.Flat, package.__spec__ = Flat, importlib_spec("statsforecast")
    monkeypatch.setitem(sys.modules, "statsforecast", package)
    monkeypatch.setitem(sys.modules, "statsforecast.models", models)
    mean, sigma, _ = external.StatsForecastModel("Flat", 2).run(np.arange(9.0), 3)
    assert mean.tolist() == [7, 7, 7] and sigma == pytest.approx(1)
    with pytest.raises(EngineError, match="no model"):
        external.StatsForecastModel("Other").run(np.arange(9.0), 3)
    assert external.register_external() == ["statsforecast"] and external.register_external() == []
    forecaster.REGISTRY.pop("statsforecast")

    class Client:
        def forecast(self, df, h, freq, model, level):
            assert list(df.columns) == ["unique_id", "ds", "y"] and level == [80]
            return pd.DataFrame({"unique_id": "series", "ds": range(h), "TimeGPT": [1.0] * h, "TimeGPT-lo-80": [0.0] * h, "TimeGPT-hi-80": [2.0] * h})

    mean, sigma, _ = external.TimeGPTModel(client=Client()).run(np.arange(9.0), 2)
    assert mean.tolist() == [1, 1] and sigma == pytest.approx(1 / z_of(80))

    class Broken:
        def forecast(self, **more):
            raise RuntimeError("down")

    with pytest.raises(EngineError, match="down"):
        external.TimeGPTModel(client=Broken()).run(np.arange(9.0), 2)


def test_trained_nets_get_a_random_walks_bounds(monkeypatch):
    class Net:
        def __init__(self, models, freq):
            self.h = models[0]

        def fit(self, df):
            self.last = df["y"].iloc[-1]

        def predict(self):
            return pd.DataFrame({"unique_id": "series", "ds": range(self.h), "NHITS": [self.last] * self.h})

    package, models = types.ModuleType("neuralforecast"), types.ModuleType("neuralforecast.models")
    package.NeuralForecast, models.NHITS, package.__spec__ = Net, lambda h, max_steps: h, importlib_spec("neuralforecast")
    monkeypatch.setitem(sys.modules, "neuralforecast", package)
    monkeypatch.setitem(sys.modules, "neuralforecast.models", models)
    y = np.array([1.0, 3, 2, 5, 4])
    mean, sigma, _ = external.NeuralForecastModel().run(y, 4)
    assert mean.tolist() == [4] * 4 and sigma == pytest.approx(np.diff(y).std() * np.sqrt([1, 2, 3, 4]))


def importlib_spec(name):
    import importlib.machinery

    return importlib.machinery.ModuleSpec(name, None)
