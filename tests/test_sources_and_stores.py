"""REST pages read once, the snapshot store's manifest, and the workspace."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.functions.errors import DataContractError, EngineError
from tidemark.operators import snapshots
from tidemark.plans import engine
from tidemark.plans.workspace import Workspace
from tidemark.sources import readers
from tidemark.sources.synthetic import panel_of


@pytest.fixture
def server():
    """An endpoint of three pages; calls holds (path, authorization) of each request."""
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append((self.path, self.headers.get("Authorization")))
            page = int(self.path.partition("p=")[2] or 1)
            body = {"data": {"rows": [{"id": 10 * page + k, "a": {"b": k}, "properties": {"amount": f"{page}.5"}, "on": True, "tags": [1, 2]} for k in range(2 if page < 3 else 1)]}}
            self.send_response(200 if "bad" not in self.path else 503)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", calls
    httpd.shutdown()


PAGES = {"records_path": "data.rows", "pagination": {"style": "page", "page_param": "p"}, "page_size": 2}


def test_a_source_is_read_once(spark, server):
    url, calls = server
    s = readers.RestSource(spark, f"{url}/x", headers={"Authorization": "Bearer s3cret"}, promote="properties", drop=("tags",), **PAGES)
    out = s.fetch()
    assert sorted(out.columns) == ["a.b", "amount", "id", "on"] and dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["on"] == "boolean"
    assert sorted(r.id for r in out.collect()) == [10, 11, 20, 21, 30] and out.filter("amount = '1.5'").count() == 2 and s.fetch().count() == 5
    assert [c[0].partition("?")[2] for c in calls] == ["p=1", "p=2", "p=3"] and {c[1] for c in calls} == {"Bearer s3cret"}
    assert "s3cret" not in out._jdf.queryExecution().toString()


def test_kept_pages_outlive_the_source(spark, server, tmp_path):
    url, calls = server
    at = str(tmp_path / "pages")
    readers.RestSource(spark, f"{url}/x", keep_at=at, **PAGES).fetch().count()
    assert spark.read.parquet(at).count() == 3 and len(calls) == 3


def test_truncation_and_errors_reach_the_driver(spark, server):
    url, _ = server
    with pytest.warns(UserWarning, match="max_pages=2"):
        assert readers.RestSource(spark, f"{url}/x", max_pages=2, **PAGES).fetch().count() == 4
    with pytest.raises(EngineError, match="HTTP 503"):
        readers.RestSource(spark, f"{url}/bad", **PAGES).fetch()
    with pytest.raises(EngineError, match="no list of records"):
        readers.RestSource(spark, f"{url}/x", records_path="data").fetch()


def test_sites_and_credentials():
    assert readers.site("https://h/x") == readers.site("https://H:443/y") != readers.site("http://h/x") and readers.site("http://h:81/") != readers.site("http://h/")
    c = readers.Credentials("https://h/x", {"X-Api-Key": "k", "Accept": "j"})
    assert c.at("https://h/other") == ({"X-Api-Key": "k", "Accept": "j"}, []) and c.at("https://evil/x") == ({"Accept": "j"}, ["X-Api-Key"])
    assert c.at("http://h/x")[1] == ["X-Api-Key"]


def test_styles_that_end():
    def pages(*bodies, **more):
        left = list(bodies)
        return readers.Pages("http://h/x", get=lambda *a: (200, json.dumps(left.pop(0))), **more)

    off = pages([{"id": 1}, {"id": 2}], [{"id": 3}], pagination={"style": "offset", "offset_param": "o"}, page_size=2)
    assert [r["id"] for r in off] == [1, 2, 3]
    with pytest.raises(EngineError, match="needs field"):
        list(pages({"data": [{"x": 1}], "has_more": True}, records_path="data", pagination={"style": "has_more"}))
    with pytest.raises(EngineError, match="no http address"):
        list(pages({"r": [], "n": "ftp://h/y"}, records_path="r", pagination={"style": "next_url", "next_path": "n"}))
    with pytest.raises(EngineError, match="no object"):
        list(pages([{"id": 1}, 7]))
    with pytest.raises(ValueError, match="style"):
        pages(pagination={"style": "magic"})


def test_records_of_mixed_kinds(spark):
    rows = [{"a": 1, "b": {"c": True}, "m": None}, {"a": 2.5, "b": {"c": None, "d": "x"}, "e": [1]}, {"a": 3, "m": "t", "w": 5}, {"w": "five"}]
    out = readers.load_records(spark, records=rows)
    got = {r["a"]: r.asDict() for r in out.collect()}
    assert dict(out.dtypes) == {"a": "double", "b.c": "boolean", "b.d": "string", "e": "string", "m": "string", "w": "string"}
    assert got[2.5]["b.d"] == "x" and got[2.5]["e"] == "[1]" and got[1.0]["b.c"] is True and got[None]["w"] == "five" and got[3.0]["w"] == "5"
    with pytest.raises(DataContractError):
        readers.load_records(spark, records=[{}])


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    s = snapshots.SnapshotStore(spark, str(tmp_path))
    p = panel_of(spark, [1.0, 2.0])
    whole, s._claim = s._claim, lambda entry: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        s.snapshot(p, "2024-01-01")
    s._claim = whole
    assert s.manifest().count() == 0
    s.snapshot(p, "2024-01-01")
    assert s.load().count() == 2 and s.history().count() == 2 and [r.revision for r in s.manifest().collect()] == [0]


def test_two_writers_of_one_revision(spark, tmp_path):
    a, b = (snapshots.SnapshotStore(spark, str(tmp_path)) for _ in range(2))
    whole = a._claim

    def late(entry):
        if entry["revision"] == 0 and not b.manifest().count():
            b.snapshot(panel_of(spark, [5.0]), "2024-01-01")
        return whole(entry)

    a._claim = late
    a.snapshot(panel_of(spark, [1.0, 2.0]), "2024-01-01")
    assert [r.rows for r in a.manifest().collect()] == [1, 2] and a.load().count() == 2 and a.history().groupBy("revision").count().count() == 2


def test_manifest_that_cannot_be_read(spark, tmp_path):
    s = snapshots.SnapshotStore(spark, str(tmp_path))
    s.snapshot(panel_of(spark, [1.0]), "2024-01-01")
    (tmp_path / "manifest" / "panel-2024-01-01-1.json").write_text("{no json")
    with pytest.raises(EngineError, match="cannot be read"):
        s.manifest()


def test_workspace_round_trip_and_refusals(spark, tmp_path):
    home = tmp_path / "home"
    w = Workspace.load(home)
    assert w.settings["h"] == 6 and w.panel(spark).count() > 0
    csv = tmp_path / "a.csv"
    csv.write_text("unique_id,ds,y\nx,2024-01-01,1\nx,2024-01-02,2\ny,2024-01-01,3\n")
    w.sources, w.watch, w.alerts = [{"path": str(csv)}], ["x"], [{"kind": "forecast_below", "series": "*", "threshold": 9}]
    w.save()
    again = Workspace.load(home)
    assert again.sources[0]["overrides"] == {} and again.watch == ["x"] and not list(home.glob(".*"))
    p = again.panel(spark)
    assert p.count() == 3 and again.watched(p).count() == 2
    f = engine.Engine(["naive"]).forecast(p.filter("unique_id = 'x'"), 1)
    assert [r.kind for r in engine.alerts(f, None, again.rules(spark)).collect()] == ["forecast_below"]
    again.sources.append({"path": str(tmp_path / "none.csv")})
    with pytest.raises(EngineError, match="none.csv"):
        again.panel(spark)
    again.sources[1] = {"path": str(csv)}
    with pytest.raises(EngineError, match="do not go together"):
        again.panel(spark)
    for raw, said in (("[]", "no object"), ("{x", "cannot be read"), ('{"watch": {}}', "watch"), ('{"settings": {"h": true}}', "settings.h"), ('{"settings": {"level": "high"}}', "settings.level"), ('{"alerts": [1]}', r"alerts\[0\]"), ('{"sources": [{"overrides": [1]}]}', "overrides")):
        (home / "workspace.json").write_text(raw)
        with pytest.raises(EngineError, match=said):
            Workspace.load(home)
    (home / "workspace.json").write_text('{"settings": {"season_length": null, "refresh_seconds": null, "own": 1}}')
    assert Workspace.load(home).settings["own"] == 1


def test_dashboard_survives_a_bad_series(spark):
    rows = [("good", i, float(i)) for i in range(8)] + [("bad", 0, 4.0)]
    p = spark.createDataFrame(rows, "unique_id string, ds long, y double")
    got = {r.unique_id: r for r in engine.dashboard(p).collect()}
    assert got["bad"].next == 4.0 and got["bad"].delta_pct == 0 and got["good"].spark == "▁▂▃▄▅▆▇█" and got["bad"].spark == "▄" and F is not None
