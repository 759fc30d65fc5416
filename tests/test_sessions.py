"""Session engine, sources, files and messages."""

import json
import threading
import time
from datetime import datetime

import pytest

from quern.operators.sessions import Engine
from quern.sources import catalog, files
from quern.streaming import messages


class Clock:
    now = 1_700_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "bucket"), Clock(), sleep=lambda s: None)
    e.create_cluster("c", s3_bucket_arn="arn:aws:s3:::bucket/*")
    return e


def test_clusters(engine):
    assert engine.create_cluster().name == "Cluster 2"
    with pytest.raises(ValueError, match="exists"):
        engine.create_cluster("c")
    with pytest.raises(ValueError):
        engine.create_cluster("d", min_num_workers=9, initial_num_workers=1)
    assert {r.name for r in engine.get_running_clusters().collect()} == {"c", "Cluster 2"}
    engine.destroy_cluster("c")
    assert engine.get_cluster_status("c") == "terminated" and {r.name for r in engine.get_running_clusters().collect()} == {"Cluster 2"}
    with pytest.raises(RuntimeError):
        engine.wait_for_cluster("c")
    for change in (engine.update_cluster, engine.assert_cluster_is_ready):
        with pytest.raises(ValueError, match="may not follow 'terminated'"):
            change("c")
    assert engine.create_cluster("c").status == "running" and engine.get_cluster_s3_bucket_name("c") == "bucket"
    engine.update_cluster("c")
    engine.assert_cluster_is_ready("c")
    engine.clusters["c"].status = "failed"
    with pytest.raises(RuntimeError, match="failed"):
        engine.get_cluster_status("c")
    engine.delete_cluster("Cluster 2")
    with pytest.raises(KeyError):
        engine.get_cluster("Cluster 2")
    assert engine.get_clusters("c").count() == 1


@pytest.mark.parametrize("status", [None, "creating", "running", "failed", "completed", "invalid_status"])
def test_sessions_by_status(engine, status):
    a = engine.start_session("c", 2)
    engine.end_session(a, failed=True)
    engine.end_session(engine.start_session("c", 2))
    engine.start_session("c", 2)
    rows = engine.get_sessions(status=status).collect()
    assert all(r.status == status for r in rows) if status else len(rows) == 3
    assert engine.get_sessions(limit=1).count() == 1 and engine.get_sessions("none").count() == 0
    engine.end_all_sessions("c")
    assert engine.get_running_sessions().count() == 0


def test_sessions_come_in_pages_that_the_catalog_filters(engine, monkeypatch):
    engine.page = 2
    ids = []
    for k in range(5):
        ids.append(engine.start_session("c", 1))
        engine.clock.now += 1
    engine.end_session(ids[0])
    rows = engine.get_sessions().collect()
    assert sorted(r.session_id for r in rows) == sorted(ids) and engine.get_sessions().columns == [c.split()[0] for c in catalog.SESSIONS.split(", ")]
    assert {r.end_time is None for r in rows if r.session_id != ids[0]} == {True} and next(r for r in rows if r.session_id == ids[0]).end_time > rows[0].start_time
    assert [r.session_id for r in engine.get_sessions("c", ["running", "creating"], limit=2).collect()] == [ids[4], ids[3]]
    asked = []

    def fetch_of(records, names, size):
        fetch = catalog_pages(records, names, size)
        return lambda filters, cursor: ([(*r[:2], json.dumps(filters, sort_keys=True), *r[3:]) for r in fetch(filters, cursor)[0]], fetch(filters, cursor)[1])

    catalog_pages = catalog.pages_of
    monkeypatch.setattr(catalog, "pages_of", fetch_of)
    asked = {r.status_explanation for r in engine.get_sessions("c", "running").collect()}
    assert asked == {json.dumps({"cluster_name": "c", "status": "running"})}  # both filters reached the pages


def test_lifecycle_and_current_session(engine):
    with pytest.raises(RuntimeError):
        engine.get_session_id()
    a = engine.start_session(nworkers=2, session_name="job")
    assert a.startswith("job-") and engine.get_session_id() == a and engine.get_cluster_name() == "c"
    assert engine.get_session().sample_rate == 2 and engine.get_session_status() == "running"
    b = engine.start_session("c", 4)
    engine.get_session(a).spark.range(1).createOrReplaceTempView("only_mine")
    assert not engine.get_session(b).spark.catalog.tableExists("only_mine")
    engine.end_session(a)
    assert engine.get_session_id() == b  # ending another session leaves the current one
    with pytest.raises(RuntimeError):
        engine.wait_for_session(a)
    with pytest.raises(KeyError):
        engine.set_session("unknown")
    engine.end_session()
    with pytest.raises(RuntimeError):
        engine.get_session_id()


def test_resources_are_used_again(engine):
    def use(n, **end):
        id = engine.start_session("c", n, release_resources_after=5)
        r = engine.get_session(id).resource_id
        engine.clock.now += 60
        engine.end_session(id, **end)
        return r

    first = use(2)
    engine.clock.now += 60
    assert use(2) == first
    other = use(4)
    assert other != first
    engine.clock.now += 5 * 60 + 1
    again = use(2)
    assert again != first
    assert use(2, release_resources_now=True) == again
    assert use(2) != again


def test_run_session(engine, tmp_path, capsys):
    assert engine.run_session(lambda w: w.gather((w.rank + 1) ** 2), "c", 2, print_logs=True) == [[1, 4], None]
    assert "2 workers" in capsys.readouterr().out and not list((tmp_path / "bucket").glob("quern-log*"))
    script = tmp_path / "run_it.py"
    script.write_text("worker.log('adds ten')\nresult = worker.gather(worker.rank + 10)")
    assert engine.run_session([f"file://{script}"], "c", 2, store_logs=True) == [[10, 11], None]
    done = engine.get_sessions(status="completed").collect()
    assert len(done) == 2
    log = next((tmp_path / "bucket").glob("quern-log-for-session-*"))
    id = log.name.removeprefix("quern-log-for-session-")
    assert log.read_text().splitlines()[1:] == ["worker 0: adds ten", "worker 1: adds ten"]
    assert open(files.download_log(id, engine.folder, str(tmp_path / "log"))).read() == log.read_text()

    def fail(w):
        raise ValueError(f"Error on worker {w.rank}")

    with pytest.raises(Exception, match="Error on worker"):
        engine.run_session(fail, "c", 2)
    assert engine.get_sessions(status="failed").count() == 1
    with pytest.raises(RuntimeError):
        engine.get_session_id()


def test_files_may_go_once_they_are_shipped(engine, tmp_path):
    from pyspark import SparkFiles

    own = tmp_path / "shipped.txt"
    own.write_text("kept")
    id = engine.start_session("c", 2, files_=[f"file://{own}"])
    own.unlink()
    with engine.tagged(id) as spark:  # no task has fetched it before
        assert spark.sparkContext.parallelize(range(2), 2).map(lambda _: open(SparkFiles.get("shipped.txt")).read()).collect() == ["kept"] * 2
    own.write_text("kept")
    assert engine.get_session(engine.start_session("c", 2, files_=[str(own)])).files == ["shipped.txt"]
    own.write_text("other")
    with pytest.raises(ValueError, match="another file 'shipped.txt'"):
        engine.start_session("c", 2, files_=[str(own)])
    assert engine.spark.sparkContext.parallelize(range(2), 2).count() == 2


def test_code_may_change_between_runs(engine, tmp_path):
    for n in (1, 2):
        (tmp_path / "helper_of_run.py").write_text(f"value = {n}\n")
        (tmp_path / "edited.py").write_text(f"import helper_of_run\nresult = helper_of_run.value, {n}\n")
        assert engine.run_session([str(tmp_path / "helper_of_run.py"), str(tmp_path / "edited.py")], "c", 2) == [(n, n)] * 2
    (tmp_path / "edited.py").unlink()
    assert engine.spark.sparkContext.parallelize(range(8), 4).count() == 8 and engine.sessions[list(engine.sessions)[-1]].files == ["helper_of_run.py", "edited.py"]


def test_runs_on_a_cluster_leave_nothing_to_fetch(tmp_path):
    """Executors that took no part in a run fetch added files with their first task, when the query's own are gone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    code = (
        "from pyspark.sql import SparkSession\nimport __spark_entry__\n"
        f"spark = SparkSession.builder.master('local-cluster[3,1,1024]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()\n"
        "for _ in range(2):\n    print(__spark_entry__.queries()['session_runs'](spark, '').repartition(12).count())\n"
    )
    at, home = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors' folders are made in Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_DRIVER"))} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": str(home), "PYTHONPATH": os.pathsep.join([at, *os.environ.get("PYTHONPATH", "").split(os.pathsep)])}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.split() == ["2", "2"], done.stderr[-3000:]


def test_end_session_stops_its_jobs(engine):
    id, seen = engine.start_session("c", 2), []

    def work():
        try:
            with engine.tagged(id) as spark:
                spark.sparkContext.parallelize(range(2), 2).map(lambda x: time.sleep(60)).collect()
        except Exception as e:
            seen.append(str(e))

    from pyspark import InheritableThread

    t = InheritableThread(target=work)
    t.start()
    time.sleep(3)
    engine.end_session(id)
    t.join(30)
    assert seen and not t.is_alive()


def test_environments(engine, tmp_path):
    with pytest.raises(FileNotFoundError):
        engine.start_session("c", 1, project_dir=str(tmp_path))
    (tmp_path / "pyproject.toml").write_text("[a]\n")
    one = engine.get_session(engine.start_session("c", 1, project_dir=str(tmp_path))).environment["hash"]
    (tmp_path / "poetry.lock").write_text("x")
    assert engine.get_session(engine.start_session("c", 1, project_dir=str(tmp_path))).environment["hash"] != one
    with pytest.raises(ValueError, match="directory"):
        engine.start_session("c", 1, url="https://example.com/r")
    (tmp_path / "t.toml").write_text("splits = {a = 1}\n")
    (tmp_path / "u.toml").write_text("merges = {}\nsplits = {b = 2}\n")
    s = engine.get_session(engine.start_session("c", 1, pf_dispatch_table=[str(tmp_path / "t.toml"), str(tmp_path / "u.toml")]))
    assert s.dispatch == {"splits": {"b": 2}, "merges": {}}


def test_environment_files_are_shipped(spark, engine, tmp_path):
    (tmp_path / "pyproject.toml").write_text("[a]\n")
    (tmp_path / "poetry.lock").write_text("x")
    found = engine.get_session(engine.start_session("c", 1, project_dir=str(tmp_path))).environment
    assert set(found["shipped"]) == {"pyproject.toml", "poetry.lock"}
    for n, at in found["shipped"].items():
        assert at == f"{found['hash']}/{n}" and files.read_text(spark, f"{engine.folder}/{at}") == (tmp_path / n).read_text()
    remote = engine.get_session(engine.start_session("c", 1, url="https://example.com/r", branch="b", directory="d", dev_paths=["p"], force_pull=True)).environment
    assert (remote["branch"], remote["directory"], remote["dev_paths"], remote["force_pull"], remote["force_sync"]) == ("b", "d", ["p"], True, False)


def test_dispatch_by_branch_and_package(spark, tmp_path):
    for n in ("one", "two"):
        (tmp_path / "dev" / n / "res").mkdir(parents=True)
        (tmp_path / "dev" / n / "res" / "pf_dispatch_table.toml").write_text(f"splits = {{}}\n{n} = 1\n")
    e = Engine(spark, clock=Clock(), dispatch_base=f"file://{tmp_path}")
    e.create_cluster("c")
    s = e.get_session(e.start_session("c", 1, dispatch_packages=["one", "two"], dispatch_branch="dev", using_modules=["m"], log_initialization=True))
    assert s.dispatch == {"splits": {}, "one": 1, "two": 1} and s.options["using_modules"] == ["m"] and "starts" in s.log[0]
    with pytest.raises(RuntimeError, match="no place"):
        other = Engine(spark, clock=Clock())
        other.create_cluster("c")
        other.start_session("c", 1, dispatch_packages=["one"])


def test_force_update_files_takes_a_new_resource(engine):
    def resource(**options):
        id = engine.start_session("c", 2, **options)
        engine.end_session(id)
        return engine.get_session(id).resource_id

    first = resource()
    assert resource() == first and resource(force_update_files=True) != first


def test_workers_stay_within_the_clusters_bounds(spark):
    asked = []
    e = Engine(spark, clock=Clock(), ask=asked.append)
    e.create_cluster("small", min_num_workers=1, initial_num_workers=2, max_num_workers=5)
    a = e.start_session("small", 3)
    with pytest.raises(RuntimeError, match="5 workers at most; 6 would run"):
        e.start_session("small", 3)
    e.start_session("small", 2)
    e.end_session(a)
    assert asked == [2, 3, 5, 2]
    e.end_all_sessions("small")
    assert asked[-1] == 1  # the least
    e.destroy_cluster("small")
    assert asked[-1] == 0


@pytest.mark.parametrize("body,held", [("JOB_FAILUREbrokenMESSAGE_END", False), ("SESSION_FAILUREbrokenMESSAGE_END", True)])
def test_a_failure_message_ends_the_session(engine, body, held, capsys):
    id = engine.start_session("c", 2, release_resources_after=5)
    queue, resource = engine.get_gather_queue(), engine.get_session(id).resource_id
    queue.send("JOB_FAILUREhalf")
    queue.send(body)
    assert engine.next_message(queue) == {"kind": "failed", "end": False, "text": "half"} and engine.get_session(id).status == "running"
    with pytest.raises(messages.SessionFailed, match="broken"):
        engine.next_message(queue)
    s = engine.get_session(id)
    assert (s.status, s.status_explanation, engine.current) == ("failed", "broken", None)
    assert (engine.get_session(engine.start_session("c", 2)).resource_id == resource) == held
    assert engine.get_sessions(status="failed").count() == 1


def test_queue_forgets_ids_after_five_minutes():
    clock = Clock()
    q = messages.Queue("q", clock=clock)
    q.send("a", "id")
    clock.now += 299
    q.send("b", "id")
    clock.now += 1
    q.send("c", "id")
    assert (q.receive(), q.receive()) == ("a", "c") and q.items.empty() and len(q.seen) == 1


def test_mailbox_is_a_stream(spark, tmp_path):
    folder = str(tmp_path / "mail")
    box = messages.Mailbox(spark, folder, clock=Clock())
    for body, id in (("SESSION_READY", "a"), ("EVALUATION_ENDokMESSAGE_END", "b"), ("SESSION_READY", "a")):
        box.send(body, id)

    def drain(name):
        df = messages.parsed(messages.without_repeats(messages.stream(spark, folder)))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.body, r.kind, r.text) for r in spark.read.parquet(str(tmp_path / name)).collect())

    want = [("EVALUATION_ENDokMESSAGE_END", "done", "ok"), ("SESSION_READY", "ready", None)]
    assert drain("one") == want and drain("one") == want  # what was committed does not come again
    assert drain("two") == want  # another reader gets all
    box.send("noise")
    assert drain("one") == sorted([*want, ("noise", None, None)])


def test_paged_source(spark):
    calls = []
    pages = {None: ([("a", "running"), ("b", "failed")], 1), 1: ([("c", "running")], 2), 2: ([], None)}
    source = catalog.paged_source("paged_test", "id string, status string", lambda f, c: (pages[c][0], pages[c][1]), ("status",))
    df = catalog.read_paged(spark, source)
    assert [r.id for r in df.collect()] == ["a", "b", "c"]

    def filtered(filters, cursor):
        return [(k, json.dumps(filters)) for k in "xy"], None

    df = catalog.read_paged(spark, catalog.paged_source("paged_filtered", "id string, status string", filtered, ("status",)))
    rows = df.where("status IN ('running', 'creating')").collect()
    assert len(rows) == 2 and sorted(json.loads(rows[0].status)["status"]) == ["creating", "running"]
    assert [r.id for r in df.where("id = 'x'").collect()] == ["x"] and not calls


def test_rows_of_pages_are_read_by_their_own_tasks(spark):
    import pyarrow as pa

    names = ["id", "status"]

    def fetch(filters, cursor):
        row, page = cursor
        return [pa.RecordBatch.from_pydict({"id": [f"{row}{page}"], "status": [json.dumps(filters)]})], (row, page + 1) if page < 2 else None

    def read(name, rows):
        return catalog.read_paged(spark, catalog.paged_source(name, "id string, status string", fetch, ("id",), lambda filters: [(r, 0) for r in rows]))

    df = read("paged_rows", "xyz")
    assert df.rdd.getNumPartitions() == 3 and sorted(r.id for r in df.select(*names).collect()) == [f"{r}{p}" for r in "xyz" for p in range(3)]
    assert {r.status for r in df.where("id = 'x1'").select("status").collect()} == {'{"id": "x1"}'}
    assert read("paged_none", "").count() == 0


def test_session_pages_hold_little_of_any_size(spark, tmp_path, monkeypatch):
    import __spark_entry__

    rows = spark.range(0, 600_000, 1, 1).selectExpr(
        "IF(id = 599996, null, id) AS o_orderkey", "element_at(array('O', 'F', 'P', 'X', null), CAST(id % 5 AS INT) + 1) AS o_orderstatus",
        "IF(id % 7 = 0, null, timestamp_micros(1700000000000000 + id)) AS o_orderdate",
    )
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "none" / "orders.parquet"))
    seen, paged_source = [], catalog.paged_source

    def walked(name, schema, fetch, pushed, starts):
        for cursor in starts({}):
            while cursor is not None:
                page, cursor = fetch({}, cursor)
                seen.append((cursor, sum(len(b) for b in page)))
        return paged_source(name, schema, fetch, pushed, starts)

    monkeypatch.setattr(catalog, "paged_source", walked)
    got = __spark_entry__.queries()["session_pages"](spark, str(tmp_path)).collect()
    assert sum(n for _, n in seen) == 600_000 and max(n for _, n in seen) <= 200_000 and sum(c is None for c, _ in seen) == 2  # pages are small, and of two files
    want = rows.where("o_orderstatus IN ('O', 'F')").selectExpr(
        "CAST(o_orderkey AS STRING) AS session_id", "IF(o_orderstatus = 'O', 'running', 'completed') AS status", "CAST(o_orderdate AS timestamp_ntz) AS start_time",
        "CAST(IF(o_orderstatus = 'O', null, o_orderdate + INTERVAL 1 DAY) AS timestamp_ntz) AS end_time",
    ).orderBy("start_time", ascending=False).limit(200)
    assert got == want.collect() and len(got) == 200
    assert __spark_entry__.queries()["session_pages"](spark, str(tmp_path / "none")).collect() == []


def test_records(spark):
    raw = spark.createDataFrame([("a", "running", None, "2024-01-01T00:00:00", "", 2)], catalog.RAW_SESSIONS)
    assert catalog.sessions(raw).first().asDict() == {"session_id": "a", "status": "running", "status_explanation": None, "start_time": datetime(2024, 1, 1), "end_time": None, "num_workers": 2}
    raw = spark.createDataFrame([("a", "running", None, "arn", "o", None, None, 3)], catalog.RAW_CLUSTERS)
    assert tuple(catalog.clusters(raw).first()) == ("a", "running", "", "arn", "o", "", 0, 3)
    with pytest.raises(Exception, match="no status"):
        catalog.clusters(spark.createDataFrame([("a", None, None, None, None, None, None, None)], catalog.RAW_CLUSTERS)).collect()


def test_responses():
    assert catalog.decode_response(200, '{"a": 1}') == {"a": 1} and catalog.decode_response(504, "gateway") is None
    for status, error in ((403, PermissionError), (500, catalog.ServiceError), (502, catalog.ServiceError)):
        with pytest.raises(error):
            catalog.decode_response(status, "<html>")
    content = {"x": 1}
    assert catalog.request(lambda m, c: (200, json.dumps([m, json.loads(c)])), "get_all", content, True) == ["get-all", {"x": 1, "debug": True}] and content == {"x": 1}


@pytest.fixture
def service():
    """A service on this machine that tells what it got, with the status that the method's name ends with; GET gives TOML."""
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["content-length"])))
            self.answer(int(self.path[-3:]), json.dumps({"path": self.path, "got": got, "key": self.headers["x-key"]}))

        def do_GET(self):
            self.answer(200, 'a = "remote"')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_requests_over_http(service, tmp_path):
    send = catalog.http_transport(f"{service}/v1/", {"x-key": "k"})
    assert catalog.request(send, "get_all_200", {"x": 1}) == {"path": "/v1/get-all-200", "got": {"x": 1, "debug": False}, "key": "k"}
    assert catalog.request(send, "slow_504", {}) is None
    for method, error in (("no_403", PermissionError), ("bad_500", catalog.ServiceError), ("far_502", catalog.ServiceError)):
        with pytest.raises(error):
            catalog.request(send, method, {})
    (tmp_path / "own.toml").write_text("a = 1\nb = 2\n")
    assert files.load_toml([str(tmp_path / "own.toml"), f"{service}/x.toml"]) == {"a": "remote", "b": 2}


def test_config(tmp_path):
    path = str(tmp_path / "d" / "c.toml")
    with pytest.raises(ValueError):
        files.Config.resolve(path=path, environ={})
    env = {"QUERN_USER_ID": "e", "QUERN_API_KEY": "k", "QUERN_CONFIG_PATH": path}
    assert files.Config.resolve(environ=env).user_id == "e"
    assert files.Config.resolve(path=path, environ={}).api_key == "k"
    assert files.Config.resolve("a", 'q"\n', path, env).user_id == "a"
    assert files.load_toml(path) == {"quern": {"user_id": "a", "api_key": 'q"\n'}}
    assert files.load_toml(f"file://{path}") == files.load_toml([path])
    with pytest.raises(ValueError):
        files.load_toml("s3://b/k")
    assert files.Config.load(str(tmp_path / "none")) is None


def test_copies(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n in ("in/a.txt", "in/b.txt", "in/sub/c.txt"):
        (tmp_path / n).write_text(n)
    out = str(tmp_path / "out")
    assert files.upload(spark, str(tmp_path / "in" / "a.txt"), out) == "a.txt" and (tmp_path / "out" / "a.txt").read_text() == "in/a.txt"
    assert files.upload(spark, str(tmp_path / "in"), out, "all") == "all" and not (tmp_path / "out" / "all" / "c.txt").exists()
    assert {r.path.rsplit("/")[-1] for r in files.plain_files(spark, f"{out}/all").collect()} == {"a.txt", "b.txt"}
    assert files.plain_files(spark, f"{out}/all", "b").count() == 1
    assert files.upload_file(spark, str(tmp_path / "in" / "a.txt"), out, "z") and not files.upload_file(spark, str(tmp_path / "none"), out)


def test_queues(engine):
    engine.start_session("c", 2)
    scatter, gather = engine.get_scatter_queue(), engine.get_gather_queue()
    assert engine.get_execution_queue().name.endswith("_execution.fifo") and engine.get_scatter_queue() is scatter

    def client():
        ask = messages.next_message(gather, timeout=10)
        messages.send_value(scatter, ask["value_id"], [1, 2])

    t = threading.Thread(target=client)
    t.start()
    assert messages.ask_value(gather, scatter, "v", timeout=10) == [1, 2]
    t.join()
    gather.send("a", "same")
    gather.send("b", "same")
    gather.send("c")
    assert gather.receive(delete=False) == "a" and gather.receive() == "a" and gather.receive() == "c"


def test_message_texts(capsys):
    q = messages.Queue("q")
    for body in ("SESSION_READY", "EVALUATION_ENDhello", "EVALUATION_ENDbyeMESSAGE_END", '{"kind": "GATHER"}', "JOB_FAILUREhalf", "SESSION_FAILUREallMESSAGE_END"):
        q.send(body)
    got = [messages.next_message(q) for _ in range(5)]
    assert got == [{"kind": "ready"}, {"kind": "done", "end": False, "text": "hello"}, {"kind": "done", "end": True, "text": "bye"}, {"kind": "GATHER"}, {"kind": "failed", "end": False, "text": "half"}]
    with pytest.raises(messages.SessionFailed, match="^all$"):
        messages.next_message(q)
    assert capsys.readouterr().out.split() == ["hello", "bye", "half", "all"]


def test_streams_drop_repeats_and_find_uses(spark, tmp_path):
    from quern.operators import lifecycle

    rows = spark.range(90).selectExpr("id AS seq", "'1' AS group_id", "CAST(id % 30 AS STRING) AS dedup_id", "'x' AS body", "timestamp_seconds(1700000000 + id) AS ts")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(drain(messages.without_repeats(stream), "dedup_out", "append")) == 30
    last = {r.dedup_id: r.status for r in drain(lifecycle.last_status(stream, "dedup_id", "seq", "ts", "seq"), "last_out", "complete")}
    assert last == {str(i): 60 + i for i in range(30)}
    uses = drain(lifecycle.sessions_of_stream(stream, "group_id", "ts", minutes=1), "uses_out", "complete")
    assert [r.events for r in uses] == [90]
