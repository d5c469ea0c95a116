import gc
import json
import os
import threading
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe import cli
from strataframe.plans import reports
from strataframe.plans.datasets import RowDataset, make_numpy_dataset, make_torch_dataset
from strataframe.plans.importer import Output, export_files, import_files, load_numpy, run_bulk_import
from strataframe.plans.repository import Repository
from strataframe.service import peers, wire
from strataframe.service.server import serve
from strataframe.session import ship
from strataframe.sources.store import REFS
from strataframe.streaming.commits import commit_batches


@pytest.fixture
def repo(spark, tmp_path):
    r = Repository(ship(spark), str(tmp_path / "repo"))
    r.init("tester", "tester@example.org")
    return r


@pytest.fixture
def filled(repo):
    co = repo.checkout(write=True)
    arrays = co.add_ndarray_column("arrays", shape=(2, 3), dtype="float64")
    arrays.update({str(i): np.full((2, 3), float(i)) for i in range(6)})
    arrays[1] = np.full((2, 3), 100.0)
    texts = co.add_str_column("texts", contains_subsamples=True)
    texts.update({0: {1: "a", 2: "b", "x": "c"}, "s": {1: "d"}})
    co.commit("first")
    co.close()
    return repo


def change(repo, branch, f, message="change"):
    co = repo.checkout(write=True, branch=branch)
    try:
        f(co)
        return co.commit(message)
    finally:
        co.close()


def test_reading(filled):
    co = filled.checkout()
    a, t = co["arrays"], co["texts"]
    assert len(a) == 7 and a.keys() == [1, "0", "1", "2", "3", "4", "5"]
    assert a[1][0, 0] == 100.0 and a["1"][0, 0] == 1.0
    assert "3" in a and 3 not in a and "no way" not in a
    assert a.get("nope", 7) == 7
    with pytest.raises(KeyError):
        a["nope"]
    assert len(t) == 2 and t.num_subsamples == 4
    assert t[0].data == {1: "a", 2: "b", "x": "c"} and t[0, "x"] == "c" and t[0][...] == t[0].data
    assert t[0][0:2] == {1: "a", 2: "b"} and t["s"].keys() == [1]
    assert co["arrays", "2"][0, 0] == 2.0
    got = co[("arrays", "2"), ("texts", 0, 1), ("texts", "s")]
    assert got[0][0, 0] == 2.0 and got[1] == "a" and got[2].data == {1: "d"}
    assert co[[("arrays", "2")]][0][0, 0] == 2.0
    assert co.get([("arrays", "2"), ("arrays", "none")], default=5)[1] == 5
    with pytest.raises(KeyError):
        co[("arrays", "2"), ("arrays", "none")]
    with pytest.raises(PermissionError):
        a["9"] = np.zeros((2, 3))
    assert not a.contains_remote_references and co.columns.keys() == ["arrays", "texts"]
    co.close()
    with pytest.raises(PermissionError):
        co["arrays"]


def test_writing_rules(filled):
    co = filled.checkout(write=True)
    with pytest.raises(PermissionError):
        filled.checkout(write=True)
    assert filled.writer_lock_held and co.diff.status() == "CLEAN"
    with pytest.raises(RuntimeError):
        co.commit("nothing")
    a = co["arrays"]
    with pytest.raises(ValueError):
        a.update({"6": np.zeros((2, 3)), "7": np.zeros((2, 3), "float32")})
    assert "6" not in a
    a["1"] = np.full((2, 3), 1.0)
    assert co.diff.status() == "CLEAN"
    with pytest.raises(LookupError):
        co.add_str_column("texts")
    with pytest.raises(ValueError):
        co.add_str_column("bad name")
    key = a.append(np.zeros((2, 3)))
    assert key in a
    assert a.pop("2")[0, 0] == 2.0 and "2" not in a
    with pytest.raises(KeyError):
        del a["2"]
    with a:
        with pytest.raises(PermissionError):
            co.add_str_column("other")
        a["8"] = np.ones((2, 3))
    t = co["texts"]
    t["s"] = {2: "e"}
    assert t["s"].data == {1: "d", 2: "e"}
    assert t["s"].pop(1) == "d"
    del t[0]
    d = co.diff.staged()
    assert set(d.added.samples) == {("arrays", key), ("arrays", "8"), ("texts", "s", 2)}
    assert set(d.deleted.samples) == {("arrays", "2"), ("texts", "s", 1), ("texts", 0, 1), ("texts", 0, 2), ("texts", 0, "x")}
    assert co.diff.status() == "DIRTY" and "arrays: 2" in reports.status_text("master", d)
    co.reset_staging_area()
    assert co.diff.status() == "CLEAN" and "2" in co["arrays"]
    with pytest.raises(RuntimeError):
        co.reset_staging_area()
    co["arrays"]["9"] = np.ones((2, 3))
    co.close()
    co = filled.checkout(write=True)
    assert "9" in co["arrays"]
    with pytest.raises(ValueError):
        filled.create_branch("dev")
        co.close()
        filled.checkout(write=True, branch="dev")


def test_columns_come_and_go(filled):
    def drop(co):
        co.columns.delete("texts")
        co.add_str_column("texts")["k"] = "v"

    digest = change(filled, "master", drop)
    co = filled.checkout(commit=digest)
    assert co["texts"].keys() == ["k"] and not co["texts"].contains_subsamples

    def storage(co):
        co["texts"].change_backend("30", {"compression": "gzip"})

    change(filled, "master", storage)
    d = filled.diff(digest, "master")
    assert set(d.mutated.schema) == {"texts"} and not d.mutated.samples


def test_values_are_stored_once(filled):
    n = filled.store.objects().count()
    change(filled, "master", lambda co: co["arrays"].update({"copy": np.full((2, 3), 3.0), "copy2": np.full((2, 3), 3.0)}))
    assert filled.store.objects().count() == n


def test_fast_forward_and_merge(filled):
    filled.create_branch("dev")
    head = change(filled, "dev", lambda co: co["arrays"].update({"n": np.ones((2, 3)), "1": np.zeros((2, 3))}))
    d = filled.diff("master", "dev")
    assert d.added.samples == (("arrays", "n"),) and d.mutated.samples == (("arrays", "1"),) and not d.has_conflict
    commits = len(filled.store.commits())
    assert filled.merge("ff", "master", "dev") == head and len(filled.store.commits()) == commits
    with pytest.raises(ValueError):
        filled.merge("again", "master", "dev")

    change(filled, "master", lambda co: co["arrays"].update({"m": np.ones((2, 3))}))
    change(filled, "dev", lambda co: (co["arrays"].pop("5"), co["arrays"].update({"m": np.ones((2, 3))})))
    digest = filled.merge("three way", "master", "dev")
    co = filled.checkout(branch="master")
    assert "5" not in co["arrays"] and "m" in co["arrays"] and filled.store.commits()[digest]["is_merge"]
    text = reports.graph(filled.log(return_contents=True))
    assert text.splitlines()[0].startswith("* " + digest) and text.count("*") == 5
    assert filled.verify_repo_integrity()


def test_conflicts_stop_a_merge(filled):
    filled.create_branch("dev")
    change(filled, "master", lambda co: (co["arrays"].update({"n": np.ones((2, 3)), "1": np.ones((2, 3)) * 7, 1: np.ones((2, 3))}), co["arrays"].pop("2"), co["arrays"].pop("0")))
    change(filled, "dev", lambda co: (co["arrays"].update({"n": np.zeros((2, 3)), "1": np.ones((2, 3)) * 8, "2": np.ones((2, 3))}), co["arrays"].pop("0"), co["arrays"].pop(1)))
    c = filled.diff("master", "dev").conflict
    assert c == {"t1": [("arrays", "n")], "t21": [("arrays", "2")], "t22": [("arrays", 1)], "t3": [("arrays", "1")]}
    head = filled.store.heads()["master"]
    with pytest.raises(ValueError):
        filled.merge("no", "master", "dev")
    assert filled.store.heads()["master"] == head and not filled.writer_lock_held


def test_branch_rules(filled):
    with pytest.raises(ValueError):
        filled.create_branch("master")
    with pytest.raises(PermissionError):
        filled.remove_branch("master")
    filled.create_branch("dev")
    change(filled, "dev", lambda co: co["texts"].update({"q": {1: "new"}}))
    filled.checkout(write=True, branch="master").close()
    with pytest.raises(RuntimeError):
        filled.remove_branch("dev")
    filled.remove_branch("dev", force_delete=True)
    with pytest.raises(ValueError):
        filled.remove_branch("dev")
    assert filled.list_branches() == ["master"]


def test_damage_is_found(filled, spark):
    assert filled.verify_repo_integrity()
    kept = filled.store.objects().where("kind = 'str'").withColumn("text", F.concat("text", F.lit("!"))).withColumn("digest", F.col("digest"))
    kept.unionByName(filled.store.objects().where("kind <> 'str'")).write.parquet(filled.store.files.at("objects2"))
    filled.store.files.delete("objects")
    spark.read.parquet(filled.store.files.at("objects2")).write.parquet(filled.store.files.at("objects"))
    with pytest.raises(RuntimeError, match="values without their digest"):
        filled.verify_repo_integrity()
    filled.store.files.delete("objects")
    with pytest.raises(RuntimeError, match="records without value"):
        filled.verify_repo_integrity()


def test_remotes(filled, spark, tmp_path):
    mine = Repository(spark, str(tmp_path / "mine"))
    mine.clone("me", "me@example.org", filled.path)
    co = mine.checkout()
    assert co["arrays"].remote_reference_keys[0] == 1 and co["arrays"].contains_remote_references and co["arrays"].keys(local=True) == []
    with pytest.raises(FileNotFoundError):
        co["arrays"]["1"]
    mine.remote.fetch_data_sample("origin", "texts", [(0, 1), "s"], branch="master")
    assert co["texts"].keys(local=True) == ["s"] and co["texts"][0].keys(local=True) == [1] and co["texts"].remote_reference_keys == [0]
    with pytest.raises(KeyError):
        mine.remote.fetch_data_sample("origin", "texts", "none", branch="master")
    with pytest.raises(TypeError):
        mine.remote.fetch_data_sample("origin", "arrays", ("1", 2), branch="master")
    with pytest.warns(RuntimeWarning):
        mine.verify_repo_integrity()
    mine.remote.fetch_data("origin", branch="master")
    assert co["arrays"]["1"][0, 0] == 1.0 and mine.remote.ping("origin") >= 0
    change(mine, "master", lambda co: co["texts"].update({"z": {1: "pushed"}}))
    assert mine.remote.push("origin", "master") == "master"
    assert filled.checkout()["texts", "z", 1] == "pushed" and filled.verify_repo_integrity()
    with pytest.warns(UserWarning, match="NoOp"):
        mine.remote.push("origin", "master")
    change(filled, "master", lambda co: co["texts"].update({"y": {1: "theirs"}}))
    change(mine, "master", lambda co: co["texts"].update({"y": {1: "mine"}}))
    with pytest.warns(UserWarning, match="REJECTED"):
        mine.remote.push("origin", "master")
    with pytest.raises(ValueError):
        mine.remote.add("origin", "x")
    mine.remote.remove("origin")
    with pytest.raises(ValueError):
        mine.remote.remove("origin")


def numbers(n, m):
    for i in range(m):
        yield Output("arrays", f"i{n}-{i}", np.full((2, 3), float(n % 5)))


def test_bulk_import(filled):
    counts = run_bulk_import(filled, "master", ["arrays"], numbers, [{"n": i, "m": 2} for i in range(20)])
    assert counts["outputs"] == 40 and counts["keys"] == 40 and counts["new_values"] == 0
    co = filled.checkout()
    assert len(co["arrays"]) == 47 and co["arrays"]["i7-1"][0, 0] == 2.0

    def wrong(n):
        yield Output("arrays", str(n), np.zeros(2))

    with pytest.raises(ValueError):
        run_bulk_import(filled, "master", ["arrays"], wrong, [{"n": 1}, {"n": 2}])
    with pytest.raises(TypeError):
        run_bulk_import(filled, "master", ["arrays"], lambda n: [1], [{"n": 1}])
    with pytest.raises(TypeError):
        run_bulk_import(filled, "master", ["arrays"], numbers, [{"other": 1}])
    with pytest.raises(KeyError):
        run_bulk_import(filled, "master", ["none"], numbers, [{"n": 1, "m": 1}])
    assert not filled.writer_lock_held and len(filled.checkout()["arrays"]) == 47


def test_files_come_in_and_go_out(filled, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}.txt").write_text(f"text {i}")
    change(filled, "master", lambda co: co.add_str_column("files"))

    def load(path, content):
        yield content.decode(), path.rsplit("/", 1)[1].split(".")[0]

    assert import_files(filled, "master", "files", str(src), load) == 3
    assert import_files(filled, "master", "files", str(src), load) == 0
    change(filled, "master", lambda co: None)
    assert filled.checkout()["files"].items() == [("f0", "text 0"), ("f1", "text 1"), ("f2", "text 2")]


def test_datasets(filled):
    change(filled, "master", lambda co: co.add_str_column("names").update({k: f"n{k}" for k in co["arrays"].keys()}))
    co = filled.checkout()
    rows = list(make_numpy_dataset([co["arrays"], co["names"]], shuffle=False))
    assert len(rows) == 7 and rows[0][1] == "n1" and rows[0][0][0, 0] == 100.0
    data = make_numpy_dataset([co["arrays"], co["names"]], batch_size=3, drop_last=True)
    out = list(data)
    assert data.num_batches == 2 and len(out) == 2 and out[0][0].shape == (3, 2, 3) and len(out[0][1]) == 3
    assert len(list(make_numpy_dataset(co["arrays"], batch_size=3))) == 3
    with pytest.raises(KeyError):
        make_numpy_dataset([co["arrays"], co["texts"]])
    with pytest.raises(RuntimeError):
        make_numpy_dataset(co["arrays"], batch_size=8)
    with pytest.raises(RuntimeError):
        make_numpy_dataset(co["arrays"], collate_fn=list)
    assert [r[1] for r in make_numpy_dataset([co["arrays"], co["names"]], keys=["2", ("3", "4")], shuffle=False)] == ["n2", "n4"]
    try:
        import torch  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            make_torch_dataset(co["arrays"])


def test_many_samples_as_a_dataframe(filled, spark):
    rows = spark.range(500).select(F.concat(F.lit("#"), "id").alias("sample_key"), F.lit("").alias("subsample_key"), F.lit("str").alias("kind"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("binary").alias("data"), (F.col("id") % 10).cast("string").alias("text"))
    change(filled, "master", lambda co: co.add_str_column("many").update_dataframe(rows))
    co = filled.checkout()
    assert len(co["many"]) == 500 and co["many"][123] == "3"
    assert co["many"].dataframe().select("text").distinct().count() == 10
    change(filled, "master", lambda co: co["many"].delete_dataframe(rows.where("cast(substring(sample_key, 2) AS int) >= 400")))
    assert 499 not in filled.checkout()["many"] and 123 in filled.checkout()["many"]
    co = filled.checkout(write=True)
    with pytest.raises(ValueError):
        co["many"].update_dataframe(rows.withColumn("text", F.lit(None).cast("string")))
    co.close()


def test_stream_of_commits(filled, spark, tmp_path):
    change(filled, "master", lambda co: co.add_str_column("events"))
    schema = "sample_key string, subsample_key string, kind string, dtype string, shape array<int>, data binary, text string, `order` long"
    src = str(tmp_path / "stream")
    spark.createDataFrame([("a", "", "str", None, None, None, "old", 1), ("a", "", "str", None, None, None, "new", 2), ("b", "", "str", None, None, None, "x", 1)], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for _ in range(2):
        commit_batches(filled, "master", "events", stream, str(tmp_path / "ck")).awaitTermination()
    assert filled.checkout()["events"].items() == [("a", "new"), ("b", "x")]
    assert [c["message"] for c in filled.store.commits().values()].count("stream batch 0") == 1


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "cli")
    run = lambda *a: cli.main(["--path", path, *a], spark=spark)
    run("init", "--name", "n", "--email", "e")
    run("column-create", "c", "uint8", "2", "2")
    run("status")
    run("commit", "-m", "made c")
    run("branch-create", "dev")
    run("branch-list")
    run("log")
    run("summary")
    run("diff", "dev")
    run("writer-lock")
    run("remote-add", "origin", path)
    run("remote-list")
    run("db-view", "heads")
    out = capsys.readouterr().out
    assert "made c" in out and "dev\nmaster" in out and "uint8 (2, 2)" in out and "held: False" in out
    assert cli.typed_key("int:54") == 54 and cli.typed_key("str:54") == "54" and cli.typed_key("54") == "54"


def test_init_rules(repo, spark, tmp_path):
    with pytest.raises(OSError):
        repo.init("a", "b")
    repo.init("a", "b", remove_old=True)
    assert repo.list_branches() == ["master"] and repo.size_nbytes > 0
    with pytest.raises(RuntimeError):
        repo.create_branch("early")
    with pytest.raises(RuntimeError):
        Repository(spark, str(tmp_path / "none")).list_branches()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert repo.verify_repo_integrity()


def test_datasets_by_number_and_subsample(filled):
    co = filled.checkout()
    rows = RowDataset(co["texts"])
    assert len(rows) == 2 and rows.index_get(0) == ({1: "a", 2: "b", "x": "c"},) and rows.index_get(-1) == ({1: "d"},)
    assert list(RowDataset(co["texts"], keys=[(0, "x"), (0, 1), "s"]).stream()) == [("c",), ("a",), ({1: "d"},)]
    with pytest.raises(KeyError):
        RowDataset(co["arrays"], keys=["none"]).index_get(0)
    with pytest.raises(IndexError):
        rows.index_get(2)
    folder = f"{filled.path}/work"
    gc.collect()
    assert len(os.listdir(folder)) == 1
    del rows
    gc.collect()
    assert not os.listdir(folder)
    a, b = ([r[0][0, 0] for r in RowDataset(co["arrays"]).stream(s)] for s in (1, 1))
    assert a == b and sorted(a) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 100.0]


def test_values_stream(filled):
    a = filled.checkout()["arrays"]
    assert len(a.values()) == 7 and [v[0, 0] for v in a.values()][:2] == [100.0, 0.0]
    assert [k for k, _ in a.items()] == a.keys() and next(iter(a.items()))[0] == 1


def test_a_key_given_twice_is_refused(filled, spark):
    row = lambda k, t: (k, "", "str", None, None, None, t)
    schema = "sample_key string, subsample_key string, kind string, dtype string, shape array<int>, data binary, text string"
    co = filled.checkout(write=True)
    c = co.add_str_column("once")
    with pytest.raises(ValueError, match="2 rows"):
        c.update_dataframe(spark.createDataFrame([row("a", "x"), row("b", "y"), row("a", "z")], schema))
    assert len(c) == 0
    c.update_dataframe(spark.createDataFrame([row("a", "x")], schema).withColumn("text", F.concat("text", F.expr("cast(rand() AS string)"))))
    co.commit("drawn values are stored as they are named")
    co.close()
    assert filled.checkout()["once"]["a"].startswith("x") and filled.verify_repo_integrity()


def test_equal_keys_of_files_go_by_path(filled, tmp_path):
    tmp_path = tmp_path / "files"
    tmp_path.mkdir()
    for name in ("b", "a", "c"):
        np.save(tmp_path / f"{name}.npy", np.full((2, 3), float(ord(name))))
    np.savez(tmp_path / "z.npz", one=np.zeros((2, 3)), two=np.ones((2, 3)))
    assert import_files(filled, "master", "arrays", str(tmp_path), lambda p, c: ((v, "same") for v, _ in load_numpy(p, c)), pattern="*.npy") == 1
    assert import_files(filled, "master", "arrays", str(tmp_path), load_numpy, pattern="*.npz") == 2
    assert import_files(filled, "master", "texts", str(tmp_path), lambda p, c: [(p[-1], ("n", 1)), ("late", ("n", 2))], pattern="*.npy") == 2
    change(filled, "master", lambda co: None)
    co = filled.checkout()
    assert co["arrays"]["same"][0, 0] == ord("c") and co["arrays"]["two"][0, 0] == 1 and co["texts"]["n"].data == {1: "y", 2: "late"}
    out = tmp_path / "out"
    out.mkdir()
    assert export_files(co, "texts", lambda v, path, key: open(path, "w").write(v), str(out)) == 6
    assert (out / "int:0-str:x").read_text() == "c" and (out / "str:n-int:2").read_text() == "late"
    assert export_files(co, "arrays", lambda v, path, key: np.save(path, v), str(out), sample=1) == 1


def test_damaged_records_are_not_read(filled, spark):
    head = filled.store.heads()["master"]
    assert len(filled.checkout(verify=True)) == 2
    refs = filled.store.refs(head).where("sample_key <> '3'").collect()
    spark.createDataFrame(refs, REFS).coalesce(1).write.mode("overwrite").parquet(f"{filled.path}/refs/commit={head}")
    with pytest.raises(OSError):
        filled.checkout(verify=True)
    filled.store.files.write(f"commits/{head}.json", "{}")
    fresh = Repository(spark, filled.path)
    with pytest.raises(RuntimeError, match="can't be parsed"):
        fresh.verify_repo_integrity()


def test_merge_names_few_conflicts(filled):
    filled.create_branch("dev")
    for branch, value in (("master", 7.0), ("dev", 8.0)):
        change(filled, branch, lambda co, v=value: co["arrays"].update({f"k{i}": np.full((2, 3), v) for i in range(100)}))
    with pytest.raises(ValueError, match=r"'t1': 100") as e:
        filled.merge("no", "master", "dev")
    assert str(e.value).count("('t1'") == 20 and not filled.store.files.names("work")


@pytest.fixture
def served(filled):
    server = serve(filled.path, username="u", password="p")
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    yield filled, f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


def test_a_served_remote(served, spark, tmp_path):
    there, address = served
    mine = Repository(spark, str(tmp_path / "mine"))
    mine.clone("me", "me@example.org", address)
    assert mine.remote.ping("origin") >= 0 and mine.store.heads()["master"] == there.store.heads()["master"]
    mine.remote.fetch_data_sample("origin", "texts", [(0, 1)], branch="master")
    assert mine.checkout()["texts"][0].keys(local=True) == [1]
    mine.remote.fetch_data("origin", branch="master")
    assert mine.checkout()["arrays"]["1"][0, 0] == 1.0 and mine.verify_repo_integrity()
    change(mine, "master", lambda co: (co["texts"].update({"z": {1: "pushed"}}), co["arrays"].update({"z": np.full((2, 3), 9.0)})))
    change(mine, "master", lambda co: co["texts"].update({"z": {2: "again"}}))
    with pytest.raises(PermissionError):
        mine.remote.push("origin", "master", username="u", password="wrong")
    with pytest.raises(PermissionError):
        mine.remote.push("origin", "master")
    assert mine.remote.push("origin", "master", username="u", password="p") == "master"
    there = Repository(spark, there.path)
    assert there.checkout()["texts", "z", 2] == "again" and there.checkout()["arrays"]["z"][0, 0] == 9.0 and there.verify_repo_integrity()
    with pytest.warns(UserWarning, match="NoOp"):
        mine.remote.push("origin", "master", username="u", password="p")


def test_a_server_refuses_what_is_damaged(served):
    there, address = served
    secret = wire.credentials("u", "p")
    put = lambda path, body: peers.call(address, "PUT", path, body, secret)
    row = {"digest": "2=" + "0" * 64, "kind": "str", "dtype": None, "shape": None, "data": None, "text": "x", "nbytes": 1}
    with pytest.raises(RuntimeError, match="damaged"):
        put("values", wire.pack(pa.Table.from_pylist([row], wire.VALUES)))
    head = there.store.heads()["master"]
    with pytest.raises(RuntimeError, match="damaged"):
        put("commits/a=0", json.dumps(there.store.commits()[head] | {"parents": []}).encode())
    with pytest.raises(ConnectionError, match="moved"):
        put("heads/master", json.dumps({"seen": "", "to": head}).encode())
    with pytest.raises(ConnectionError):
        put("nothing", b"{}")
    with pytest.raises(ConnectionError):
        peers.ServerPeer(there.spark, "http://127.0.0.1:9")


def test_messages_are_bounded():
    rows = [{"digest": str(i), "kind": "str", "dtype": None, "shape": None, "data": None, "text": "x", "nbytes": 9_000_000 if i % 2 else 1} for i in range(3000)]
    got = list(wire.messages(pa.Table.from_pylist(rows, wire.VALUES).to_batches(), wire.VALUES))
    assert [d for t in got for d in t["digest"].to_pylist()] == [str(i) for i in range(3000)]
    assert all(t.num_rows <= wire.ROWS and (t.num_rows == 1 or sum(t["nbytes"].to_pylist()) <= wire.BYTES) for t in got)
    one = pa.Table.from_pylist(rows[:3], wire.VALUES)
    assert wire.unpack(wire.pack(one)).equals(one)


def test_commits_join_no_snapshots(filled, spark, monkeypatch):
    """Digests tell whether anything changed, and columns that one batch wrote to need no last operation looked for."""

    def never(*_):
        raise AssertionError("snapshots were joined, or single operations grouped")

    bulk = lambda n, v: spark.range(n).selectExpr("concat('#', id) AS sample_key", "'' AS subsample_key", "'ndarray' AS kind", "'float64' AS dtype", "array(2, 3) AS shape", f"unhex(repeat('{np.float64(v).tobytes().hex()}', 6)) AS data", "CAST(null AS STRING) AS text")
    co = filled.checkout(write=True)
    monkeypatch.setattr("strataframe.operators.algebra.diff", never)
    monkeypatch.setattr("strataframe.operators.algebra.last_write", never)
    with pytest.raises(RuntimeError):
        co.commit("nothing staged")
    co["texts"][0] = {1: "a"}
    with pytest.raises(RuntimeError):
        co.commit("the same again")
    co.column("arrays").update_dataframe(bulk(3, 7.0))
    first, own = co.commit_hash, co.commit("a batch")
    assert first != own and [co["arrays"][k][0, 0] for k in (0, 1, 2, "0", "5")] == [7.0, 7.0, 7.0, 0.0, 5.0]
    assert filled.store.commits()[own]["refs_digest"] != filled.store.commits()[first]["refs_digest"]
    co.close()


def test_the_last_of_several_batches_counts(filled, spark):
    """Beside columns of one batch, dropped ones, and ones made again."""
    co = filled.checkout(write=True)
    co["arrays"][1] = np.full((2, 3), 5.0)
    co["texts"][0] = {1: "z"}
    co["arrays"][1] = np.full((2, 3), 6.0)
    co.column("arrays").delete_dataframe(spark.createDataFrame([("2", ""), ("2", ""), ("nowhere", "")], "sample_key string, subsample_key string"))
    co["arrays"]["3"] = np.full((2, 3), 8.0)
    del co["arrays"]["3"]
    del co["arrays"]["4"]
    co["arrays"]["4"] = np.full((2, 3), 9.0)
    for text in ("old", "new"):
        made = co.add_str_column("once")
        made.update({text: text})
        if text == "old":
            co.columns.delete("once")
    for _ in range(2):
        assert {k: v[0, 0] for k, v in co["arrays"].items()} == {1: 6.0, "0": 0.0, "1": 1.0, "4": 9.0, "5": 5.0}
        assert {k: dict(v.items()) for k, v in co["texts"].items()} == {0: {1: "z", 2: "b", "x": "c"}, "s": {1: "d"}}
        assert dict(co["once"].items()) == {"new": "new"} and sorted(co.keys()) == ["arrays", "once", "texts"]
        if co.diff.status() == "DIRTY":
            co.commit("several")
    co.close()
