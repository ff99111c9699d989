import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runcourier.functions import files
from runcourier.operators import documents as documents_module
from runcourier.operators.deliver import chat_outbox
from runcourier.operators.documents import documents
from runcourier.operators.render import render, write_reports
from runcourier.operators.sections import assemble
from runcourier.sources.tables import inline_tables, whole_md5, whole_text


def suite(run, category="S", status="PASS"):
    return (run, category, status + "ED", status, 1, 1, 0, "00:00:01", "u@example.com")


def skewed(spark):
    """One run with most rows, among them one row a thousand times, and runs that lack sections."""
    failed = [("hot", "S", f"T{i:06d}", None, "ü&<" * (i % 50), "FAIL") for i in range(400)]
    failed += [("hot", "S", "T000007", "tag", "same", "FAIL")] * 1000
    failed += [("big", "S", "T1", "tag", "z" * 9000, "FAIL"), ("cold", "S", "T1", "tag", "x", "FAIL")]
    failed += [("lost", "S", f"T{i}", "tag", "x", "FAIL") for i in range(300)]
    failed += [(None, "S", "T", "tag", "x", "FAIL")] * 200
    breaches = [("hot", f"b{i % 60}") for i in range(300)] + [("cold", "b"), ("hot", None)]
    suites = [suite("hot", f"S{i % 7}") for i in range(500)]
    suites += [suite("cold"), suite("big"), suite("quiet"), suite(None)]
    requests = [("hot", f"c{i}", "d", "p", "r", "t", "f", "l", "a") for i in range(200)]
    return inline_tables(
        spark, suite_status=suites, failed_check=failed, threshold_breach=breaches, run_request=requests
    )


def joined(docs):
    parts = defaultdict(list)
    for r in docs.collect():
        parts[r.run_id].append(r)
    out = {}
    for run, rows in parts.items():
        rows.sort(key=lambda r: r.part_no)
        assert [r.part_no for r in rows] == list(range(rows[0].n_parts))
        at = 0
        for r in rows:
            assert r.offset == at
            at += len(r.html.encode())
        out[run] = "".join(r.html for r in rows)
        assert {(r.n_chars, r.n_bytes) for r in rows} == {(len(out[run]), at)}
    return out


@pytest.mark.parametrize("profile,mode", [("compact", "first"), ("full", "all"), ("plain", "first")])
def test_parts_are_the_document(spark, profile, mode):
    tables = skewed(spark)
    whole = {r.run_id: r.html for r in render(assemble(tables, mode), profile).collect()}
    assert set(whole) == {"hot", "big", "cold", "quiet"}
    for limit in (2_000, 40_000, 4_000_000):
        docs = documents(tables, profile, mode, part_chars=limit).cache()
        assert joined(docs) == whole
        sizes = {(r.run_id, r.n_parts) for r in docs.select("run_id", "n_parts").collect()}
        if limit == 40_000:
            assert dict(sizes)["hot"] > 5 and dict(sizes)["quiet"] == dict(sizes)["cold"] == 1
            assert docs.agg(F.max(F.length("html"))).first()[0] < 60_000
        docs.unpersist()


def test_null_text_in_parts(spark):
    tables = skewed(spark)
    whole = {r.run_id: r.html for r in render(assemble(tables), "plain", "None").collect()}
    assert joined(documents(tables, "plain", null_text="None", part_chars=3_000)) == whole


def test_one_file_per_run(spark, tmp_path):
    tables = skewed(spark)
    folder = str(tmp_path / "reports")
    whole = {r.run_id: r.html for r in render(assemble(tables), "compact").collect()}
    for limit in (3_000, 4_000_000):  # written again, a file is replaced
        write_reports(documents(tables, part_chars=limit), folder)
        got = {r.path.split("report_run_")[1]: r.text for r in whole_text(spark, folder).collect()}
        assert got == {f"{run}.html": html for run, html in whole.items()}
        assert not [f for f in os.listdir(folder) if not f.startswith("report") and not f.endswith(".crc")]


def test_run_ids_stay_inside_the_folder(spark, tmp_path):
    ids = ["a/../../b", "..", "50% + x", "ä ö", "%2F"]
    tables = inline_tables(spark, suite_status=[suite(i) for i in ids])
    folder = str(tmp_path / "in" / "reports")
    docs = documents(tables)
    write_reports(docs, folder)
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.html") if p.parent != tmp_path / "in" / "reports"] == []
    paths = {r.path for r in whole_text(spark, folder).collect()}
    named = chat_outbox(docs, "", "generic", folder).collect()
    assert len(paths) == len(named) == 5
    for r in named:
        assert any(p.endswith(r.payload.split("volume: ")[1]) for p in paths)
    with pytest.raises(Exception, match="run id"):
        write_reports(documents(inline_tables(spark, suite_status=[suite("")])), folder)


def test_parts_of_a_run_do_not_meet_in_one_task(spark, tmp_path, monkeypatch):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = documents(skewed(spark), part_chars=3_000)
        tasks = docs.where("run_id = 'hot'").select(F.spark_partition_id().alias("p"))
        assert tasks.distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Nor are they dealt out by their file.
    monkeypatch.setattr(type(docs), "repartition", lambda *_: pytest.fail("dealt out by path"))
    write_reports(docs, str(tmp_path))
    got = {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)}
    assert got == {f"report_run_{run}.html": html for run, html in joined(docs).items()}


def test_a_task_has_few_ranges_of_a_run(spark, monkeypatch):
    # Adaptive execution, which gathers small partitions, is on, and no join is broadcast by its size.
    monkeypatch.setattr(documents_module, "RANGE_CHARS", 10_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = documents(skewed(spark), "full", "all", part_chars=2_000).where("run_id = 'hot'")
        tasks = docs.groupBy(F.spark_partition_id()).agg(F.sum(F.length("html")).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(r.n for r in tasks) > 50 * 10_000
    assert max(r.n for r in tasks) < 10 * 10_000


def test_a_file_with_parts_out_of_place_does_not_appear(spark, tmp_path):
    parts = [("a", 0, 3, 0, "xx"), ("a", 1, 3, 2, "ü"), ("a", 2, 3, 4, "z")]
    schema = "run_id string, part_no int, n_parts int, offset long, html string"
    write_reports(spark.createDataFrame(parts[::-1], schema), str(tmp_path / "good"))
    assert (tmp_path / "good" / "report_run_a.html").read_text() == "xxüz"
    for n, bad in enumerate((parts[:2], [*parts, parts[0]], [*parts[:2], ("a", 2, 3, 5, "z")])):
        with pytest.raises(Exception, match="out of place"):
            write_reports(spark.createDataFrame(bad, schema), str(tmp_path / f"bad{n}"))
        assert not [f for f in os.listdir(tmp_path / f"bad{n}") if f.endswith(".html")]


def test_md5_of_files_longer_than_a_row(spark, tmp_path):
    texts = {f"{n} ä%20": ("<ü>\n" * n)[: n * 3].encode() for n in (1, 20, 21, 64, 100, 333)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    rows = whole_md5(spark, str(tmp_path), row_bytes=64, piece_bytes=128).collect()
    whole = {r.path: r.text for r in whole_text(spark, str(tmp_path)).collect()}
    assert {r.path: r.md5 for r in rows} == {p: hashlib.md5(t.encode()).hexdigest() for p, t in whole.items()}
    assert len(rows) == len(texts) and {r.path for r in rows} == {r.path for r in whole_md5(spark, str(tmp_path)).collect()}


def test_md5_is_handed_on(tmp_path, monkeypatch):
    for steps in (False, True):
        if steps:
            monkeypatch.setattr(files, "_update", lambda: None)
        for size in [*range(1, 140), 1000]:
            text = bytes(i * 7 % 256 for i in range(size))
            (tmp_path / "f").write_bytes(text)
            state = files.MD5_START
            for at in range(0, size, 64):
                state = files.md5_piece(str(tmp_path / "f"), state, at, min(at + 64, size), size)
            assert state.hex() == hashlib.md5(text).hexdigest()
