import json

import pytest
from pyspark.sql import functions as F

from runcourier.operators import deliver as D
from runcourier.operators.documents import documents
from runcourier.operators.sections import assemble
from runcourier.operators.spec import (
    datasets,
    layout_spec,
    live_layout,
    report_definition,
    section_spec,
)
from runcourier.plans.jobs import chat_job, email_job, paired, snapshot_job
from runcourier.schema import SUBSCRIPTION
from runcourier.sources.params import ChatParams, EmailParams
from runcourier.sources.sample import RUN_ID, SUITE, sample_tables
from runcourier.sources.tables import inline_tables, register_views


@pytest.fixture(scope="module")
def report(spark):
    return assemble(sample_tables(spark)).cache()


def one(df, *cols):
    return df.select(*cols).first()


def test_card_texts(report):
    s = F.col("suite")
    row = one(
        report,
        D.card_text(s, F.lit("/r/x.html")),
        D.card_text_link(s, F.lit("https://example.com/x")),
        D.card_text_link(s, F.lit("")),
        D.card_text_link(s, F.lit(None).cast("string"), title="Nightly"),
    )
    line = (
        f"Suite: {SUITE} | Total 20 · Success 17 · Failure 3 | Elapsed 00:10:05\n"
        "Run user: owner@example.com"
    )
    head = f"Regression run {RUN_ID} — FAILED"
    assert row[0] == f"{head}\n{line}\nFull report on volume: /r/x.html"
    assert row[1] == f"*{head}*\n{line}\nFull report: https://example.com/x"
    assert row[2] == f"*{head}*\n{line}"
    assert row[3] == f"*Nightly run {RUN_ID} — FAILED*\n{line}"


def test_missing_suite_prints_none(spark):
    df = spark.createDataFrame(
        [(None,)], "suite struct<run_id:string,suite_category:string,execution_status:string,"
        "status:string,total_count:int,success_count:int,failure_count:int,elapsed_time:string,run_user:string>"
    )
    text = one(df, D.card_text(F.col("suite"), F.lit("p")))[0]
    assert text.startswith("Regression run None — None\nSuite: None | Total None")


def test_subjects(spark):
    df = spark.createDataFrame([("1", None)], "r string, s string")
    r, s = F.col("r"), F.col("s")
    row = one(
        df,
        D.subject_line(r, F.lit("FAILED")),
        D.subject_line(r, s, F.lit("  ")),
        D.subject_line(r, s, F.lit(" mine ")),
        D.alert_subject(r, F.lit("FAILED")),
    )
    assert tuple(row) == (
        "Regression Report — Run 1 — FAILED", "Regression Report — Run 1 — None", "mine",
        "Regression Report - Run 1 - FAILED",
    )


def test_chat_payloads(report):
    s, text = F.col("suite"), F.lit('a "b"\nc')
    row = one(report, *[D.chat_payload(s, text, f) for f in ("slack", "generic", "teams")])
    assert json.loads(row[0]) == json.loads(row[1]) == {"text": 'a "b"\nc'}
    assert json.loads(row[2]) == {
        "@type": "MessageCard",
        "@context": "http://schema.org/extensions",
        "themeColor": "D7263D",
        "summary": f"Regression run {RUN_ID} FAIL",
        "title": f"Regression run {RUN_ID} — FAILED",
        "text": 'a "b"  \nc',
    }
    with pytest.raises(ValueError):
        D.chat_payload(s, text, "pigeon")
    mixed = report.select(D.chat_payload(s, text, F.lit("pigeon"))).first()[0]
    assert json.loads(mixed) == {"text": 'a "b"\nc'}


def test_email_payloads(report):
    to = F.array(F.lit("a@example.com"), F.lit("b@example.com"))
    args = (F.lit(""), F.lit("S"), F.lit("<p>ü</p>"), to)
    row = one(report, *[D.email_payload(p, *args) for p in ("graph", "ses", "resend")])
    assert json.loads(row[0]) == {
        "message": {
            "subject": "S",
            "body": {"contentType": "HTML", "content": "<p>ü</p>"},
            "toRecipients": [
                {"emailAddress": {"address": "a@example.com"}},
                {"emailAddress": {"address": "b@example.com"}},
            ],
        },
        "saveToSentItems": True,
    }
    assert json.loads(row[1]) == {
        "Source": "",
        "Destination": {"ToAddresses": ["a@example.com", "b@example.com"]},
        "Message": {"Subject": {"Data": "S"}, "Body": {"Html": {"Data": "<p>ü</p>"}}},
    }
    assert json.loads(row[2]) == {
        "from": "onboarding@resend.dev",
        "to": ["a@example.com", "b@example.com"],
        "subject": "S",
        "html": "<p>ü</p>",
    }
    with pytest.raises(ValueError):
        D.email_payload("fax", *args)
    assert report.select(D.email_payload(F.lit("fax"), *args)).first()[0] is None


def test_preview_holds_neither_body_nor_token(report):
    to = F.array(F.lit("a@example.com"))
    for provider in ("graph", "ses", "resend"):
        text = report.select(
            D.email_preview(
                provider, F.lit("me@example.com"), F.lit("S"), F.lit("<p>secretü</p>"), to,
                F.lit("abcdefghijk"),
            )
        ).first()[0]
        assert text.startswith(f"DRY RUN {provider}")
        assert "<14 characters, 15 bytes of HTML>" in text
        assert "secret" not in text and "ghijk" not in text
        assert provider == "ses" or "abcdef…redacted…" in text
    short = report.select(D.graph_preview(F.lit("S"), D.body_note(F.lit("x")), to)).first()[0]
    assert json.loads(short)["body"]["content"] == "<1 characters, 1 bytes of HTML>"


@pytest.mark.parametrize(
    "provider,to,dry,want",
    [
        ("resend", "", True, "RENDER_ONLY"),
        ("fax", " , ", False, "RENDER_ONLY"),
        ("fax", "a", True, "UNKNOWN_PROVIDER"),
        (None, "a", True, "UNKNOWN_PROVIDER"),
        ("ses", "a", True, "DRY_RUN"),
        ("ses", "a", False, "READY"),
    ],
)
def test_email_status(spark, provider, to, dry, want):
    df = spark.createDataFrame([(provider, to, dry)], "p string, t string, d boolean")
    status = D.email_status(F.col("p"), D.split_list(F.col("t")), F.col("d"))
    assert df.select(status).first()[0] == want


@pytest.mark.parametrize("provider", ["ses", "graph", "resend"])
def test_email_outbox_has_one_mail_per_run(spark, provider):
    failed = [("1", "S", f"T{i:02d}", "g", 'd"ü\\' * 20, "FAIL") for i in range(60)]
    t = inline_tables(
        spark, failed_check=failed,
        suite_status=[("1", "S", "FAILED", "FAIL", 60, 0, 60, "t", "u")],
    )
    docs, whole = documents(t, "plain", part_chars=5_000), documents(t, "plain")
    mail = lambda d: D.email_outbox(d, provider, "", "a@example.com", dry_run=False)
    rows = sorted(mail(docs).collect(), key=lambda r: r.part_no)
    (one,) = mail(whole).collect()
    assert len(rows) > 2 and [r.part_no for r in rows] == list(range(rows[0].n_parts))
    same = ["delivery_id", "subject", "n_chars", "n_bytes", "status"]
    assert {tuple(r[c] for c in same) for r in rows} == {tuple(one[c] for c in same)}
    assert "".join(r.payload for r in rows) == one.payload
    assert one.n_parts == 1 and json.loads(one.payload)
    (dry,) = D.email_outbox(docs, provider, "", "a@example.com").collect()
    assert f"<{one.n_chars} characters, {one.n_bytes} bytes of HTML>" in dry.payload and dry.n_parts == 1
    (single,) = D.email_outbox(docs, provider, "", "", dry_run=False).collect()
    assert single.status == "RENDER_ONLY" and single.payload is None and single.mode == "DRY_RUN"


def test_jobs(spark, tmp_path):
    t = sample_tables(spark)
    folder, box = str(tmp_path / "reports"), str(tmp_path / "outbox")
    chat_job(t, ChatParams(), folder, box)
    chat_job(t, ChatParams(RUN_ID, "https://example.com/h", "teams"), folder, box)
    email_job(t, EmailParams(recipients="a@example.com"), folder, box, token="abcdefgh")
    email_job(t, EmailParams(run_id="unknown"), folder, box)
    rows = spark.read.parquet(box).collect()
    assert sorted((r.kind, r.channel, r.status) for r in rows) == [
        ("chat", "slack", "PREVIEW"), ("chat", "teams", "READY"), ("email", "resend", "DRY_RUN"),
    ]
    preview = next(r for r in rows if r.status == "PREVIEW")
    assert preview.payload.startswith(f"Regression run {RUN_ID}")


def test_parameters_are_checked():
    for bad in (
        lambda: ChatParams(webhook_format="fax"),
        lambda: EmailParams(provider="fax"),
        lambda: EmailParams(dry_run="maybe"),
        lambda: ChatParams(run_order="newest"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert EmailParams(dry_run="false").dry_run is False


def test_snapshots_and_pairing(spark):
    runs = spark.sql(
        "select * from values ('1', timestamp_ntz'2024-01-01 12:30:00'),"
        " ('2', timestamp_ntz'2024-01-02 10:00:00') as t(run_id, ts)"
    )
    subs = spark.createDataFrame(
        [("daily", "user", "a", False), ("daily", "user", "b", True), ("r", "user", "c", False)],
        SUBSCRIPTION,
    )
    rows = snapshot_job(runs, subs, "daily", "America/New_York")
    got = sorted((r.run_id, r.address, json.loads(r.payload)["slot"]) for r in rows.collect())
    # At noon of the first day no run is known yet.
    assert got == [("2", "a", "2024-01-02 12:00")]
    assert paired(rows, rows).count() == 2


def test_layout_and_definition(spark):
    ys = [r.y for r in layout_spec(spark).orderBy("ordinal").collect()]
    assert ys == [0, 1, 2, 3, 6, 7, 10, 11, 15, 16]
    t = sample_tables(spark)
    counts = {r.dataset: r.n_rows for r in live_layout(t).collect() if r.dataset}
    assert counts == {"request_ds": 1, "suite_ds": 1, "failed_ds": 3, "threshold_ds": 2}
    spec = json.loads(report_definition(t).first().json)
    layout = spec["pages"][0]["layout"]
    assert [w["position"]["y"] for w in layout] == ys
    tables = [w["widget"] for w in layout if w["widget"]["kind"] == "table"]
    assert [len(w["columns"]) for w in tables] == [8, 9, 6, 1]
    assert [d["name"] for d in spec["datasets"]] == [d[0] for d in datasets()]
    links = section_spec(spark).where("is_link").collect()
    assert [r.field for r in links] == ["run_user"]


def test_datasets_run_as_sql(spark):
    names = register_views(sample_tables(spark), "demo_")
    assert names[-1] == "demo_latest_run_summary"
    assert spark.table("demo_latest_run_summary").first().run_id == RUN_ID
    sizes = [spark.sql(query).count() for _, _, query in datasets("demo_")]
    assert sizes == [1, 1, 3, 2]
