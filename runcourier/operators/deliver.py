"""Who gets what: subscribers, subjects, chat and email payloads, the outbox.

Nothing is sent from here. A delivery is a row of the outbox, which a sender picks up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.functions.text import (
    blank_to,
    markdown_breaks,
    n_bytes,
    n_chars,
    redact,
    report_path,
    shown,
    split_list,
    trim_all,
)
from runcourier.schema import CHAT_FORMATS, EMAIL_PROVIDERS, one_of
from runcourier.session import join_config

# Card colour, card kind and context, default sender.
CARD_TYPE = "MessageCard"
CARD_CONTEXT = "http://schema.org/extensions"
CARD_COLOR = "D7263D"
DEFAULT_SENDER = "onboarding@resend.dev"

TITLE = "Regression"

OUTBOX_COLUMNS = [
    "delivery_id", "kind", "channel", "address", "run_id", "subject", "payload", "mode", "status",
    "n_chars", "n_bytes",
]

_KEEP_NULLS = {"ignoreNullFields": "false"}


# ---------------------------------------------------------------- subscribers


def subscribers(users: DataFrame, destinations: DataFrame) -> DataFrame:
    """Users and group destinations as one list; duplicates are kept."""
    columns = [c for c in users.columns if c not in ("kind",)]
    return users.select(F.lit("user").alias("kind"), *columns).unionByName(
        destinations.select(F.lit("destination").alias("kind"), *columns)
    )


def subscription_record(kind: Column, address: Column) -> Column:
    """A subscription in the form a schedule takes: a user by id, a group by destination."""
    user = F.to_json(
        F.struct(F.struct(F.struct(address.alias("user_id")).alias("user_subscriber")).alias("subscriber"))
    )
    destination = F.to_json(
        F.struct(
            F.struct(
                F.struct(address.alias("destination_id")).alias("destination_subscriber")
            ).alias("subscriber")
        )
    )
    return F.when(kind == "user", user).otherwise(destination)


def alert_subscription_record(kind: Column, address: Column) -> Column:
    """A subscription in the form an alert takes."""
    user = F.to_json(F.struct(address.alias("user_name")))
    return F.when(kind == "user", user).otherwise(
        F.to_json(F.struct(address.alias("destination_id")))
    )


def fan_out(fired: DataFrame, subscriptions: DataFrame, on: str = "rule_id") -> DataFrame:
    """One delivery per fired alert and subscriber of its rule; paused ones are skipped."""
    active = subscriptions.where(~F.coalesce(F.col("paused"), F.lit(False))).drop("paused")
    return join_config(fired, active, on)


# -------------------------------------------------------------------- texts


def subject_line(
    run_id: Column, status: Column, given: Column | None = None, title: str = TITLE,
    null_text: str = "None",
) -> Column:
    """The given subject, or one made of run id and status."""
    made = F.concat(
        F.lit(f"{title} Report — Run "), shown(run_id, null_text), F.lit(" — "),
        shown(status, null_text),
    )
    return made if given is None else blank_to(given, made)


def alert_subject(run_id: Column, status: Column, title: str = TITLE) -> Column:
    """The subject of an alert mail, with plain hyphens."""
    return F.concat(
        F.lit(f"{title} Report - Run "), shown(run_id), F.lit(" - "), shown(status)
    )


def card_title(suite: Column, title: str = TITLE, null_text: str = "None") -> Column:
    return F.concat(
        F.lit(f"{title} run "), shown(suite["run_id"], null_text), F.lit(" — "),
        shown(suite["execution_status"], null_text),
    )


def _body_lines(suite: Column, null_text: str) -> Column:
    # The labels of a card.
    def v(name: str) -> Column:
        return shown(suite[name], null_text)

    return F.concat(
        F.lit("Suite: "), v("suite_category"), F.lit(" | Total "), v("total_count"),
        F.lit(" · Success "), v("success_count"), F.lit(" · Failure "), v("failure_count"),
        F.lit(" | Elapsed "), v("elapsed_time"), F.lit("\nRun user: "), v("run_user"),
    )


def card_text(
    suite: Column, path: Column, title: str = TITLE, null_text: str = "None"
) -> Column:
    """Summary of a run in four lines, with the place of the full report."""
    return F.concat(
        card_title(suite, title, null_text), F.lit("\n"), _body_lines(suite, null_text),
        F.lit("\nFull report on volume: "), path,
    )


def card_text_link(
    suite: Column, link: Column, title: str = TITLE, null_text: str = "None"
) -> Column:
    """Summary with a bold first line, and a last line only where there is a link."""
    linked = F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("\nFull report: "), link))
    return F.concat(
        F.lit("*"), card_title(suite, title, null_text), F.lit("*\n"),
        _body_lines(suite, null_text), F.coalesce(linked, F.lit("")),
    )


# ------------------------------------------------------------------ payloads


def plain_payload(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")), _KEEP_NULLS)


def card_payload(
    suite: Column, text: Column, title: str = TITLE, null_text: str = "None"
) -> Column:
    summary = F.concat(
        F.lit(f"{title} run "), shown(suite["run_id"], null_text), F.lit(" "),
        shown(suite["status"], null_text),
    )
    card = F.struct(
        F.lit(CARD_TYPE).alias("@type"),
        F.lit(CARD_CONTEXT).alias("@context"),
        F.lit(CARD_COLOR).alias("themeColor"),
        summary.alias("summary"),
        card_title(suite, title, null_text).alias("title"),
        markdown_breaks(text).alias("text"),
    )
    return F.to_json(card, _KEEP_NULLS)


def chat_payload(
    suite: Column, text: Column, fmt: str | Column = "slack", title: str = TITLE
) -> Column:
    """A card for ``teams``, the plain payload for every other format."""
    if isinstance(fmt, str):
        one_of(fmt, CHAT_FORMATS, "format")
        return card_payload(suite, text, title) if fmt == "teams" else plain_payload(text)
    return F.when(fmt == "teams", card_payload(suite, text, title)).otherwise(plain_payload(text))


def _graph_message(subject: Column, content: Column, recipients: Column) -> Column:
    to = F.transform(
        recipients, lambda r: F.struct(F.struct(r.alias("address")).alias("emailAddress"))
    )
    body = F.struct(F.lit("HTML").alias("contentType"), content.alias("content"))
    return F.struct(subject.alias("subject"), body.alias("body"), to.alias("toRecipients"))


def graph_payload(subject: Column, html: Column, recipients: Column) -> Column:
    message = _graph_message(subject, html, recipients)
    full = F.struct(message.alias("message"), F.lit(True).alias("saveToSentItems"))
    return F.to_json(full, _KEEP_NULLS)


def ses_payload(sender: Column, subject: Column, html: Column, recipients: Column) -> Column:
    mail = F.struct(
        sender.alias("Source"),
        F.struct(recipients.alias("ToAddresses")).alias("Destination"),
        F.struct(
            F.struct(subject.alias("Data")).alias("Subject"),
            F.struct(F.struct(html.alias("Data")).alias("Html")).alias("Body"),
        ).alias("Message"),
    )
    return F.to_json(mail, _KEEP_NULLS)


def resend_payload(sender: Column, subject: Column, html: Column, recipients: Column) -> Column:
    mail = F.struct(
        blank_to(sender, F.lit(DEFAULT_SENDER)).alias("from"),
        recipients.alias("to"),
        subject.alias("subject"),
        html.alias("html"),
    )
    return F.to_json(mail, _KEEP_NULLS)


def email_payload(
    provider: str | Column, sender: Column, subject: Column, html: Column, recipients: Column
) -> Column:
    """The message in the form its provider expects; null for an unknown provider."""
    forms = {
        "resend": resend_payload(sender, subject, html, recipients),
        "graph": graph_payload(subject, html, recipients),
        "ses": ses_payload(sender, subject, html, recipients),
    }
    if isinstance(provider, str):
        return forms[one_of(provider, EMAIL_PROVIDERS, "provider")]
    chosen = F.lit(None).cast("string")
    for name, form in forms.items():
        chosen = F.when(provider == name, form).otherwise(chosen)
    return chosen


def size_note(chars: Column, size: Column) -> Column:
    return F.concat(F.lit("<"), chars, F.lit(" characters, "), size, F.lit(" bytes of HTML>"))


def body_note(html: Column) -> Column:
    """Stands in for the body in a preview: its size in characters and in bytes."""
    return size_note(n_chars(html), n_bytes(html))


def graph_preview(subject: Column, note: Column, recipients: Column) -> Column:
    """The message with its body replaced by a note."""
    return F.to_json(_graph_message(subject, note, recipients), _KEEP_NULLS)


def email_preview(
    provider: str | Column, sender: Column, subject: Column, html: Column, recipients: Column,
    token: Column, region: str = "<region>", note: Column | None = None,
) -> Column:
    """What a dry run shows: the request, a shortened token, and the body's size only (``note``)."""
    note = body_note(html) if note is None else note
    to = F.concat(F.lit("["), F.array_join(recipients, ", "), F.lit("]"))
    authorization = F.concat(F.lit("\nAuthorization: Bearer "), redact(token))
    forms = {
        "resend": F.concat(
            F.lit("DRY RUN resend\nPOST https://api.resend.com/emails"), authorization,
            F.lit("\nfrom="), blank_to(sender, F.lit(DEFAULT_SENDER)), F.lit(" to="), to,
            F.lit(" subject="), subject, F.lit(" html="), note,
        ),
        "graph": F.concat(
            F.lit("DRY RUN graph\nPOST https://graph.microsoft.com/v1.0/users/"), sender,
            F.lit("/sendMail"), authorization, F.lit("\nContent-Type: application/json\nmessage="),
            graph_preview(subject, note, recipients),
        ),
        "ses": F.concat(
            F.lit(f"DRY RUN ses\nses:SendEmail region={region}"), F.lit("\nSource="), sender,
            F.lit(" To="), to, F.lit("\nSubject="), subject, F.lit(" Body="), note,
        ),
    }
    if isinstance(provider, str):
        return forms[one_of(provider, EMAIL_PROVIDERS, "provider")]
    chosen = F.lit(None).cast("string")
    for name, form in forms.items():
        chosen = F.when(provider == name, form).otherwise(chosen)
    return chosen


# -------------------------------------------------------------------- routing


def email_status(provider: str | Column, recipients: Column, dry_run: bool | Column) -> Column:
    """No recipients wins over the provider, an unknown provider over the dry run."""
    name = F.lit(provider) if isinstance(provider, str) else provider
    dry = F.lit(dry_run) if isinstance(dry_run, bool) else dry_run
    known = F.coalesce(name.isin(*EMAIL_PROVIDERS), F.lit(False))
    return (
        F.when(F.size(recipients) == 0, "RENDER_ONLY")
        .when(~known, "UNKNOWN_PROVIDER")
        .when(dry, "DRY_RUN")
        .otherwise("READY")
    )


def chat_status(url: Column) -> Column:
    return F.when(F.coalesce(trim_all(url), F.lit("")) == "", "PREVIEW").otherwise("READY")


def outbox(
    df: DataFrame, kind: str | Column, channel: Column, address: Column, subject: Column,
    payload: Column, status: Column, key: Column | None = None,
    size: tuple[Column, Column] | None = None, more: list[Column] | None = None,
) -> DataFrame:
    """Deliveries in the common form. The id follows from the content of the delivery's key,
    so computing a delivery again gives the same id. ``size`` is that of the payload unless given."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    chars, size_ = size or (n_chars(payload), n_bytes(payload))
    ident = [kind, channel, address, F.col("run_id")] + ([key] if key is not None else [])
    mode = F.when(status == "READY", "READY").otherwise("DRY_RUN")
    return df.select(
        F.md5(F.concat_ws("|", *[shown(c) for c in ident])).alias("delivery_id"),
        kind.alias("kind"),
        channel.alias("channel"),
        address.alias("address"),
        "run_id",
        subject.alias("subject"),
        payload.alias("payload"),
        mode.alias("mode"),
        status.alias("status"),
        chars.alias("n_chars"),
        size_.alias("n_bytes"),
        *(more or []),
    )


def chat_outbox(
    report: DataFrame, url: str, fmt: str, folder: str, title: str = TITLE
) -> DataFrame:
    """One chat message per run, from records or documents."""
    one_of(fmt, CHAT_FORMATS, "format")
    first = report.where("part_no = 0") if "part_no" in report.columns else report.where("page_no = 0")
    text = card_text(F.col("suite"), report_path(folder, F.col("run_id")), title)
    status = chat_status(F.lit(url))
    payload = chat_payload(F.col("suite"), text, fmt, title)
    shown_text = F.when(status == "READY", payload).otherwise(text)
    return outbox(
        first, "chat", F.lit(fmt), F.lit(url), card_title(F.col("suite"), title), shown_text, status
    )


# Stands for the body while a message is put around it; no message holds it.
_BODY = "\ue000body\ue001"


def _json_text(c: Column) -> Column:
    """A text as it stands inside a JSON string."""
    quoted = F.to_json(F.struct(c.alias("x")), _KEEP_NULLS)
    return F.substring(quoted, 7, F.length(quoted) - 8)


def email_outbox(
    documents: DataFrame, provider: str, sender: str, recipients: str,
    subject: str = "", dry_run: bool = True, token: str = "", title: str = TITLE,
) -> DataFrame:
    """One email per document, with the columns ``part_no`` and ``n_parts`` behind the usual ones.

    The body of the mail is the whole document. A document of several parts makes a payload of as many:
    its rows have the same ``delivery_id``, and their payloads one after the other are the message. A
    preview has one row.
    """
    one_of(provider, EMAIL_PROVIDERS, "provider")
    to = split_list(F.lit(recipients))
    line = subject_line(F.col("run_id"), F.col("suite.execution_status"), F.lit(subject), title)
    status = email_status(provider, to, dry_run)
    from_ = trim_all(F.lit(sender))
    ready = documents.select("*", line.alias("_subject"), to.alias("_to"))
    h, s, r = F.col("html"), F.col("_subject"), F.col("_to")
    frame = email_payload(provider, from_, s, F.lit(_BODY), r)
    first, last = F.col("part_no") == 0, F.col("part_no") + 1 == F.col("n_parts")
    in_parts = F.concat(
        F.when(first, F.substring_index(frame, _BODY, 1)).otherwise(F.lit("")),
        _json_text(h),
        F.when(last, F.substring_index(frame, _BODY, -1)).otherwise(F.lit("")),
    )
    message = F.when(F.col("n_parts") == 1, email_payload(provider, from_, s, h, r)).otherwise(in_parts)
    note = size_note(F.col("n_chars"), F.col("n_bytes"))
    payload = F.when(status == "READY", message).when(
        status == "DRY_RUN", email_preview(provider, from_, s, h, r, F.lit(token), note=note)
    )
    n_parts = F.when(status == "READY", F.col("n_parts")).otherwise(F.lit(1))
    rows = outbox(
        ready.where((F.col("part_no") == 0) | (status == "READY")), "email", F.lit(provider),
        F.array_join(r, ", "), s, payload, status, key=F.lit(0),
        size=(F.col("n_chars"), F.col("n_bytes")), more=[F.col("part_no"), n_parts.alias("n_parts")],
    )
    return rows


def report_bodies(documents: DataFrame) -> DataFrame:
    """Documents as bodies of mails, stored once however many mails have them: ``digest``, ``run_id``,
    ``part_no``, ``n_parts``, ``html``. The digest is the md5 of a document, or of the md5s of its parts."""
    parts = documents.select("run_id", "part_no", "n_parts", F.md5("html").alias("_m"))
    whole = F.array_sort(F.collect_list(F.struct("part_no", "_m")))["_m"]
    # Parts are few, and only their digests are collected.
    several = parts.where("n_parts > 1").groupBy("run_id").agg(F.md5(F.array_join(whole, "")).alias("digest"))
    single = documents.where("n_parts = 1").withColumn("digest", F.md5("html"))
    joined = documents.where("n_parts > 1").join(several, "run_id")
    columns = ["digest", "run_id", "part_no", "n_parts", "html"]
    return single.select(*columns).unionByName(joined.select(*columns))


def alert_outbox(
    deliveries: DataFrame, status_of_run: DataFrame, title: str = TITLE, folder: str = "reports",
    bodies: DataFrame | None = None,
) -> DataFrame:
    """Alert mails to subscribers. The body is the run's stored report, named by its path.

    With ``bodies`` (``run_id``, ``digest``) it is named by its digest too; a sender joins the text by
    it, so the fan-out to subscribers never multiplies texts.

    ``deliveries`` may come from state changes or from notifications; one that is sent ``AGAIN`` is told
    apart by its time and says so.
    """
    if bodies is not None:
        named_by = bodies.select("run_id", F.col("digest").alias("_digest")).distinct()
        status_of_run = status_of_run.join(named_by, "run_id", "left")
    # One row per run, joined after it is complete.
    named = deliveries.join(status_of_run, "run_id", "left")
    key, more = F.concat_ws("|", "rule_id", "suite_category"), []
    if "reason" in deliveries.columns:
        at = F.when(F.col("reason") == "AGAIN", F.date_format("fire_ts", "yyyy-MM-dd HH:mm:ss"))
        key = F.concat_ws("|", key, at)
        more = [at.alias("again_at")]
    if bodies is not None:
        more.append(F.col("_digest").alias("body_md5"))
    subject = alert_subject(F.col("run_id"), F.col("execution_status"), title)
    payload = F.to_json(
        F.struct(
            F.col("rule_id"),
            F.col("suite_category"),
            report_path(folder, F.col("run_id")).alias("body"),
            *more,
        ),
    )
    return outbox(
        named, "alert", F.col("kind"), F.col("address"), subject, payload, F.lit("READY"), key=key
    )


def snapshots(runs_at_slots: DataFrame, cadence: str) -> DataFrame:
    """Scheduled deliveries: the run shown at each slot. A slot before the first run is empty
    and is not sent."""
    return runs_at_slots.where("run_id is not null").select(
        F.lit(cadence).alias("rule_id"), "slot", "run_id"
    )


def snapshot_outbox(deliveries: DataFrame, folder: str = "reports", title: str = TITLE) -> DataFrame:
    """Scheduled mails to subscribers, naming the stored report of the run."""
    subject = F.concat(F.lit(f"{title} Report - Run "), F.col("run_id"), F.lit(" - snapshot"))
    slot = F.date_format("slot", "yyyy-MM-dd HH:mm")
    payload = F.to_json(
        F.struct(
            F.col("rule_id").alias("cadence"),
            slot.alias("slot"),
            report_path(folder, F.col("run_id")).alias("body"),
        )
    )
    return outbox(
        deliveries, "snapshot", F.col("kind"), F.col("address"), subject, payload, F.lit("READY"),
        key=F.concat_ws("|", F.col("rule_id"), slot),
    )
