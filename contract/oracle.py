"""The registered queries as SQL for the reference check.

Plain SQL over the driver's tables. Only the constant text of the report layouts is taken
from the package; everything computed is written out here.
"""

from __future__ import annotations

from runcourier.functions.html import PROFILES, blank_row
from runcourier.schema import SECTIONS

GAP = "INTERVAL 6 HOUR"


def q(text: str) -> str:
    """A SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


VIEWS = {
    "e": """
        SELECT *, strftime(ts, '%Y%m%d%H') AS run_id, upper(event_type) AS suite_category,
               value > 100 AS bad
        FROM events""",
    "suite_status": """
        SELECT run_id, suite_category,
               CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'FAILED' ELSE 'PASSED' END AS execution_status,
               CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
               count(*)::INT AS total_count,
               (count(*) - count(*) FILTER (WHERE bad))::INT AS success_count,
               (count(*) FILTER (WHERE bad))::INT AS failure_count,
               strftime(TIMESTAMP '2000-01-01' + to_seconds(datesub('second', min(ts), max(ts))), '%H:%M:%S') AS elapsed_time,
               'user' || min(user_id) || '@example.com' AS run_user
        FROM e GROUP BY run_id, suite_category""",
    "run_request": """
        SELECT run_id, 'S-' || min(user_id) AS super_client_name,
               strftime(min(ts), '%Y-%m-%d') AS request_run_date,
               upper(md5(substr(run_id, 1, 8))) AS parent_request_id,
               upper(md5(run_id)) AS request_id,
               'UW-' || min(event_id) AS task_id,
               strftime(cast(min(ts) AS date) + 1, '%Y-%m-%d') AS forecast_start_date,
               'LOB' AS lob, 'NA' AS app_id
        FROM e GROUP BY run_id HAVING min(event_id) % 10 <> 0""",
    "failed_check": """
        SELECT run_id, suite_category, 'TQ' || lpad(event_id::VARCHAR, 9, '0') AS test_code,
               event_type AS tags,
               props || ' <' || event_id || '> & ''late''' AS test_description,
               CASE WHEN event_id % 7 = 0 THEN 'Query Statement Failed' ELSE 'FAIL' END AS execution_status
        FROM e WHERE bad""",
    "threshold_breach": """
        SELECT run_id, 'Outlier present in ' || suite_category AS threshold_query_description
        FROM e GROUP BY run_id, suite_category HAVING max(value) > 200""",
}

_SUITE_COLUMNS = [f.name for f in SECTIONS["suite"].fields]
_REQUEST_COLUMNS = [f.name for f in SECTIONS["request"].fields]

VIEWS["first_suite"] = f"""
        SELECT * EXCLUDE n FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(_SUITE_COLUMNS)}) AS n
            FROM suite_status) WHERE n = 1"""
VIEWS["first_request"] = f"""
        SELECT * EXCLUDE n FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(_REQUEST_COLUMNS)}) AS n
            FROM run_request) WHERE n = 1"""

_FAILED_ORDER = "run_id, suite_category, test_code, tags, test_description, execution_status"


def _sql(body: str, **more: str) -> str:
    """A query with the views and its own helpers in front."""
    names = {**VIEWS, **more}
    ctes = ",\n".join(f"    {n} AS ({v})" for n, v in names.items())
    return f"WITH RECURSIVE\n{ctes}\n{body}"


def _coarse(fmt: str, body: str, **more: str) -> str:
    """The same with runs of another span."""
    return _sql(body, **{**more, "e": VIEWS["e"].replace("%Y%m%d%H", fmt)})


_LATEST = "(SELECT max(run_id) FROM suite_status)"


def _section(name: str, labels: bool = False) -> str:
    s = SECTIONS[name]
    cols = ", ".join(f'{f.name} AS "{f.title}"' if labels else f.name for f in s.fields)
    return _sql(f"SELECT {cols} FROM {s.table} WHERE run_id = {_LATEST}")


# ------------------------------------------------------------------ html


def _escape(expr: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        expr = f"replace({expr}, {q(raw)}, {q(safe)})"
    return expr


def _row(section: str, profile: str, prefix: str = "") -> str:
    p = PROFILES[profile]
    parts = [q(p.row_open)]
    for f in SECTIONS[section].fields:
        text = f"coalesce({_escape(f'{prefix}{f.name}::VARCHAR')}, '')"
        if f.is_link:
            opened = q('<a href="mailto:')
            styled = q(f'"{p.link_style}>')
            text = f"{opened} || {text} || {styled} || {text} || '</a>'"
        parts += [q(p.cell_open(f)), text, q(p.td_close)]
    parts.append(q(p.row_close))
    return " || ".join(parts)


def _listed(section: str, profile: str, order: str) -> str:
    s = SECTIONS[section]
    return (
        f"SELECT run_id, string_agg({_row(section, profile)}, '' ORDER BY {order}) AS rows_html "
        f"FROM {s.table} GROUP BY run_id"
    )


def _report(profile: str, mode: str = "first") -> dict[str, str]:
    """Helper views up to ``report(run_id, html)``."""
    p = PROFILES[profile]
    out = {
        "failed_html": _listed("failed", profile, _FAILED_ORDER),
        "threshold_html": _listed("threshold", profile, "threshold_query_description"),
    }
    if mode == "first":
        out["request_html"] = f"SELECT run_id, {_row('request', profile)} AS rows_html FROM first_request"
        out["suite_html"] = f"SELECT run_id, {_row('suite', profile)} AS rows_html FROM first_suite"
        missing = q(blank_row(SECTIONS["request"], p))
    else:
        out["request_html"] = _listed("request", profile, ", ".join(_REQUEST_COLUMNS))
        out["suite_html"] = _listed("suite", profile, ", ".join(_SUITE_COLUMNS))
        missing = "''"
    heads = [p.section_open(s) for s in SECTIONS.values()]
    close = p.section_close()
    out["report"] = f"""
        SELECT r.run_id,
               {q(p.head + heads[0])} || coalesce(a.rows_html, {missing})
               || {q(close + p.between + heads[1])} || s.rows_html
               || {q(close + p.between + heads[2])} || coalesce(f.rows_html, '')
               || {q(close + p.between + heads[3])} || coalesce(t.rows_html, '')
               || {q(close + p.foot)} AS html
        FROM (SELECT DISTINCT run_id FROM suite_status) r
        JOIN suite_html s USING (run_id)
        LEFT JOIN request_html a USING (run_id)
        LEFT JOIN failed_html f USING (run_id)
        LEFT JOIN threshold_html t USING (run_id)"""
    return out


_DIGEST = """
SELECT run_id, 0 AS part_no, 1 AS n_parts, md5({html}) AS html_md5,
       length({html})::BIGINT AS n_chars, octet_length(encode({html}))::BIGINT AS n_bytes
FROM report"""


def _render(profile: str, mode: str = "first", html: str = "html") -> str:
    return _sql(_DIGEST.format(html=html), **_report(profile, mode))


# ------------------------------------------------------------------ pages

SMALL_PAGE = 3000


def _weight(section: str) -> str:
    cols = SECTIONS[section].columns
    return " + ".join([str(128 * len(cols))] + [f"coalesce(length({c}::VARCHAR), 0)" for c in cols])


def _hash(section: str) -> str:
    cols = " || '|' || ".join(f"coalesce({c}::VARCHAR, '')" for c in SECTIONS[section].columns)
    return f"('0x' || substr(md5({cols}), 1, 8))::BIGINT"


_PAGES = {
    "listed": f"""
        SELECT run_id, 'failed' AS section, suite_category || '|' || test_code AS place, test_code AS item,
               {_weight('failed')} AS w, {_hash('failed')} AS h
        FROM failed_check
        UNION ALL
        SELECT run_id, 'threshold', '', threshold_query_description, {_weight('threshold')}, {_hash('threshold')}
        FROM threshold_breach""",
    "sizes": f"""
        SELECT run_id, greatest(1, ceil(coalesce(sum(w), 0) / {SMALL_PAGE}))::INT AS n_pages
        FROM (SELECT DISTINCT run_id FROM suite_status) LEFT JOIN listed USING (run_id)
        GROUP BY run_id""",
    "page_list": """
        SELECT run_id, n_pages, unnest(range(n_pages))::INT AS page_no FROM sizes""",
    "placed": """
        SELECT l.*, (h % n_pages)::INT AS page_no FROM listed l JOIN sizes USING (run_id)""",
}

_ASSEMBLE_PAGES = """
SELECT p.run_id, p.page_no, p.n_pages, true AS has_suite,
       coalesce(string_agg(x.item, ',' ORDER BY x.place, x.item) FILTER (WHERE x.section = 'failed'), '') AS test_codes,
       coalesce(string_agg(x.item, ',' ORDER BY x.place, x.item) FILTER (WHERE x.section = 'threshold'), '') AS breaches
FROM page_list p LEFT JOIN placed x ON p.run_id = x.run_id AND p.page_no = x.page_no
GROUP BY p.run_id, p.page_no, p.n_pages"""

# ------------------------------------------------------------------ alerts

_RULES = """
        SELECT * FROM (VALUES
            ('any_failure', 'failure_count', 0.0::DOUBLE, 0),
            ('many_failures', 'failure_count', 1.0::DOUBLE, 21600),
            ('large_suite', 'total_count', 5.0::DOUBLE, 7200)
        ) AS r(rule_id, metric, threshold, rearm_seconds)"""

_ALERTS = {
    "alert_rule": _RULES,
    "metrics": """
        SELECT run_id, suite_category, metric, value
        FROM (SELECT run_id, suite_category, total_count, success_count, failure_count FROM suite_status)
        UNPIVOT (value FOR metric IN (total_count, success_count, failure_count))""",
    "evaluated": """
        SELECT rule_id, run_id, suite_category, metric, value, threshold, rearm_seconds,
               value::DOUBLE > threshold AS fired
        FROM metrics JOIN alert_rule USING (metric)""",
    "state": """
        SELECT rule_id, suite_category, run_id, bool_or(fired) AS fired
        FROM evaluated GROUP BY rule_id, suite_category, run_id""",
    "changes": """
        SELECT rule_id, suite_category, run_id, fired,
               CASE WHEN fired THEN 'TRIGGERED' ELSE 'RESOLVED' END AS change
        FROM (SELECT *, coalesce(lag(fired) OVER (PARTITION BY rule_id, suite_category ORDER BY run_id), false) AS was
              FROM state)
        WHERE fired <> was""",
}

_SUBSCRIPTIONS = """
        SELECT CASE n_nationkey % 3 WHEN 0 THEN 'any_failure' WHEN 1 THEN 'many_failures' ELSE '15min' END AS rule_id,
               'user' AS kind, lower(replace(n_name, ' ', '_')) || '@example.com' AS address,
               n_nationkey % 7 = 0 AS paused
        FROM nation
        UNION ALL
        SELECT CASE r_regionkey % 3 WHEN 0 THEN 'any_failure' WHEN 1 THEN 'many_failures' ELSE '15min' END,
               'destination', 'group-' || lower(replace(r_name, ' ', '_')), false
        FROM region"""

_FANOUT = {
    **_ALERTS,
    "subscription": _SUBSCRIPTIONS,
    "deliveries": """
        SELECT rule_id, suite_category, run_id, kind, address
        FROM changes JOIN subscription USING (rule_id)
        WHERE change = 'TRIGGERED' AND NOT paused""",
    "run_status": """
        SELECT run_id, min(execution_status) AS execution_status FROM suite_status GROUP BY run_id""",
    "alert_mail": """
        SELECT md5('alert|' || kind || '|' || address || '|' || run_id || '|' || rule_id || '|' || suite_category) AS delivery_id,
               'alert' AS kind, kind AS channel, address, run_id,
               'Regression Report - Run ' || run_id || ' - ' || execution_status AS subject,
               '{"rule_id":"' || rule_id || '","suite_category":"' || suite_category
               || '","body":"reports/report_run_' || run_id || '.html"}' AS payload,
               'READY' AS mode, 'READY' AS status
        FROM deliveries JOIN run_status USING (run_id)""",
    "alert_box": """
        SELECT *, length(payload)::BIGINT AS n_chars, octet_length(encode(payload))::BIGINT AS n_bytes
        FROM alert_mail""",
}

_NOTIFICATIONS = {
    **_ALERTS,
    "run_time": "SELECT run_id, epoch(min(date_trunc('second', ts)))::BIGINT AS sec FROM e GROUP BY run_id",
    # Every run by itself, in the order of time and id.
    "timed": """
        SELECT rule_id, suite_category, sec, run_id, bool_or(fired) AS fired, max(rearm_seconds) AS rearm,
               row_number() OVER (PARTITION BY rule_id, suite_category ORDER BY sec NULLS LAST, run_id) AS n
        FROM evaluated LEFT JOIN run_time USING (run_id)
        GROUP BY rule_id, suite_category, run_id, sec""",
    "walk": """
        SELECT rule_id, suite_category, n, fired, run_id, sec, fired AS fires,
               CASE WHEN fired THEN sec END AS last_fire, 'FIRST' AS reason
        FROM timed WHERE n = 1
        UNION ALL
        SELECT t.rule_id, t.suite_category, t.n, t.fired, t.run_id, t.sec,
               t.fired AND (NOT w.fired OR coalesce(t.rearm > 0 AND t.sec - w.last_fire >= t.rearm, false)),
               CASE WHEN t.fired AND (NOT w.fired OR coalesce(t.rearm > 0 AND t.sec - w.last_fire >= t.rearm, false))
                    THEN t.sec ELSE w.last_fire END,
               CASE WHEN w.fired THEN 'AGAIN' ELSE 'FIRST' END
        FROM walk w JOIN timed t
          ON t.rule_id = w.rule_id AND t.suite_category = w.suite_category AND t.n = w.n + 1""",
}

_MAILS_AGAIN = {
    **_NOTIFICATIONS,
    "subscription": _SUBSCRIPTIONS,
    "run_status": _FANOUT["run_status"],
    "again_mail": """
        SELECT md5('alert|' || x.kind || '|' || x.address || '|' || run_id || '|' || rule_id || '|' || suite_category
                   || CASE WHEN reason = 'AGAIN' THEN '|' || fired_at ELSE '' END) AS delivery_id,
               'alert' AS kind, x.kind AS channel, x.address, run_id,
               'Regression Report - Run ' || run_id || ' - ' || execution_status AS subject,
               '{"rule_id":"' || rule_id || '","suite_category":"' || suite_category
               || '","body":"reports/report_run_' || run_id || '.html"'
               || CASE WHEN reason = 'AGAIN' THEN ',"again_at":"' || fired_at || '"' ELSE '' END || '}' AS payload,
               'READY' AS mode, 'READY' AS status, reason
        FROM (SELECT *, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') AS fired_at FROM walk WHERE fires)
        JOIN subscription x USING (rule_id) JOIN run_status USING (run_id)
        WHERE NOT x.paused""",
    "again_box": """
        SELECT * EXCLUDE reason, length(payload)::BIGINT AS n_chars, octet_length(encode(payload))::BIGINT AS n_bytes
        FROM again_mail""",
}

# ---------------------------------------------------------------- delivery

_SUITE_LINE = (
    "'Suite: ' || suite_category || ' | Total ' || total_count || ' · Success ' || success_count "
    "|| ' · Failure ' || failure_count || ' | Elapsed ' || elapsed_time || chr(10) || 'Run user: ' || run_user"
)
_TITLE = "'Regression run ' || run_id || ' — ' || execution_status"
_CARD = (
    f"{_TITLE} || chr(10) || {_SUITE_LINE} || chr(10) "
    "|| 'Full report on volume: /reports/report_run_' || run_id || '.html'"
)

_MAILS = {
    **_report("plain"),
    "mails": """
        SELECT run_id, html,
               'Regression Report — Run ' || run_id || ' — ' || execution_status AS subject,
               CASE total_count % 4 WHEN 0 THEN 'resend' WHEN 1 THEN 'graph' WHEN 2 THEN 'ses' ELSE 'fax' END AS provider,
               CASE WHEN total_count % 2 = 0 THEN 'sender@example.com' ELSE '' END AS sender,
               CASE WHEN total_count % 3 <> 0 THEN [run_user, 'team@example.com'] ELSE []::VARCHAR[] END AS recipients,
               CASE WHEN total_count % 5 <> 0 THEN md5(run_id) END AS token,
               total_count % 2 = 0 AS dry_run
        FROM report JOIN first_suite USING (run_id)""",
}

_JSON = {
    "graph": """
        {'message': {'subject': subject, 'body': {'contentType': 'HTML', 'content': html},
                     'toRecipients': list_transform(recipients, lambda r: {'emailAddress': {'address': r}})},
         'saveToSentItems': true}""",
    "ses": """
        {'Source': sender, 'Destination': {'ToAddresses': recipients},
         'Message': {'Subject': {'Data': subject}, 'Body': {'Html': {'Data': html}}}}""",
    "resend": """
        {'from': CASE WHEN sender = '' THEN 'onboarding@resend.dev' ELSE sender END,
         'to': recipients, 'subject': subject, 'html': html}""",
}


def _email(provider: str) -> str:
    return _sql(
        f"SELECT run_id, md5(to_json({_JSON[provider]})::VARCHAR) AS payload_md5 FROM mails", **_MAILS
    )


_PREVIEW = """
SELECT run_id, CASE provider
    WHEN 'resend' THEN 'DRY RUN resend' || chr(10) || 'POST https://api.resend.com/emails' || chr(10)
        || 'Authorization: Bearer ' || tok || chr(10)
        || 'from=' || CASE WHEN sender = '' THEN 'onboarding@resend.dev' ELSE sender END
        || ' to=' || people || ' subject=' || subject || ' html=' || note
    WHEN 'graph' THEN 'DRY RUN graph' || chr(10) || 'POST https://graph.microsoft.com/v1.0/users/' || sender
        || '/sendMail' || chr(10) || 'Authorization: Bearer ' || tok || chr(10)
        || 'Content-Type: application/json' || chr(10) || 'message='
        || to_json({'subject': subject, 'body': {'contentType': 'HTML', 'content': note},
                    'toRecipients': list_transform(recipients, lambda r: {'emailAddress': {'address': r}})})::VARCHAR
    WHEN 'ses' THEN 'DRY RUN ses' || chr(10) || 'ses:SendEmail region=<region>' || chr(10) || 'Source=' || sender
        || ' To=' || people || chr(10) || 'Subject=' || subject || ' Body=' || note
    END AS preview
FROM (SELECT *, '<' || length(html) || ' characters, ' || octet_length(encode(html)) || ' bytes of HTML>' AS note,
             '[' || coalesce(array_to_string(recipients, ', '), '') || ']' AS people,
             CASE WHEN token IS NULL THEN '<none>' ELSE substr(token, 1, 6) || '…redacted…' END AS tok
      FROM mails)"""

_SPACES = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


# ----------------------------------------------------------------- cadence

_BOUNDS = {
    "bounds": """
        SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi FROM events""",
}


def _steps(step: str) -> str:
    return f"SELECT unnest(generate_series(lo, hi, INTERVAL {step})) AS slot FROM bounds"


def _local(time: str, days: str) -> str:
    """Slots at a local time on some weekdays (Sunday = 0), as UTC."""
    return f"""
        SELECT slot FROM (
            SELECT lo, hi, timezone('UTC', timezone('America/New_York', day + INTERVAL '{time}')) AS slot
            FROM (SELECT lo, hi, unnest(generate_series(lo - INTERVAL 1 DAY, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day
                  FROM bounds)
            WHERE dayofweek(day) IN ({days}))
        WHERE slot BETWEEN lo AND hi"""


_DAILY = _local("7 hours", "0,1,2,3,4,5,6")
_WEEKDAYS = _local("7 hours", "1,2,3,4,5")
_WEEKLY = _local("7 hours", "1")
_ONCE = f"SELECT min(slot) AS slot FROM ({_local('14 hours 55 minutes', '0,1,2,3,4,5,6')})"


def _asof(slots: str, known: str = "SELECT run_id, ts FROM e") -> dict[str, str]:
    """Slots with the latest run before or at them."""
    return {
        **_BOUNDS,
        "slots": slots,
        "known": known,
        "best": """
            SELECT slot, max(top) OVER (ORDER BY slot) AS run_id FROM (
                SELECT s.slot, max(k.run_id) AS top
                FROM (SELECT slot, lag(slot) OVER (ORDER BY slot) AS before FROM slots) s
                LEFT JOIN known k ON k.ts <= s.slot AND (s.before IS NULL OR k.ts > s.before)
                GROUP BY s.slot)""",
    }


def _debounce(key: str, gap: str) -> str:
    body = f"SELECT {key}, fire AS fire_ts, sum(n)::BIGINT AS n_updates FROM walk GROUP BY {key}, fire"
    return _sql(
        body,
        counted=f"SELECT {key}, ts, count(*) AS n FROM events GROUP BY {key}, ts",
        ordered=f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM counted",
        walk=f"""
            SELECT {key}, i, ts, n, ts AS fire FROM ordered WHERE i = 1
            UNION ALL
            SELECT o.{key}, o.i, o.ts, o.n,
                   CASE WHEN w.fire >= o.ts THEN w.fire ELSE greatest(o.ts, w.fire + {gap}) END
            FROM walk w JOIN ordered o ON o.{key} = w.{key} AND o.i = w.i + 1""",
    )


_PAIRED = {
    **_FANOUT,
    **_asof(_steps("15 MINUTE"), "SELECT run_id, min(ts) AS ts FROM e GROUP BY run_id"),
    "bounds": """
        SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi
        FROM (SELECT run_id, min(ts) AS ts FROM e GROUP BY run_id)""",
    "snapshot": """
        SELECT 'snapshot' AS kind, s.kind AS channel, s.address, b.run_id,
               'Regression Report - Run ' || b.run_id || ' - snapshot' AS subject,
               '{"cadence":"15min","slot":"' || strftime(b.slot, '%Y-%m-%d %H:%M')
               || '","body":"reports/report_run_' || b.run_id || '.html"}' AS payload, 'READY' AS status
        FROM best b JOIN subscription s ON s.rule_id = '15min' AND NOT s.paused
        WHERE b.run_id IS NOT NULL""",
}

# -------------------------------------------------------------------- spec

_LAYOUT = f"""
SELECT dataset, ordinal, kind, name, text, height, 0 AS x,
       coalesce(sum(height) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS y,
       12 AS width,
       CASE dataset
           WHEN 'request_ds' THEN (SELECT count(*) FROM run_request WHERE run_id = {_LATEST})
           WHEN 'suite_ds' THEN (SELECT count(*) FROM suite_status WHERE run_id = {_LATEST})
           WHEN 'failed_ds' THEN (SELECT count(*) FROM failed_check WHERE run_id = {_LATEST})
           WHEN 'threshold_ds' THEN (SELECT count(*) FROM threshold_breach WHERE run_id = {_LATEST})
       END AS n_rows
FROM (VALUES
    (0, 'text', 'title', NULL, '## Regression Report', 1),
    (1, 'text', 'subtitle', NULL, 'Latest run, read from the report tables.', 1),
    (2, 'text', 'h_req', NULL, '### Request Summary', 1),
    (3, 'table', 't_req', 'request_ds', NULL, 3),
    (4, 'text', 'h_suite', NULL, '### Execution Suite Status Summary', 1),
    (5, 'table', 't_suite', 'suite_ds', NULL, 3),
    (6, 'text', 'h_failed', NULL, '### Execution Failed Query Summary Status', 1),
    (7, 'table', 't_failed', 'failed_ds', NULL, 4),
    (8, 'text', 'h_thr', NULL, '### Threshold Summary Status', 1),
    (9, 'table', 't_thr', 'threshold_ds', NULL, 3)
) AS w(ordinal, kind, name, dataset, text, height)"""

_SECTION_SPEC = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(s.name + '_ds')}, {i}, {q(f.name)}, {q(f.title)})"
    for s in SECTIONS.values()
    for i, f in enumerate(s.fields)
) + ") AS c(dataset, ordinal, field, label)"

_DATASETS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(s.name + '_ds')}, {q(s.title)}, "
    f"{q('SELECT ' + ', '.join(s.columns) + ' FROM ' + s.table + ' WHERE run_id = ' + _LATEST)})"
    for i, s in enumerate(SECTIONS.values())
) + ") AS d(i, name, title, query)"

_DEFINITION = """
SELECT to_json({
    'datasets': (SELECT list({'name': name, 'displayName': title, 'queryLines': [query]} ORDER BY i) FROM dataset),
    'pages': [{'name': 'report', 'displayName': 'Regression Report', 'layout':
        (SELECT list({'widget': {'name': name, 'kind': kind, 'text': text, 'dataset': l.dataset,
                                 'columns': c.columns, 'n_rows': n_rows},
                      'position': {'x': x, 'y': y, 'width': width, 'height': height}} ORDER BY l.ordinal)
         FROM layout l LEFT JOIN (
             SELECT dataset, list({'fieldName': field, 'displayName': label} ORDER BY ordinal) AS columns
             FROM section_spec GROUP BY dataset) c USING (dataset))}]
})::VARCHAR AS json"""

_CHAT_BOX = f"""
SELECT md5('chat|generic|https://example.com/hook|' || run_id) AS delivery_id, 'chat' AS kind,
       'generic' AS channel, 'https://example.com/hook' AS address, run_id, {_TITLE} AS subject,
       payload, 'READY' AS mode, 'READY' AS status, length(payload)::BIGINT AS n_chars,
       octet_length(encode(payload))::BIGINT AS n_bytes
FROM (SELECT *, to_json({{'text': {_CARD}}})::VARCHAR AS payload FROM first_suite)"""

_EMAIL_BOX = """
SELECT md5('email|resend|a@example.com, b@example.com|' || run_id || '|0') AS delivery_id, 'email' AS kind,
       'resend' AS channel, 'a@example.com, b@example.com' AS address, run_id, subject,
       md5(to_json({'from': 'onboarding@resend.dev', 'to': ['a@example.com', 'b@example.com'],
                    'subject': subject, 'html': html})::VARCHAR) AS payload,
       'READY' AS mode, 'READY' AS status, length(html)::BIGINT AS n_chars,
       octet_length(encode(html))::BIGINT AS n_bytes, 0 AS part_no, 1 AS n_parts
FROM (SELECT run_id, html, 'Regression Report — Run ' || run_id || ' — ' || execution_status AS subject
      FROM report JOIN first_suite USING (run_id))"""

_COUNTS = """
SELECT s.run_id, 0 AS page_no, 1 AS n_pages, r.run_id IS NOT NULL AS has_request, s.suite_category,
       coalesce(f.n, 0)::INT AS n_failed, coalesce(t.n, 0)::INT AS n_thresholds
FROM first_suite s
LEFT JOIN first_request r USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM failed_check GROUP BY run_id) f USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM threshold_breach GROUP BY run_id) t USING (run_id)"""

_ALL_ROWS = f"""
SELECT s.run_id, coalesce(r.n, 0)::INT AS n_requests, s.suites, coalesce(f.codes, '') AS test_codes,
       coalesce(t.breaches, '') AS breaches
FROM (SELECT run_id, string_agg(suite_category, ',' ORDER BY {', '.join(_SUITE_COLUMNS)}) AS suites
      FROM suite_status GROUP BY run_id) s
LEFT JOIN (SELECT run_id, count(*) AS n FROM run_request GROUP BY run_id) r USING (run_id)
LEFT JOIN (SELECT run_id, string_agg(test_code, ',' ORDER BY {_FAILED_ORDER}) AS codes
           FROM failed_check GROUP BY run_id) f USING (run_id)
LEFT JOIN (SELECT run_id, string_agg(threshold_query_description, ',' ORDER BY threshold_query_description) AS breaches
           FROM threshold_breach GROUP BY run_id) t USING (run_id)"""

_PRESENCE = """
SELECT * FROM (
    SELECT run_id, bool_or(section = 'request') AS has_request, bool_or(section = 'suite') AS has_suite,
           bool_or(section = 'failed') AS has_failed, bool_or(section = 'threshold') AS has_threshold
    FROM (SELECT run_id, 'request' AS section FROM run_request UNION ALL SELECT run_id, 'suite' FROM suite_status
          UNION ALL SELECT run_id, 'failed' FROM failed_check
          UNION ALL SELECT run_id, 'threshold' FROM threshold_breach)
    GROUP BY run_id)
WHERE NOT (has_request AND has_suite AND has_failed AND has_threshold)"""

ORACLE: dict[str, str] = {
    "latest_run_summary": _section("suite"),
    "latest_run_top1": _sql("SELECT run_id FROM suite_status ORDER BY run_id DESC LIMIT 1"),
    "latest_numeric_vs_lexical": """
        SELECT max(o_orderkey::VARCHAR) AS lexical, max(o_orderkey)::VARCHAR AS numeric FROM orders""",
    "latest_numeric": "SELECT max(o_orderkey)::VARCHAR AS run_id FROM orders",
    "run_param_default": _sql("""
        SELECT CASE WHEN event_id % 4 = 2 THEN run_id ELSE (SELECT max(run_id) FROM e) END AS resolved,
               count(*) AS n
        FROM e GROUP BY ALL"""),
    "section_request": _section("request"),
    "section_suite": _section("suite"),
    "section_failed": _section("failed"),
    "section_threshold": _section("threshold"),
    "section_request_labels": _section("request", labels=True),
    "failed_of_breached_runs": _sql(
        "SELECT * FROM failed_check WHERE run_id IN (SELECT run_id FROM threshold_breach)"
    ),
    "breaches_of_failed_runs": _sql(
        "SELECT * FROM threshold_breach WHERE run_id IN (SELECT run_id FROM failed_check)"
    ),
    "assemble_counts": _sql(_COUNTS),
    "assemble_pages": _sql(_ASSEMBLE_PAGES, **_PAGES),
    "assemble_all_rows": _sql(_ALL_ROWS),
    "first_row_per_run": _sql("SELECT * FROM first_suite"),
    "first_row_by_window": _sql(f"""
        SELECT * EXCLUDE n FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_FAILED_ORDER}) AS n FROM failed_check)
        WHERE n = 1"""),
    "incomplete_runs": _sql(_PRESENCE),
    "runs_without_request": _sql("""
        SELECT DISTINCT run_id FROM suite_status WHERE run_id NOT IN (SELECT run_id FROM run_request)"""),
    "runs_with_breach": _sql("""
        SELECT DISTINCT run_id FROM suite_status WHERE run_id IN (SELECT run_id FROM threshold_breach)"""),
    "counter_mismatch": _sql("""
        SELECT run_id, suite_category, total_count + 1 AS total_count, success_count, failure_count
        FROM suite_status WHERE total_count % 3 = 0"""),
    "render_rows": _sql(f"SELECT run_id, test_code, {_row('failed', 'full')} AS html FROM failed_check"),
    "render_full": _render("full"),
    "render_compact": _render("compact"),
    "render_plain": _render("plain"),
    "render_all_rows": _render("compact", "all"),
    "strip_borders": _render(
        "plain", html="""regexp_replace(html, ' (style|border)="[^"]*"', '', 'g')"""
    ),
    "report_files_hot": _coarse("%Y", "SELECT run_id, md5(html) AS html_md5 FROM report", **_report("compact")),
    "report_files_hot_all": _coarse("%Y", "SELECT run_id, md5(html) AS html_md5 FROM report", **_report("full", "all")),
    "report_parts": _coarse(
        "%Y%m",
        """SELECT run_id, true AS complete, true AS joined, true AS bounded, length(html)::BIGINT AS n_chars,
                  length(html)::BIGINT AS said_chars, octet_length(encode(html))::BIGINT AS n_bytes,
                  octet_length(encode(html))::BIGINT AS said_bytes
           FROM report""",
        **_report("plain"),
    ),
    "email_hot_run": _coarse(
        "%Y",
        f"""SELECT md5('email|graph|a@example.com, b@example.com|' || run_id || '|0') AS delivery_id, run_id, subject,
                   'READY' AS status, length(html)::BIGINT AS n_chars, octet_length(encode(html))::BIGINT AS n_bytes,
                   md5(to_json({_JSON['graph']})::VARCHAR) AS payload_md5
            FROM (SELECT run_id, html, ['a@example.com', 'b@example.com'] AS recipients,
                         'Regression Report — Run ' || run_id || ' — ' || execution_status AS subject
                  FROM report JOIN first_suite USING (run_id))""",
        **_report("plain"),
    ),
    "report_links": _sql(
        """SELECT run_id || x AS run_id, true AS there, run_id || x AS id_of_path
           FROM (SELECT run_id, ['', '/../../b', ' %41 ', '/ä ß', '%2F..', '+&?#', '..']
                                [right(run_id, 1)::INT % 7 + 1] AS x FROM report)""",
        **_report("compact"),
    ),
    "report_files": _sql("SELECT run_id, md5(html) AS html_md5 FROM report", **_report("compact")),
    "stored_tables": _sql("""
        SELECT run_id, suite_category, CASE WHEN status = 'FAIL' THEN 2 ELSE 1 END::BIGINT AS n,
               (total_count * CASE WHEN status = 'FAIL' THEN 2 ELSE 1 END)::BIGINT AS total
        FROM suite_status"""),
    "alert_eval": _sql("SELECT * EXCLUDE rearm_seconds FROM evaluated", **_ALERTS),
    "alert_run_verdict": _sql(
        """SELECT rule_id, run_id, bool_or(fired) AS fired, count(*) FILTER (WHERE fired) AS n_fired,
                  sum(value)::BIGINT AS total_value
           FROM evaluated GROUP BY rule_id, run_id""",
        **_ALERTS,
    ),
    "alert_transitions": _sql("SELECT * FROM changes", **_ALERTS),
    "alert_transitions_sliced": _sql("SELECT * FROM changes", **_ALERTS),
    "alert_notifications": _sql(
        """SELECT rule_id, suite_category, run_id, make_timestamp(sec * 1000000) AS fire_ts, reason
           FROM walk WHERE fires""",
        **_NOTIFICATIONS,
    ),
    "alert_mails_again": _sql("SELECT * FROM again_box", **_MAILS_AGAIN),
    "alert_bodies": _sql(
        """SELECT delivery_id, run_id, '{"rule_id":"' || rule_id || '","suite_category":"' || suite_category
                  || '","body":"/r/report_run_' || run_id || '.html","body_md5":"' || md5(html) || '"}' AS payload, true AS there
           FROM (SELECT d.*, md5('alert|' || kind || '|' || address || '|' || run_id || '|' || rule_id || '|' || suite_category)
                        AS delivery_id FROM deliveries d) JOIN report USING (run_id)""",
        **_FANOUT,
        **_report("plain"),
    ),
    "runs_by_bucket": _sql(
        "SELECT * FROM failed_check WHERE run_id[1:8] = (SELECT min(run_id)[1:8] FROM suite_status)"
    ),
    "alert_job_rearmed": _coarse(
        "%Y%m%d",
        "SELECT * FROM again_box WHERE run_id = (SELECT max(run_id) FROM walk WHERE fires AND reason = 'AGAIN')",
        **{**_MAILS_AGAIN, "alert_rule": _RULES.replace("21600", "21600 * 12").replace("7200", "7200 * 12")},
    ),
    "stream_notifications": _sql(
        """SELECT rule_id, suite_category, run_id, make_timestamp(sec * 1000000) AS fire_ts, reason
           FROM walk WHERE fires""",
        **_NOTIFICATIONS,
    ),
    "stream_mails_again": _sql("SELECT * FROM again_box", **_MAILS_AGAIN),
    "subscribers": """
        SELECT 'user' AS kind, lower(c_name) AS address, c_nationkey AS team FROM customer
        UNION ALL SELECT 'destination', lower(s_name), s_nationkey FROM supplier""",
    "subscription_records": """
        SELECT 'user' AS kind, lower(c_name) AS address,
               '{"subscriber":{"user_subscriber":{"user_id":"' || lower(c_name) || '"}}}' AS schedule_record,
               '{"user_name":"' || lower(c_name) || '"}' AS alert_record
        FROM customer
        UNION ALL
        SELECT 'destination', lower(s_name),
               '{"subscriber":{"destination_subscriber":{"destination_id":"' || lower(s_name) || '"}}}',
               '{"destination_id":"' || lower(s_name) || '"}'
        FROM supplier""",
    "alert_fanout": _sql("SELECT * FROM deliveries", **_FANOUT),
    "alert_outbox": _sql("SELECT * FROM alert_box", **_FANOUT),
    "alert_latest": _sql(
        f"""SELECT s.run_id, x.kind AS channel, x.address,
                   'Regression Report - Run ' || s.run_id || ' - ' || execution_status AS subject
            FROM changes s JOIN subscription x USING (rule_id) JOIN run_status USING (run_id)
            WHERE s.run_id = {_LATEST} AND s.change = 'TRIGGERED' AND NOT x.paused""",
        **_FANOUT,
    ),
    "parse_recipients": f"""
        SELECT doc_id, (unnest(range(len(entries))))::INT AS position, md5(unnest(entries)) AS entry_md5
        FROM (SELECT doc_id, list_filter(
                         list_transform(string_split(text, ','), lambda x: {_trim('x')}),
                         lambda x: x <> '') AS entries
              FROM documents)""",
    "subject_line": _sql("""
        SELECT run_id,
               CASE WHEN total_count % 2 = 0 THEN 'Run ' || run_id
                    ELSE 'Regression Report — Run ' || run_id || ' — ' || st END AS subject,
               'Regression Report - Run ' || run_id || ' - ' || st AS alert_subject
        FROM (SELECT *, CASE WHEN total_count % 5 <> 0 THEN execution_status ELSE 'None' END AS st
              FROM first_suite)"""),
    "card_text": _sql(f"SELECT run_id, {_CARD} AS text FROM first_suite"),
    "card_text_link": _sql(f"""
        SELECT s.run_id, t || CASE WHEN r.run_id IS NOT NULL
                    THEN chr(10) || 'Full report: https://example.com/' || s.run_id ELSE '' END AS text
        FROM (SELECT run_id, '*' || {_TITLE} || '*' || chr(10) || {_SUITE_LINE} AS t FROM first_suite) s
        LEFT JOIN first_request r USING (run_id)"""),
    "chat_payload": _sql(
        f"SELECT run_id, to_json({{'text': {_CARD}}})::VARCHAR AS payload FROM first_suite"
    ),
    "card_payload": _sql(f"""
        SELECT run_id, to_json({{'@type': 'MessageCard', '@context': 'http://schema.org/extensions',
                   'themeColor': 'D7263D', 'summary': 'Regression run ' || run_id || ' ' || status,
                   'title': {_TITLE}, 'text': replace({_CARD}, chr(10), '  ' || chr(10))}})::VARCHAR AS payload
        FROM first_suite"""),
    "chat_outbox": _sql(_CHAT_BOX),
    "email_payload_graph": _email("graph"),
    "email_payload_ses": _email("ses"),
    "email_payload_resend": _email("resend"),
    "dry_run_preview": _sql(_PREVIEW, **_MAILS),
    "email_route": _sql(
        """SELECT run_id, provider, len(recipients)::INT AS n_recipients,
                  CASE WHEN len(recipients) = 0 THEN 'RENDER_ONLY' WHEN provider = 'fax' THEN 'UNKNOWN_PROVIDER'
                       WHEN dry_run THEN 'DRY_RUN' ELSE 'READY' END AS status
           FROM mails""",
        **_MAILS,
    ),
    "email_outbox": _sql(_EMAIL_BOX, **_report("compact")),
    "text_utils": f"""
        SELECT doc_id, substr(trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')), 1, 80) AS one_line,
               right(text, 400) AS tail, md5({_trim('text')}) AS trimmed_md5,
               length(text)::BIGINT AS n_chars, octet_length(encode(text))::BIGINT AS n_bytes,
               octet_length(encode(text))::BIGINT AS n_encoded,
               CASE WHEN coalesce(text, '') = '' THEN '<none>' ELSE substr(text, 1, 6) || '…redacted…' END AS redacted,
               md5('lang=' || replace(url_encode(lang), '%20', '+')
                   || '&text=' || replace(url_encode(text), '%20', '+')) AS form_md5,
               md5(replace(text, chr(10), '  ' || chr(10))) AS markdown_md5
        FROM documents""",
    "json_utils": """
        SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props ELSE '{}' END AS part,
               CASE WHEN event_id % 5 <> 0 THEN cast(props->>'$.k' AS INT) END AS k,
               '/reports/report_run_' || event_id || '.html' AS path
        FROM events""",
    "cadence_15min": _sql(_steps("15 MINUTE"), **_BOUNDS),
    "cadence_hourly": _sql(_steps("1 HOUR"), **_BOUNDS),
    "cadence_daily": _sql(_DAILY, **_BOUNDS),
    "cadence_weekdays": _sql(_WEEKDAYS, **_BOUNDS),
    "cadence_weekly": _sql(_WEEKLY, **_BOUNDS),
    "cadence_once": _sql(_ONCE, **_BOUNDS),
    "snapshot_asof": _sql("SELECT slot, run_id FROM best", **_asof(_steps("15 MINUTE"))),
    "snapshot_weekdays": _sql("SELECT slot, run_id FROM best", **_asof(_WEEKDAYS)),
    "debounce_updates": _debounce("user_id", GAP),
    "debounce_runs": _debounce("event_type", "INTERVAL 1 MINUTE"),
    "paired_delivery": _sql(
        """SELECT kind, channel, address, run_id, subject, payload, status FROM alert_mail
           UNION ALL SELECT * FROM snapshot""",
        **_PAIRED,
    ),
    "report_layout": _sql(_LAYOUT),
    "report_definition": _sql(
        _DEFINITION, layout=_LAYOUT, section_spec=_SECTION_SPEC, dataset=_DATASETS
    ),
    "upsert_definitions": _sql("""
        SELECT coalesce(u.id, o.run_id) AS id, coalesce(u.name, o.task_id) AS name, coalesce(u.version, 0) AS version
        FROM run_request o
        FULL OUTER JOIN (SELECT run_id AS id, max(threshold_query_description) AS name, count(*)::INT AS version
                         FROM threshold_breach GROUP BY run_id) u ON u.id = o.run_id"""),
    "upsert_buckets": _sql("""
        SELECT coalesce(u.id, o.run_id) AS id, coalesce(u.name, o.task_id) AS name, coalesce(u.version + 10, 0)::INT AS version
        FROM run_request o
        FULL OUTER JOIN (SELECT run_id AS id, max(threshold_query_description) AS name, count(*)::INT AS version
                         FROM threshold_breach GROUP BY run_id) u ON u.id = o.run_id"""),
    "once_sent": _sql(
        """SELECT x.kind AS channel, x.address, b.run_id,
                  '{"cadence":"launch","slot":"' || strftime(b.slot, '%Y-%m-%d %H:%M')
                  || '","body":"reports/report_run_' || b.run_id || '.html"}' AS payload
           FROM best b JOIN subscription x ON x.rule_id = '15min' AND NOT x.paused WHERE b.run_id IS NOT NULL""",
        **{
            **_asof(_ONCE, "SELECT run_id, min(ts) AS ts FROM e GROUP BY run_id"),
            "bounds": _PAIRED["bounds"],
            "subscription": _SUBSCRIPTIONS,
        },
    ),
    "stream_outbox": _sql("SELECT * FROM alert_box", **_FANOUT),
    "stream_alerts_again": _sql("SELECT * FROM alert_box", **_FANOUT),
    "slots_half_hour_zone": """
        SELECT lo + to_minutes(30) + to_hours(h) AS slot
        FROM (SELECT date_trunc('day', min(ts))::TIMESTAMP AS lo,
                     date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 1 DAY AS hi FROM events),
             range(0, 24 * 4000) AS t(h)
        WHERE lo + to_minutes(30) + to_hours(h) <= hi""",
    "transitions_numeric": """
        SELECT rule_id, suite_category, run_id, fired,
               CASE WHEN fired THEN 'TRIGGERED' ELSE 'RESOLVED' END AS change
        FROM (SELECT 'r' AS rule_id, o_orderpriority AS suite_category, o_orderkey::VARCHAR AS run_id,
                     o_orderstatus = 'F' AS fired,
                     lag(o_orderstatus = 'F', 1, false) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS was
              FROM orders)
        WHERE fired <> was""",
    "snapshot_half_minutes": _sql(
        "SELECT slot, run_id FROM best",
        **{
            **_asof(_steps("30 SECOND"), "SELECT run_id, min(ts) AS ts FROM e GROUP BY run_id"),
            "bounds": _PAIRED["bounds"],
        },
    ),
    "stream_alerts_once": _sql("SELECT * FROM alert_box", **_FANOUT),
    "stream_any_table": _sql("""
        SELECT 'suite_status' AS source, run_id, count(*) AS n FROM suite_status GROUP BY run_id
        UNION ALL SELECT 'failed_check', run_id, count(*) FROM failed_check GROUP BY run_id
        UNION ALL SELECT 'threshold_breach', run_id, count(*) FROM threshold_breach GROUP BY run_id"""),
    "jobs_run_again": _sql(f"""
        SELECT md5('chat|slack|https://example.com/h|' || run_id) AS delivery_id, 'chat' AS kind, 'slack' AS channel,
               'https://example.com/h' AS address, run_id, {_TITLE} AS subject, 'READY' AS status
        FROM first_suite WHERE run_id = {_LATEST}
        UNION ALL
        SELECT md5('email|ses|a@example.com|' || run_id || '|0'), 'email', 'ses', 'a@example.com', run_id,
               'Regression Report — Run ' || run_id || ' — ' || execution_status, 'READY'
        FROM first_suite WHERE run_id = {_LATEST}"""),
    "run_by_id": _sql(
        "SELECT * FROM failed_check WHERE run_id = (SELECT min(run_id) FROM threshold_breach)"
    ),
    "views_as_sql": _sql(f"""
        SELECT s.run_id, s.suite_category, s.run_id = {_LATEST} AS is_latest, f.n AS n_failed
        FROM suite_status s LEFT JOIN (
            SELECT run_id, suite_category, count(*) AS n FROM failed_check GROUP BY run_id, suite_category) f
        USING (run_id, suite_category)"""),
    "stream_reports": _sql(f"""
        SELECT run_id, 'generic' AS channel, 'https://example.com/hook' AS address, {_TITLE} AS subject,
               'READY' AS status FROM first_suite"""),
    "stream_emails": _sql(_EMAIL_BOX, **_report("compact")),
    "stream_debounce": _debounce("user_id", GAP),
}
