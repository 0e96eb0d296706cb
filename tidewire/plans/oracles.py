"""SQL that gives the results of the registered queries from the test tables.

Written for another engine, straight from the definitions: evaluation times are
joined with every sample of their window, routes follow from the kind of fault.
"""

from __future__ import annotations

from tidewire.operators.naming import BROKER_RULES, REBALANCER_RULES
from tidewire.plans import panels
from tidewire.sources import fixtures


def _with_text_behind(whole: str, number: str) -> str:
    return (
        f"CASE {number} % 4 WHEN 1 THEN {whole} || '] trailing' WHEN 2 THEN {whole} || '],[' || {whole} "
        f'''WHEN 3 THEN {whole} || '}},"w":' || {whole} ELSE '{{"id":' END'''
    )


# The faulty records: what each event became, and where it must go.
RECORDS = f"""
raw AS (
  SELECT *, event_id % 20 AS m,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso
  FROM events
),
good AS (
  SELECT *, '{{"id":' || event_id || ',"datetime":"' || CASE WHEN m = 9 THEN 'not-a-time' ELSE iso END
    || '","name":"' || event_type || '"}}' AS body FROM raw
),
rec AS (
  SELECT event_id, ts, event_type, m, iso,
    CASE WHEN m = 6 THEN {_with_text_behind('body', 'event_id // 20')} WHEN m = 8 THEN '{{' WHEN m = 7 THEN NULL
      ELSE body END AS rawdata,
    CASE WHEN m IN (0, 1, 8) THEN NULL WHEN m = 4 THEN 'Notification' WHEN m = 11 THEN 'Other'
      WHEN m = 12 THEN 'event' ELSE 'Event' END AS schema_name,
    CASE WHEN m IN (0, 1, 2, 3, 14) THEN NULL WHEN m IN (5, 8) THEN 2 WHEN m = 13 THEN 0 ELSE 1 END AS version
  FROM good
),
routed AS (
  SELECT *, CASE WHEN schema_name IS NULL THEN 'missing_schema' WHEN version IS NULL THEN 'missing_version'
    WHEN schema_name <> 'Event' THEN 'schema_mismatch' WHEN version > 1 THEN 'unsupported_version'
    WHEN m IN (6, 7, 8) THEN 'deserialize_error' WHEN m = 9 THEN 'required_null' ELSE 'ok' END AS route
  FROM rec
)"""

# The good records of two topics.
TYPES = """
typed AS (
  SELECT event_id AS id, ts AS datetime, event_type,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'Notification' ELSE 'Event' END AS schema_name,
    '{"id":' || event_id || ',"datetime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","name":"'
      || event_type || '"}' AS rawdata
  FROM events
)"""

HOURLY = """
hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS ts, sum(CAST(value AS DECIMAL(38, 12))) AS v FROM events GROUP BY ALL
),
runs AS (
  SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) // 200 AS run FROM hourly
),
s AS (
  SELECT 'events_value_total' AS metric, event_type AS series,
    epoch_us(ts) // 1000000 - 1704088800 AS t,
    (sum(v) OVER (PARTITION BY event_type, run ORDER BY ts))::DOUBLE AS v
  FROM runs
)"""

_OK = "SELECT event_id AS id, ts AS datetime, schema_name, rawdata FROM routed WHERE route = 'ok'"


def _range(name: str, over: str, window: int, step: int, last: str, source: str = "s", first: str = "0") -> str:
    """CTEs that end in ``name(metric, series, i, value)``; times are seconds from the grid start.

    ``i`` runs from 0 and stands for the time ``first + i * step``, up to ``last``.
    """
    return f"""
{name}_steps AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM {source} WINDOW w AS (PARTITION BY metric, series ORDER BY t)),
{name}_grid AS (SELECT unnest(range(0, (({last}) - ({first})) // {step} + 1)) AS i),
{name}_seen AS (
  SELECT x.*, g.i, ({first}) + g.i * {step} AS ev, CASE WHEN x.v < x.pv THEN x.pv ELSE 0 END AS fall
  FROM {name}_steps x JOIN {name}_grid g
    ON x.t <= ({first}) + g.i * {step} AND x.t > ({first}) + g.i * {step} - {window}
),
{name}_per AS (
  SELECT metric, series, i, ev, count(*) AS n, min(t) AS ft, max(t) AS lt, arg_min(v, t) AS fv, arg_max(v, t) AS lv,
    sum(fall) - arg_min(fall, t) AS falls, arg_max(coalesce(pt, -1e18), t) AS bt, arg_max(coalesce(pv, 0), t) AS bv
  FROM {name}_seen GROUP BY ALL
),
{name} AS ({_value(over, window, name)})"""


def _value(over: str, window: int, name: str) -> str:
    if over == "instant":
        return f"SELECT metric, series, i, ev, lv AS value FROM {name}_per"
    if over == "irate":
        return (
            f"SELECT metric, series, i, ev, (CASE WHEN lv < bv THEN lv ELSE lv - bv END) / (lt - bt) AS value "
            f"FROM {name}_per WHERE n >= 2"
        )
    falls = "0" if over == "delta" else "falls"
    zero = "FALSE" if over == "delta" else "inc > 0 AND fv >= 0"
    per = f" / {window}" if over == "rate" else ""
    return f"""
  SELECT metric, series, i, ev, inc * (si + CASE WHEN {zero} THEN least(ds, si * fv / inc) ELSE ds END + de) / si{per} AS value
  FROM (
    SELECT *, CASE WHEN start_gap >= 1.1 * gap THEN gap / 2 ELSE start_gap END AS ds,
      CASE WHEN end_gap >= 1.1 * gap THEN gap / 2 ELSE end_gap END AS de
    FROM (
      SELECT *, lv - fv + {falls} AS inc, lt - ft AS si, (lt - ft) / (n - 1) AS gap,
        ft - (ev - {window}) AS start_gap, ev - lt AS end_gap
      FROM {name}_per WHERE n >= 2
    )
  )"""


_SLOT = f"event_id % {fixtures.SLOTS}"
_CLOCK = f"event_id // {fixtures.SLOTS} * {fixtures.SCRAPE_SECONDS}"
_LAST = f"(SELECT max(event_id) // {fixtures.SLOTS} * {fixtures.SCRAPE_SECONDS} FROM events)"
_TS = f"make_timestamp(epoch_us(TIMESTAMP '{fixtures.SCRAPE_START}') + ev * 1000000)"


def _samples(metrics: list[str]) -> str:
    names = ", ".join(f"'{m}'" for m in metrics)
    return f"""
s AS (
  SELECT metric, {_SLOT} AS series, {_CLOCK} AS t,
    CASE WHEN metric LIKE '%\\_is\\_preferred' ESCAPE '\\' THEN event_id % 2
      ELSE (event_id // {fixtures.SLOTS}) % 200 * 500 + value END AS v
  FROM events, (SELECT unnest([{names}]) AS metric)
)"""


def _choice(values, index: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{index} % {len(values)} + 1]"


# Labels of the scraped series, by slot.
_PARTITION = "series // 5"
_POD = f"'my-cluster-kafka-' || {_PARTITION}"
_LABELS = {
    "exporter": {
        "consumergroup": "'group-' || (series % 5) % 2",
        "namespace": "'kafka'",
        "partition": f"({_PARTITION})::VARCHAR",
        "strimzi_io_cluster": "'my-cluster'",
        "topic": "'topic-' || series % 5",
    },
    "broker": {
        "container": "'kafka'",
        "kubernetes_pod_name": _POD,
        "listener": "CASE WHEN series % 5 < 2 THEN 'plain-9092' ELSE 'tls-9093' END",
        "namespace": "'kafka'",
        "partition": f"({_PARTITION})::VARCHAR",
        "persistentvolumeclaim": f"'data-0-' || {_POD}",
        "pod": _POD,
        "strimzi_io_cluster": "'my-cluster'",
        "strimzi_io_name": "'my-cluster-kafka'",
        "topic": "CASE WHEN series % 5 = 4 THEN '' ELSE 'topic-' || series % 5 END",
    },
    "operators": {
        "container": _choice(fixtures.OPERATOR_CONTAINERS, "series"),
        "kind": _choice(fixtures.RESOURCE_KINDS, "series"),
        "replica": "series::VARCHAR",
    },
}


def _filter(panel: panels.Panel) -> str:
    """Matchers with everything chosen, in SQL."""
    labels = _LABELS[panel.dashboard]
    out = [f"metric = '{panel.metric}'"]
    for m in panel.conditions({**panels.ALL_VALUES, **_CHOSEN}):
        have = labels.get(m.label, "''")
        if m.op in ("=", "!="):
            out.append(f"({have}) {m.op} '{m.value}'")
        else:
            out.append(f"regexp_full_match({have}, '{m.value}')")
    return " AND ".join(out)


_CHOSEN = {"kubernetes_namespace": "kafka", "strimzi_cluster_name": "my-cluster"}


def _shown(panel: panels.Panel) -> str:
    value = "value" if panel.below is None else f"(value < {panel.below})::DOUBLE"
    return value if panel.factor == 1.0 else f"{value} * {panel.factor!r}"


def _text(panel: panels.Panel) -> str:
    labels = _LABELS[panel.dashboard]
    if panel.agg == "none":
        pairs = [f"CASE WHEN ({v}) = '' THEN NULL ELSE '{k}=' || ({v}) END" for k, v in sorted(labels.items())]
        return f"concat_ws(',', {', '.join(pairs)})"
    if not panel.by:
        return "''"
    pairs = [f"'{n}=' || ({labels[n]})" for n in panel.by]
    return f"concat_ws(',', {', '.join(pairs)})"


def _legend(panel: panels.Panel) -> str:
    out = "'" + panel.legend + "'"
    for name, value in _LABELS[panel.dashboard].items():
        out = out.replace("{{" + name + "}}", f"' || ({value}) || '")
    return out


def _round(value: str) -> str:
    return f"round({value}, 6)"


def _sum(value: str) -> str:
    return f"sum(CAST({value} AS DECIMAL(38, 12)))::DOUBLE"


def _panel(number: int, step: int = 60) -> str:
    panel = panels.PANELS[number - 1]
    labels = _LABELS[panel.dashboard]
    agg = "count(value)::DOUBLE" if panel.agg == "count" else _sum(_shown(panel))
    if panel.agg == "none":
        kept, agg = [f"{_text(panel)} AS labels", f"{_legend(panel)} AS legend"], "value"
    else:
        kept = [f"{labels[n]} AS {n}" for n in panel.by]
    group = "" if panel.agg == "none" else " GROUP BY ALL"
    columns = ", ".join([*kept, f"{_TS} AS ts", f"{_round(agg)} AS value"])
    return (
        f"WITH {_samples([panel.metric])},{_range('r', panel.over, panel.window, step, _LAST)}\n"
        f"SELECT {columns} FROM r WHERE {_filter(panel)}{group}"
    )


def _dashboard(name: str) -> str:
    members = panels.dashboard(name)
    metrics = sorted({p.metric for _, p in members})
    calls = sorted({p.call for _, p in members})
    ctes = [_samples(metrics)]
    for over, window in calls:
        used = ", ".join(sorted({f"'{p.metric}'" for _, p in members if p.call == (over, window)}))
        ctes.append(f"\ns_{over}_{window} AS (SELECT * FROM s WHERE metric IN ({used}))")
        ctes.append(_range(f"r_{over}_{window}", over, window, 60, _LAST, f"s_{over}_{window}"))
    selects = []
    for number, panel in members:
        agg = "count(value)::DOUBLE" if panel.agg == "count" else _sum(_shown(panel))
        over, window = panel.call
        selects.append(
            f"SELECT {number} AS panel, {_text(panel)} AS labels, {_legend(panel)} AS legend, {_TS} AS ts, "
            f"{_round(agg)} AS value FROM r_{over}_{window} WHERE {_filter(panel)} GROUP BY ALL"
        )
    return "WITH " + ",".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


def _normalize() -> str:
    rules = (*BROKER_RULES, *REBALANCER_RULES)
    arms = "\n".join(f"  WHEN regexp_matches(bean, '{r.pattern}') THEN {n}" for n, r in enumerate(rules))

    def fill(template: str, pattern: str) -> str:
        out, rest = [], template
        while "$" in rest:
            before, _, rest = rest.partition("$")
            out += [f"'{before}'", f"regexp_extract(bean, '{pattern}', {rest[0]})"]
            rest = rest[1:]
        return " || ".join([*out, f"'{rest}'"])

    def safe(expression: str) -> str:
        return f"regexp_replace(regexp_replace({expression}, '[^a-zA-Z0-9:_]', '_', 'g'), '__+', '_', 'g')"

    def labels(rule) -> str:
        pairs = [(safe(fill(k, rule.pattern)), fill(v, rule.pattern)) for k, v in rule.labels.items()]
        items = [f"CASE WHEN ({k}) = '' OR ({v}) = '' THEN NULL ELSE ({k}) || '=' || ({v}) END" for k, v in pairs]
        return f"array_to_string(list_sort([x for x in [{', '.join(items)}]::VARCHAR[] if x IS NOT NULL]), ',')"

    def by_rule(build) -> str:
        return "CASE rule " + " ".join(f"WHEN {n} THEN {build(r)}" for n, r in enumerate(rules)) + " END"

    named = ", ".join(
        [
            "event_id",
            f"lower({safe(by_rule(lambda r: fill(r.name, r.pattern)))}) AS metric",
            f"{by_rule(lambda r: repr(r.kind))} AS kind",
            f"{by_rule(labels)} AS labels",
        ]
    )
    return f"""WITH beans AS ({_beans()}),
ruled AS (SELECT *, CASE
{arms}
  END AS rule FROM beans)
SELECT {named} FROM ruled WHERE rule IS NOT NULL"""


def _beans() -> str:
    def column(position: int) -> str:
        return f"[{', '.join(repr(b[position]) for b in fixtures.BEANS)}][event_id % {len(fixtures.BEANS)} + 1]"

    properties = (
        f"replace(replace(replace({column(1)}, '{{t}}', event_type), '{{p}}', (event_id % 3)::VARCHAR), "
        f"'{{n}}', (user_id % 7)::VARCHAR)"
    )
    return (
        f"SELECT event_id, {column(0)} || '<' || {properties} || '><' || {column(2)} || '>' || {column(3)} "
        f"|| ': ' || value AS bean FROM events"
    )


def _idle_beans() -> str:
    """One panel over the beans of the network processors; series differ in pod and kind."""
    panel, kind = panels.PANELS[43], _choice(fixtures.RESOURCE_KINDS, "event_id")
    bean = next(n for n, b in enumerate(fixtures.BEANS) if "name=NetworkProcessorAvgIdlePercent" in b[1])
    return f"""WITH s AS (
  SELECT '{panel.metric}' AS metric, user_id % 5 || {kind} AS series, {_CLOCK} AS t, value AS v FROM events
  WHERE event_id % {len(fixtures.BEANS)} = {bean} AND {kind} IN ('Kafka', 'KafkaConnect', 'KafkaMirrorMaker', 'KafkaMirrorMaker2')
),{_range('r', panel.over, panel.window, 60, _LAST)}
SELECT 'my-cluster-kafka-' || series[1] AS kubernetes_pod_name, {_TS} AS ts, {_round(_sum(_shown(panel)))} AS value
FROM r GROUP BY ALL"""


def _relabel() -> str:
    pod, kind = "(user_id % 5)", _choice(fixtures.RESOURCE_KINDS, "event_id")
    labels = {
        "__meta_kubernetes_namespace": "'kafka'",
        "__meta_kubernetes_pod_host_ip": f"'10.0.0.' || {pod}",
        "__meta_kubernetes_pod_label_app": "'web'",
        "__meta_kubernetes_pod_label_strimzi_io_cluster": "'my-cluster'",
        "__meta_kubernetes_pod_label_strimzi_io_kind": kind,
        "__meta_kubernetes_pod_name": f"'my-cluster-kafka-' || {pod}",
        "__meta_kubernetes_pod_node_name": f"'node-' || {pod}",
        "kubernetes_pod_name": f"'my-cluster-kafka-' || {pod}",
        "namespace": "'kafka'",
        "node_ip": f"'10.0.0.' || {pod}",
        "node_name": f"'node-' || {pod}",
        "strimzi_io_cluster": "'my-cluster'",
        "strimzi_io_kind": kind,
    }
    return "SELECT event_id, " + " || ',' || ".join(f"'{k}=' || {v}" for k, v in labels.items()) + " AS labels FROM events"


_NAMESPACE = "CASE WHEN user_id % 2 = 0 THEN 'kafka' ELSE 'shop' END"
_POD_KEY = f"'web-' || user_id % 7 || '_' || {_NAMESPACE}"
_STREAM = f"{_POD_KEY} || '_main-' || md5({_POD_KEY}) || md5({_POD_KEY})"
_LOG_BODY = """('{"id":"' || event_id || '","event":"' || event_type || '"}')"""
LOGS = f"""
logs AS (
  SELECT event_id, user_id, ts, '/var/log/containers/' || {_STREAM} || '.log' AS path,
    CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, event_type,
    CASE WHEN event_id % 11 = 0 THEN {_with_text_behind(_LOG_BODY, 'event_id // 11')} WHEN event_id % 4 = 0 THEN 'event ' || event_id || ' ' || event_type
      ELSE {_LOG_BODY} END AS log,
    event_id % 11 <> 0 AND event_id % 4 <> 0 AS is_json
  FROM events
)"""


def _label_values() -> str:
    out = []
    for variable in panels.VARIABLES:
        name = variable.label or {
            "kubernetes_namespace": "namespace",
            "strimzi_cluster_name": "strimzi_io_cluster",
            "kafka_broker": "kubernetes_pod_name",
            "kafka_topic": "topic",
            "kafka_partition": "partition",
        }[variable.name]
        value = _LABELS[variable.dashboard][name]
        if variable.name == "kafka_broker":
            value = f"replace({value}, 'my-cluster-', '')"
        topic = _LABELS[variable.dashboard]["topic"]
        # Partitions are listed for the chosen topics, which have names.
        kept = f" AND ({topic}) <> ''" if variable.name == "kafka_partition" else ""
        out.append(
            f"SELECT DISTINCT '{variable.dashboard}' AS dashboard, '{variable.name}' AS variable, {value} AS value "
            f"FROM (SELECT {_SLOT} AS series FROM events) WHERE ({value}) <> ''{kept}"
        )
    return " UNION ALL ".join(out)


ORACLES: dict[str, str] = {
    "route_counts": f"WITH {RECORDS} SELECT route, count(*) AS cnt FROM routed GROUP BY route",
    "header_lookup": f"WITH {RECORDS} SELECT event_id::VARCHAR AS key, schema_name AS proto_schema, version::INTEGER AS proto_version FROM rec",
    "decode_permissive": f"""WITH {RECORDS} SELECT event_id::VARCHAR AS key,
      CASE WHEN m NOT IN (6, 7, 8) THEN event_id END AS id,
      CASE WHEN m = 9 THEN 'not-a-time' WHEN m NOT IN (6, 7, 8) THEN iso END AS datetime,
      CASE WHEN m NOT IN (6, 7, 8) THEN event_type END AS name FROM rec""",
    "generated_records": """SELECT (event_id + 1)::VARCHAR AS key,
      '{"id":' || (event_id + 1) || ',"datetime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
        || '+00:00","name":"hello from producer #' || (event_id + 1) || '"}' AS value,
      'sample-events-event' AS topic, 'Event' AS proto_schema, '1' AS proto_version, 2::INTEGER AS headers,
      event_id AS "offset" FROM events""",
    "ingest_valid": f"WITH {RECORDS} {_OK}",
    "ingest_dlq": f"WITH {RECORDS} SELECT ts AS failed_at, schema_name, rawdata, route AS reason FROM routed WHERE route <> 'ok'",
    "required_null": f"WITH {RECORDS} SELECT ts AS failed_at, schema_name, rawdata FROM routed WHERE route = 'required_null'",
    "ingest_fanout": f"""WITH {RECORDS} SELECT CASE WHEN route = 'ok' THEN 'events' ELSE 'rejects' END AS sink, count(*) AS cnt,
      sum(strlen(rawdata))::BIGINT AS bytes FROM routed GROUP BY 1""",
    "ingest_totals": f"WITH {RECORDS} SELECT 'consumer-Event' AS query, route, count(*) AS cnt FROM routed GROUP BY route",
    "registry_fanout": f"WITH {TYPES} SELECT id, datetime, schema_name, rawdata FROM typed",
    "one_query_fails": f"""WITH {TYPES} SELECT 'consumer-' || n AS query, n = 'Notification' AS failed,
      CASE WHEN n = 'Event' THEN (SELECT count(*) FROM typed WHERE schema_name = 'Event') ELSE 0 END AS cnt
      FROM (SELECT unnest(['Event', 'Notification']) AS n)""",
    "resume_no_dup": f"WITH {RECORDS} {_OK}",
    "replay_idempotent": f"""WITH {RECORDS} SELECT CASE WHEN route = 'ok' THEN 'events' ELSE 'rejects' END AS sink,
      rawdata, ts AS at FROM routed""",
    "start_latest": f"WITH {RECORDS} {_OK} AND ts >= TIMESTAMP '2024-01-15'",
    "stream_dedup": "SELECT (event_id % 3)::INTEGER AS partition, event_id // 3 AS offset, event_id::VARCHAR AS key FROM events",
    "dlq_recent": f"""WITH {RECORDS} SELECT ts AS failed_at, strlen(rawdata)::INTEGER AS bytes, schema_name, route AS reason
      FROM routed WHERE route <> 'ok' AND ts > TIMESTAMP '2024-01-29'
      ORDER BY failed_at DESC, schema_name NULLS FIRST, reason, bytes NULLS FIRST LIMIT 100""",
    "counts_by_type": f"""WITH {TYPES} SELECT schema_name, count(*) FILTER (datetime > TIMESTAMP '2024-01-29') AS cnt
      FROM typed GROUP BY schema_name""",
    "dlq_by_reason": f"""WITH {RECORDS} SELECT schema_name, route AS reason, ts::DATE::VARCHAR AS failed_at_day, count(*) AS cnt
      FROM routed WHERE route <> 'ok' GROUP BY ALL""",
    "all_events_view": f"""WITH {TYPES} SELECT schema_name, datetime::DATE::VARCHAR AS datetime_day, count(*) AS cnt,
      min(id) AS first_id, max(id) AS last_id FROM typed GROUP BY ALL""",
    "dedup_events": f"WITH {RECORDS} {_OK}",
    "dlq_replay": f"""WITH {RECORDS} SELECT route AS was, CASE WHEN schema_name IS NULL THEN 'missing_schema'
      WHEN route IN ('missing_version', 'unsupported_version') THEN route WHEN schema_name <> 'Event' THEN 'schema_mismatch' WHEN m IN (6, 7, 8) THEN 'deserialize_error'
      WHEN m = 9 THEN 'required_null' ELSE 'ok' END AS reason, schema_name, rawdata,
      CASE WHEN m NOT IN (6, 7, 8) THEN event_id END AS id, CASE WHEN m NOT IN (6, 7, 8, 9) THEN ts END AS datetime
      FROM routed WHERE route <> 'ok'""",
    "partition_prune": f"""WITH {TYPES} SELECT id, datetime, schema_name, rawdata FROM typed
      WHERE schema_name = 'Event' AND datetime > TIMESTAMP '2024-01-20'""",
    "cow_upsert": f"""WITH {TYPES} SELECT id, datetime, schema_name, rawdata FROM typed WHERE event_type <> 'purchase'
      UNION ALL SELECT id, datetime + INTERVAL 1 DAY, 'Notification', 'changed' FROM typed
      WHERE event_type IN ('purchase', 'error')""",
    "cow_delete": f"""WITH {TYPES} SELECT id, datetime, schema_name, rawdata FROM typed
      WHERE NOT (datetime < TIMESTAMP '2024-01-03' OR hour(datetime) = 5)""",
    "cow_update": f"""WITH {TYPES} SELECT id,
      CASE WHEN hour(datetime) >= 18 THEN datetime + INTERVAL 12 HOUR ELSE datetime END AS datetime, schema_name,
      CASE WHEN hour(datetime) >= 18 THEN 'late' ELSE rawdata END AS rawdata
      FROM typed""",
    "consumer_lag": """WITH ends AS (SELECT (event_id % 3)::INTEGER AS partition, max(event_id // 3) + 1 AS log_end FROM events GROUP BY 1),
      done AS (SELECT (event_id % 3)::INTEGER AS partition, max(event_id // 3) + 1 AS committed FROM events
        WHERE event_id < (SELECT count(*) FROM events) / 2 GROUP BY 1)
      SELECT 'group-a' AS consumergroup, 'sample-events-event' AS topic, partition, log_end, committed,
        log_end - committed AS lag FROM ends JOIN done USING (partition)""",
    "metric_count": _panel(1),
    "metric_sum": _panel(2),
    "metric_bool": _panel(8),
    "metric_delta": _panel(10),
    "metric_sum_by": _panel(11),
    "metric_irate": _panel(33),
    "metric_percent": _panel(44),
    "metric_raw": _panel(49),
    "metric_increase": f"""WITH {HOURLY},{_range('r', 'increase', 21600, 21600, '2570400')}
      SELECT series AS event_type, make_timestamp((1704088800 + ev) * 1000000) AS ts, {_round('value')} AS value FROM r""",
    "metric_rate": f"""WITH {HOURLY},{_range('r', 'rate', 21600, 21600, '2570400')}
      SELECT series AS event_type, make_timestamp((1704088800 + ev) * 1000000) AS ts, {_round('value')} AS value FROM r""",
    "metric_range": f"""WITH {_samples(['kafka_topic_partition_current_offset'])},{_range('r', 'rate', 300, 15, _LAST, first=f'{_LAST} - 3600')}
      SELECT ({_LABELS['exporter']['topic']}) || ':' || ({_LABELS['exporter']['partition']}) AS name, {_TS} AS ts,
        {_round('value')} AS value FROM r""",
    "label_match": f"""WITH {_samples(['kafka_consumergroup_lag'])} SELECT 'topic-' || series % 5 AS topic, (series // 5)::VARCHAR AS partition,
      make_timestamp(epoch_us(TIMESTAMP '{fixtures.SCRAPE_START}') + t * 1000000) AS ts, {_round('v')} AS value FROM s
      WHERE series % 5 <= 2 AND (series % 5) % 2 = 1 AND series // 5 <> 2""",
    "label_values": _label_values(),
    "metric_scan": f"""SELECT * FROM (SELECT {_choice(fixtures.RESOURCE_KINDS, 'event_id')} AS kind, 'my-cluster-kafka-' || user_id % 5 AS pod,
      ts, {_round('value')} AS value FROM events)
      WHERE kind IN ('Kafka', 'KafkaConnect', 'KafkaMirrorMaker', 'KafkaMirrorMaker2')
      AND ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-25'""",
    "offset_table": f"""WITH {_samples(['kafka_consumergroup_current_offset'])},{_range('r', 'instant', 300, 1, _LAST, first=_LAST)}
      SELECT {_TS} AS ts, {_LABELS['exporter']['consumergroup']} AS consumergroup, {_LABELS['exporter']['partition']} AS partition,
        {_LABELS['exporter']['topic']} AS topic, {_round(_sum('value'))} AS value FROM r GROUP BY ALL
      ORDER BY topic DESC, ts, consumergroup, partition, value LIMIT 10""",
    "dashboard_exporter": _dashboard("exporter"),
    "dashboard_broker": _dashboard("broker"),
    "dashboard_operators": _dashboard("operators"),
    "metric_pipeline": _idle_beans(),
    "jmx_normalize": _normalize(),
    "relabel": _relabel(),
    "log_lines": f"WITH {LOGS} SELECT ts, stream, FALSE AS partial, log FROM logs",
    "log_multiline": """SELECT '/var/log/containers/' || source || '.log' AS path,
      CASE WHEN doc_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, make_timestamp(doc_id * 1000000) AS ts,
      unnest(string_split(text, chr(10))) AS log, TRUE AS complete FROM documents""",
    "log_merge": f"""WITH {LOGS} SELECT event_id, CASE WHEN NOT is_json THEN log END AS log,
      CASE WHEN is_json THEN event_id::VARCHAR END AS id, CASE WHEN is_json THEN event_type END AS event FROM logs""",
    "log_enriched": f"""SELECT event_id, {_NAMESPACE} AS namespace, 'web-' || user_id % 7 AS pod_name, 'main' AS container,
      CASE WHEN user_id % 7 <> 6 THEN 'node-' || (user_id % 7) % 3 END AS node_name,
      CASE WHEN user_id % 7 < 3 THEN 'front' WHEN user_id % 7 <> 6 THEN 'back' END AS app FROM events""",
    "log_streams": f"""SELECT {_NAMESPACE} AS namespace, 'web-' || user_id % 7 AS pod_name, 'logs-' || {_STREAM} AS log_stream,
      count(*) AS cnt FROM events GROUP BY ALL""",
    "log_pipeline": f"""WITH {LOGS} SELECT ts, stream, {_NAMESPACE} AS namespace, 'web-' || user_id % 7 AS pod_name,
      'logs-' || {_STREAM} AS log_stream, CASE WHEN user_id % 7 <> 6 THEN 'node-' || (user_id % 7) % 3 END AS node_name,
      CASE WHEN user_id % 7 < 3 THEN 'front' WHEN user_id % 7 <> 6 THEN 'back' END AS app,
      CASE WHEN NOT is_json THEN log END AS log, CASE WHEN is_json THEN event_id::VARCHAR END AS id,
      CASE WHEN is_json THEN event_type END AS event, TRUE AS complete FROM logs""",
    "log_tail": f"""WITH {LOGS},
      cut AS (SELECT event_id, ts, stream, regexp_extract_all(log, '(?s).{{1,16}}') AS pieces FROM logs),
      pieces AS (SELECT *, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS n FROM cut),
      third AS (SELECT (count(*) + 2) // 3 AS size FROM events)
      SELECT CASE WHEN event_id < size THEN 'first' WHEN event_id < 2 * size THEN 'grown' ELSE 'moved' END AS run,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || stream || CASE WHEN n < len(pieces) THEN ' P ' ELSE ' F ' END || piece AS value
      FROM pieces, third""",
    "log_latest_streams": f"""WITH {LOGS} SELECT path, max(ts) AS last_event FROM logs GROUP BY path
      ORDER BY last_event DESC, path LIMIT 5""",
    "log_recent": f"""WITH {LOGS} SELECT ts, path, log FROM logs WHERE ts >= TIMESTAMP '2024-01-19 23:55:00'
      ORDER BY ts, path, log LIMIT 5""",
}
