import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewire.functions import codec, containers, headers, labels, routing
from tidewire.registry import StreamSpec, sample_registry, validate
from tidewire.sources.records import HEADERS_TYPE, RECORD_SCHEMA
from tidewire.streaming import ingest

SPEC = StreamSpec("Event", "t", "/x", "/c", message="sample.Event")


def header_frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], f"headers {HEADERS_TYPE.simpleString()}")


def test_first_header_wins_and_absent_ones_are_null(spark):
    rows = [
        [Row(key="a", value=b"1"), Row(key="a", value=b"2")],
        [Row(key="A", value=b"1")],
        [],
        None,
        [Row(key="a", value=None), Row(key="a", value=b"9")],
        [Row(key="a", value=b"v1")],
        [Row(key="a", value=b"")],
        [Row(key="a", value=b"-3")],
        [Row(key="a", value=b"1.9")],
    ]
    df = header_frame(spark, rows)
    out = df.select(headers.header_text("headers", "a").alias("t"), headers.header_int("headers", "a").alias("i")).collect()
    assert [tuple(r) for r in out] == [
        ("1", 1), (None, None), (None, None), (None, None), (None, None), ("v1", None), ("", None), ("-3", -3), ("1.9", None),
    ]


@pytest.mark.parametrize(
    "value, fields",
    [
        (b'{"id":1,"datetime":"d","name":"n"}', (1, "d", "n")),
        (b'{"id":1}', (1, None, None)),
        (b'{"id":"x"}', None),
        (b'{"id":1', None),
        (b"{", None),
        (b"", None),
        (b"[1]", None),
        (b'{"id":1}] trailing', None),
        (b'{"id":1}],[{"id":2}', None),
        (b'{"id":1}} trailing', None),
        (b'{"id":1},"w":{"id":2}', None),
        (b' {"id":1}\n', (1, None, None)),
        (b"\xff\xfe", None),
        (None, None),
    ],
)
def test_json_decode_never_fails(spark, value, fields):
    df = spark.createDataFrame([(value,)], "payload binary")
    row = codec.JsonCodec().decode(df, "payload", SPEC).first()
    assert (None if row.payload is None else tuple(row.payload)) == fields


def test_protobuf_options_keep_zero_values():
    assert codec.ProtobufCodec(b"").options() == {"mode": "PERMISSIVE", "emit.default.values": "true"}


def one_record(spark, schema=b"Event", version=b"1", value=b'{"id":1,"datetime":"2024-01-01T00:00:00Z"}'):
    pairs = [Row(key=k, value=v) for k, v in (("proto-schema", schema), ("proto-version", version)) if v is not None]
    return spark.createDataFrame([(b"k", value, pairs, "t", 0, 0, None)], RECORD_SCHEMA)


@pytest.mark.parametrize(
    "changes, route",
    [
        ({}, "ok"),
        ({"schema": None, "version": None, "value": b"{"}, "missing_schema"),
        ({"version": None, "schema": b"Other"}, "missing_version"),
        ({"version": b"9", "schema": b"Other"}, "schema_mismatch"),
        ({"version": b"9", "value": b"{"}, "unsupported_version"),
        ({"value": b"{"}, "deserialize_error"),
        ({"value": None}, "deserialize_error"),
        ({"value": b'{"id":1,"datetime":"soon"}'}, "required_null"),
        ({"value": b'{"datetime":"2024-01-01T00:00:00Z"}'}, "required_null"),
        ({"schema": b""}, "schema_mismatch"),
        ({"schema": b"event"}, "schema_mismatch"),
        ({"schema": b"\xff\xfe"}, "schema_mismatch"),
        ({"version": b"0"}, "ok"),
        ({"version": b"-1"}, "ok"),
    ],
)
def test_first_broken_rule_names_the_route(spark, changes, route):
    spec = StreamSpec("Event", "t", "/x", "/c")
    assert ingest.route(ingest.parse(one_record(spark, **changes), spec), spec).first()["route"] == route


def test_reasons_are_fixed():
    assert routing.REASONS == (
        "missing_schema", "missing_version", "schema_mismatch", "unsupported_version", "deserialize_error", "required_null",
    )


def label_frame(spark, *maps):
    return spark.createDataFrame([(m,) for m in maps], "labels map<string,string>")


@pytest.mark.parametrize(
    "op, value, expected",
    [
        ("=", "x", [True, False, False]),
        ("!=", "x", [False, True, True]),
        ("=~", "x|y", [True, True, False]),
        ("=~", "x", [True, False, False]),
        ("=~", ".*", [True, True, True]),
        ("=~", ".+", [True, True, False]),
        ("!~", "x", [False, True, True]),
        ("=", "", [False, False, True]),
    ],
)
def test_matchers(spark, op, value, expected):
    df = label_frame(spark, {"a": "x"}, {"a": "y"}, {"b": "x"})
    hit = labels.Matcher("a", op, value).condition()
    assert [r[0] for r in df.select(hit).collect()] == expected


def test_alternatives_match_the_whole_value(spark):
    df = label_frame(spark, {"a": "xz"}, {"a": "zy"})
    assert [r[0] for r in df.select(labels.Matcher("a", "=~", "x|y").condition()).collect()] == [False, False]


def test_unknown_matcher():
    with pytest.raises(ValueError):
        labels.Matcher("a", "~", "x")


def test_labelmap_copies_and_overwrites(spark):
    df = label_frame(spark, {"p_k_a": "1", "p_b": "2", "k_a": "old", "p_k_": "3"})
    out = df.select(labels.labelmap("p_", keep="k_")).first()[0]
    assert out == {"p_k_a": "1", "p_b": "2", "k_a": "1", "p_k_": "3"}


def test_replace_labels(spark):
    df = label_frame(spark, {"s": "new", "t": "old", "u": "stays"}, {"t": "old"}, {"s": "", "t": "old"})
    out = [r[0] for r in df.select(labels.replace_labels({"s": "t"})).collect()]
    assert out == [{"s": "new", "t": "new", "u": "stays"}, {}, {"s": ""}]
    with pytest.raises(ValueError):
        labels.replace_labels({"a": "b", "b": "c"})


def test_legend_and_label_text(spark):
    df = label_frame(spark, {"b": "2", "a": "1"})
    row = df.select(labels.legend("{{a}} (b: {{b}}, {{c}})"), labels.label_text(), labels.label_text(["b", "c"])).first()
    assert tuple(row) == ("1 (b: 2, )", "a=1,b=2", "b=2,c=")


@pytest.mark.parametrize(
    "line, expected",
    [
        ("2024-01-01T00:00:07.5Z stdout F hello  world", ("stdout", False, "hello  world")),
        ("2024-01-01T00:00:07Z stderr P abc", ("stderr", True, "abc")),
        ("2024-01-01T00:00:07Z stdout F ", ("stdout", False, "")),
        ("2024-01-01T00:00:07Z stdout F", ("stdout", False, "")),
        ("2024-01-01T00:00:07Z stdout P:x a", ("stdout", True, "a")),
        ('{"log":"hi\\n","stream":"stderr","time":"2024-01-01T00:00:07.1Z"}', ("stderr", False, "hi")),
        ('{"log":"part","stream":"stdout","time":"2024-01-01T00:00:07.1Z"}', ("stdout", True, "part")),
        ("no log line", None),
        ("{}", None),
    ],
)
def test_container_lines(spark, line, expected):
    row = spark.createDataFrame([(line,)], "value string").select(containers.parse_line(F.col("value")).alias("x")).first()
    assert (None if row.x is None else (row.x.stream, row.x.partial, row.x.log)) == expected


def test_log_file_names(spark):
    key = "0123456789abcdef" * 4
    rows = [(f"/var/log/containers/web-1_shop_my-app-{key}.log",), ("/var/log/syslog",)]
    out = spark.createDataFrame(rows, "path string").select(*containers.pod_of(F.col("path"))).collect()
    assert [tuple(r) for r in out] == [("shop", "web-1", "my-app"), (None, None, None)]


def test_registry_is_validated():
    good = sample_registry("/t", "/c", ("sample-events-event", "sample-events-notification"))
    assert [s.query_name for s in good] == ["consumer-Event", "consumer-Notification"]
    with pytest.raises(ValueError, match="topic"):
        validate([good[0], StreamSpec("B", good[0].topic, "/b", "/cb")])
    with pytest.raises(ValueError, match="checkpoint"):
        validate([good[0], StreamSpec("B", "b", "/b", good[0].checkpoint + "/")])
    with pytest.raises(ValueError, match="inside"):
        validate([good[0], StreamSpec("B", "b", "/b", good[0].checkpoint + "/b")])
    with pytest.raises(ValueError):
        validate([])
    with pytest.raises(ValueError):
        validate([StreamSpec("a/b", "t", "/x", "/c")])
