"""Sources, sinks and the streaming pacer."""

import datetime as dt

from pyspark.sql import functions as F

from lexforge.sources import io
from lexforge.streaming import pacing


def test_settings(spark, tmp_path):
    (tmp_path / "env").write_text("# c\n\nA=1\nB = 'x=y'\nnothing\nA=2\n")
    assert {r.key: r.value for r in io.settings(spark, str(tmp_path / "env")).collect()} == {"A": "1", "B": "x=y"}


def test_model_rows(spark):
    def model(system, user):
        if user == "bad":
            raise ValueError("no")
        return user.upper()

    df = spark.createDataFrame([(1, "s", "hi"), (2, "s", "bad"), (3, None, None)], "request_id int, system string, user string")
    got = {r.request_id: (r.text, r.ok, r.error) for r in io.call_model(df, model=model).collect()}
    assert got == {1: ("HI", True, None), 2: (None, False, "ValueError: no"), 3: ("", True, None)}


def test_model_errors_by_code(spark):
    from lexforge import HttpError

    class Model:
        """Fails once for each user by the code that its name gives."""

        def __init__(self):
            self.seen = set()

        def __call__(self, system, user):
            if user.isdigit() and user not in self.seen:
                self.seen.add(user)
                raise HttpError(int(user), "why", 0.0)
            return "ok " + user

    def plain(system, user):
        return "plain " + user

    df = spark.createDataFrame([(i, "", u) for i, u in enumerate(("400", "429", "401", "500", "x"))], "request_id int, system string, user string").coalesce(1)
    got = {r.request_id: (r.text, r.error) for r in io.call_model(df, model=Model(), plain=plain, wait=lambda s: None).collect()}
    assert got == {0: ("plain 400", None), 1: ("ok 429", None), 2: (None, "HttpError: HTTP 401: why"), 3: ("ok 500", None), 4: ("ok x", None)}
    shown = io.models(spark, lambda: [{"id": "b", "owned_by": "o"}, {"id": "a"}, "junk"])
    assert tuple(io.health(shown, "a").first()) == (True, "a", True, 2, ["a", "b"])
    assert tuple(io.health(shown.limit(0), "a").first()) == (True, "a", False, 0, [])


def test_summary_and_command_line(spark, capsys):
    from lexforge.__main__ import main

    lines = io.summary(spark.createDataFrame([(1, None), (2, "x")], "n int, long_name string"), "totals", 20)
    assert lines == ["=" * 20, "TOTALS", "=" * 20, "n:         1", "long_name: ", "-" * 20, "n:         2", "long_name: x", "=" * 20]
    assert main(["--list"]) == 0 and "run_totals" in capsys.readouterr().out
    assert main(["schema_critical", "/root/testdata/sf0.001", "--rows", "3"]) == 0 and "critical:" in capsys.readouterr().out


def test_errors(spark):
    import pytest

    from lexforge import LexforgeError, RetentionError, require_retention

    df = spark.createDataFrame([(0.9,), (None,)], "retention double")
    assert require_retention(df.where("retention > 0"), 0.88).count() == 1
    with pytest.raises(RetentionError, match="1 rows retain less"):
        require_retention(df, 0.88)
    assert issubclass(RetentionError, LexforgeError)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", ["x", "y"])], "id int, t string, l array<string>")
    io.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", "a b", "x|y")]
    io.append_jsonl(df, str(tmp_path / "log"))
    io.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("timestamp is not null").count() == 2
    assert io.markdown(df.select("id"), "T").first().value == "# T\n\n- id: `1`\n"
    assert '"id" : 1' in io.pretty_json(df.select("id")).first().value


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(u, i, base + dt.timedelta(seconds=3 * i + u), 500 + 100 * (i % 7)) for u in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp, tokens int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.tenant, r.event_id): r.sleep for r in pacing.pace(df, "user_id", "ts", "tokens", "event_id").collect()}
    assert max(batch.values()) > 0
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = pacing.pace_stream(stream, "user_id", "ts", "tokens", "event_id").writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.tenant, r.event_id): r.sleep for r in spark.table("paced").collect()}
    assert got == batch


def test_rolling_window_edges(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, base + dt.timedelta(seconds=s), 1) for i, s in enumerate((0, 59, 60, 120))], "t int, e int, ts timestamp, n int")
    got = {r.e: r.tokens_60s for r in pacing.rolling(df, "t", "ts", "n", "e").select("e", "tokens_60s").collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 1}  # an event of exactly 60 s has left


def test_flat_keeps_numbers(spark):
    df = spark.createDataFrame([(1.5, {"a": 1})], "x double, m map<string,int>")
    assert dict(io.flat(df).dtypes)["x"] == "double" and io.flat(df).select(F.col("m")).first().m == '{"a":1}'
