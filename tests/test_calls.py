import json
import time

from loomseries.operators import calls


def test_answers_and_recovery(spark):
    def make():
        def call(value, attempt):
            if value is None or value == "never":
                raise ValueError("no answer")
            if value == "late" and attempt < 2:
                raise TimeoutError
            if value == "half":
                return json.dumps({"attempt": attempt}) if attempt < 2 else "not JSON"
            return '```json\n{"ok": true, "of": "' + value + '"}\n```'

        return call

    rows = [(i, v) for i, v in enumerate(["a", "late", "half", "never", None])]
    df = spark.createDataFrame(rows, "id long, v string").repartition(2)
    out = calls.call_json(df, "v", make(), lambda x: bool(x.get("ok")), "r", first_wait=0.0)
    assert out.columns == ["id", "v", "r", "r_state", "r_calls"]
    got = {r.id: (r.r and json.loads(r.r), r.r_state, r.r_calls) for r in out.collect()}
    assert got == {
        0: ({"ok": True, "of": "a"}, "ok", 1), 1: ({"ok": True, "of": "late"}, "ok", 3),
        2: ({"attempt": 1}, "partial", 3), 3: (None, "failed", 3), 4: (None, "failed", 3)}


def test_calls_run_side_by_side_at_a_pace(spark):
    def make(seconds):
        def call(value, attempt):
            time.sleep(seconds)
            return "1"

        return call

    df = spark.range(16).selectExpr("cast(id as string) as v").coalesce(1)
    calls.call_json(df.limit(1), "v", make(0), lambda x: True, "r").collect()
    start = time.monotonic()
    assert calls.call_json(df, "v", make(0.5), lambda x: True, "r", at_once=16).filter("r_state = 'ok'").count() == 16
    assert time.monotonic() - start < 7
    pace, start = calls.Pace(20), time.monotonic()
    for _ in range(5):
        pace.wait()
    assert time.monotonic() - start >= 0.19
