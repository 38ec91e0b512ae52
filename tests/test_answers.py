"""Requests that are sent once: a worker that dies, a second run, failures of the transport."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.operators import answers, extraction


def asker(folder, kill_at=None):
    """A model that notes each call in a file of its own process; it kills its worker once, at one body."""

    def ask(kind, body, most):
        with open(f"{folder}/calls-{os.getpid()}", "a") as f:
            f.write(f"{body}\n")
        if kill_at and body == kill_at and not os.path.exists(f"{folder}/killed"):
            open(f"{folder}/killed", "w").close()
            os._exit(1)
        first = not os.path.exists(f"{folder}/first-{body}")
        open(f"{folder}/first-{body}", "w").close()
        if body == "never" or (body == "later" and first):
            raise ConnectionError("no network")
        return "end", f"{kind} {most} {body}"

    return ask


def calls(folder):
    return Counter(line for p in os.listdir(folder) if p.startswith("calls-") for line in open(f"{folder}/{p}").read().split("\n")[:-1])


def requests(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    return df.withColumn("digest", answers.digest_of("accounts", 9, F.col("body")))


def test_a_lost_task_sends_only_its_own_again(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "answers")
    os.mkdir(folder)
    bodies = [f"r{i}" for i in range(60)]
    r, ask = requests(spark, bodies + bodies[:20]), asker(folder, "r37")
    with pytest.raises(Exception, match="(?i)worker|aborted"):
        answers.send(r, ask, "accounts", 9, path, per_task=2)
    first, done = calls(folder), {x.digest for x in answers.stored(spark, path).collect()}
    assert first["r37"] == 1 and done
    got = answers.send(r, ask, "accounts", 9, path, per_task=2)
    assert got.count() == 60 and {x.answer for x in got.collect()} == {f"accounts 9 {b}" for b in bodies}
    second = calls(folder)
    again = {b for b in bodies if second[b] > 1}
    digests = {x.body: x.digest for x in r.distinct().collect()}
    assert "r37" in again and not [b for b in again if digests[b] in done] and max(second.values()) == 2
    assert len(again) <= 8 * 2  # tasks that ran at the time, two requests each
    answers.send(r, ask, "accounts", 9, path, per_task=2).count()
    assert calls(folder) == second  # a further run sends nothing


def test_failures_are_tried_up_to_a_bound(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "answers")
    os.mkdir(folder)
    o = extraction.Options(asker(folder), answers=path, tries=3)
    r = spark.createDataFrame([(i, b) for i, b in enumerate(("never", "later", "fine", "fine", None))], "id int, body string")
    got = {x.id: x.error for x in extraction.asked(r, "accounts", 9, o).collect()}
    assert got == {0: "ConnectionError: no network", **dict.fromkeys((1, 2, 3), "the answer is not readable"), 4: got[4]}
    assert calls(folder)["never"] == 3 and calls(folder)["later"] == 2 and calls(folder)["fine"] == 1
    extraction.asked(r, "accounts", 9, o).collect()
    assert calls(folder)["never"] == 3
    # Another bound on the answer is another request.
    extraction.asked(r.where("id = 2"), "accounts", 10, o).collect()
    assert calls(folder)["fine"] == 2


def test_no_requests(spark, tmp_path):
    assert answers.send(requests(spark, []), asker(str(tmp_path)), "accounts", 9, str(tmp_path / "answers")).collect() == []


def test_the_schema_goes_with_a_request(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def ask(kind, body, most, schema):
        with open(seen, "a") as f:
            f.write("x")
        return "end", json.dumps({kind: [{n: 1 if p["type"] == "integer" else "" for n, p in schema["properties"][kind]["items"]["properties"].items()}]})

    r = spark.createDataFrame([("b",)], "body string")
    o = extraction.Options(ask, answers=str(tmp_path / "answers"), schema=True)
    assert extraction.asked(r, "transactions", 9, o).head().found[0].source_row == 1
    assert extraction.asked(r, "transactions", 9, extraction.Options(ask, schema=True)).head().found[0].source_row == 1
    assert os.path.getsize(seen) == 2
    # The same body without a schema is another request.
    extraction.asked(r, "transactions", 9, extraction.Options(asker(str(tmp_path)), answers=str(tmp_path / "answers"))).collect()
    assert sum(calls(str(tmp_path)).values()) == 1
    accounts = extraction.answer_schema("accounts")
    one = accounts["properties"]["accounts"]["items"]
    assert accounts["required"] == ["accounts"] and one["additionalProperties"] is False and one["properties"]["layout"] == {"type": "string", "enum": ["row", "block"]}
    assert one["required"] == list(one["properties"]) and one["properties"]["columns"]["properties"]["debit"] == {"type": "integer"}
    assert extraction.answer_schema("transactions")["properties"]["transactions"]["items"]["properties"]["debit_amount"] == {"type": "string"}
