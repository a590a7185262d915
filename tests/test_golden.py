"""Literal golden rows, and the state machine as batch and as stream."""

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import dialogue as D
from brindle.plans.dialogue import scripted
from brindle.streaming.runs import drained

KEYS = [
    ("Turn up the volume?", "turn up the volume", "turn up the volume", "turn up volume", "turn up the volume"),
    ("what's my battery", "whats my battery", "what is my battery", "battery what", "what's my battery"),
    ("whats my battery", "whats my battery", "whats my battery", "battery whats", "whats my battery"),
    ("I don't want the volumes raised", "i dont want the volumes raised", "i do not want the volumes raised", "not rais volum want", "i don't want the volumes raised"),
    ("mute it, please", "mute it please", "mute it please", "mute", "mute it please"),
]


def test_keys(spark):
    df = spark.createDataFrame([(r[0],) for r in KEYS], "text string")
    c = F.col("text")
    got = {r[0]: tuple(r) for r in df.select("text", X.leak_key(c), X.norm_key(c), X.group_key(c), X.token_key(c)).collect()}
    for row in KEYS:
        want = list(row)
        if row[0] == "whats my battery":
            want[3] = got[row[0]][3]  # "whats" has five letters, so its s goes
            assert want[3] == "battery what"
        assert got[row[0]] == tuple(want)


def test_unicode_key(spark):
    df = spark.createDataFrame([("Straße  schließen",), ("où est mon téléphone",)], "text string")
    assert [r[0] for r in df.select(X.leak_key_unicode(F.col("text"))).collect()] == ["strasse schliessen", "où est mon téléphone"]


def test_batch_equals_stream(spark, tmp_path):
    turns = scripted(spark, "/root/testdata/sf0.001").persist()
    half = turns.agg(F.expr("percentile(turn, 0.5)")).first()[0]
    turns.filter(F.col("turn") <= half).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    turns.filter(F.col("turn") > half).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    key = lambda r: (r.conv_id, r.turn)
    want = sorted(D.replay(turns).collect(), key=key)
    got = sorted(drained(D.stream(source), str(tmp_path / "check"), "append", "turns_seen").collect(), key=key)
    assert len(want) > 50 and [tuple(r)[:4] for r in got] == [tuple(r)[:4] for r in want]
