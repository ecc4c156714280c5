"""Conversation state of a stream against a replay of what it has read."""

import json
import random

from quirework.streaming import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def summariser():
    def summarise(summary, messages):
        return summary + "".join(f"[{t}{r}{x}]" for t, r, x in messages)

    return summarise


def test_rules():
    summarise = summariser()
    state = C.Conversation()
    for k in (0, 2, 1, 1, 3, 4):
        state.add((k, "u", f"t{k}"), summarise, 4, 2)
    assert state.summary == "[0ut0][1ut1][2ut2]" and state.covered == 3 and [t for t, _, _ in state.rest] == [3, 4]
    state.add((1, "u", "late"), summarise, 4, 2)
    state.add((5, "u", "t5"), summarise, 4, 2)
    assert state.covered == 4 and [t for t, _, _ in state.rest] == [4, 5] and "late" not in state.summary


def test_stream_equals_replay_over_restarts(spark, tmp_path):
    rng, summarise = random.Random(2), summariser()
    rows = [(c, t, "user" if t % 2 else None, rng.choice(["a", "b", None, "é"])) for c in range(12) for t in range(rng.choice([1, 4, 9, 30]))] + [(None, 1, "u", "x"), (3, None, "u", "x")]
    rows = sorted(rows, key=lambda r: (r[1] or 0, rng.random()))
    cut = [rows[: len(rows) // 3], rows[len(rows) // 3 - 7 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]  # the second batch repeats some of the first
    folder = tmp_path / "in"
    folder.mkdir()
    found = {}

    def batch(df, _):
        for r in df.collect():
            found[r.conv_id] = r

    for n, part in enumerate(cut):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "role", "text"), r))) for r in part))
        # each round is a query of its own that goes on from the checkpoint
        stream = C.followed(spark.readStream.schema(SCHEMA).json(str(folder)), summarise, threshold=5, keep=2)
        stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        seen = spark.createDataFrame(sum(cut[: n + 1], []), SCHEMA)
        want = {r.conv_id: r for r in C.replayed(seen.repartition(3), summarise, threshold=5, keep=2).collect()}
        assert found == want and len(want) > 5
    assert any(r.summary_message_count == 28 for r in want.values()) and all(len(r.recent) <= 5 for r in want.values())
    assert C.replayed(spark.createDataFrame([], SCHEMA), summarise).collect() == []
