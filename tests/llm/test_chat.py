import random

from hypothesis import given
from hypothesis import strategies as st

from cohortloom.llm import chat

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string"


def fold(events):
    turns = {}
    rank = {k: i for i, k in enumerate(chat.KINDS)}
    for c, t, s, k, r, x in sorted(set(events), key=lambda e: (e[2], rank[e[3]], e[5] or "")):
        role, text = turns.get((c, t), (None, ""))
        text = text + (x or "") if k == "delta" else (x or "")
        turns[c, t] = (r if r is not None else role, text)
    return turns


def test_fold_against_a_loop(spark):
    rng = random.Random(3)
    events = []
    for seq in range(400):
        kind = rng.choices(chat.KINDS, [2, 1, 1, 8])[0]
        events.append((rng.randint(0, 4), rng.randint(0, 3), seq, kind, rng.choice(["user", "assistant", None]),
                       rng.choice([None, "", "a", "b<", "\\c"])))
    events += events[:50]
    rng.shuffle(events)
    found = chat.fold_events(spark.createDataFrame(events, SCHEMA)).collect()
    assert {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in found} == fold(events)


def test_round_trip_and_loss_mask(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST]", " [/INST]", "<<x>>", "\\", "\\\\", "<", ">", "\n", "é", "日", "ok", " ", ""]
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "a>b\\", "", None]),
         rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 8)))]))
        for c in range(40) for t in range(rng.randint(1, 6))
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.render(frame).collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [(role, text) for role, text, _ in chat.parse(r["formatted"])] == own
        masked = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert masked == [text for role, text in own if role == "assistant"]
        assert r["n_turns"] == len(own)


@given(st.text(alphabet="\\<>[]/sINT \n"))
def test_parse_is_the_inverse_for_any_text(text):
    escaped = "".join("\\" + c if c in "\\<>[" else c for c in text)
    whole = f"[INST] {escaped} [/INST]{escaped}</s><<r>>{escaped}<</r>>"
    assert [(r, t) for r, t, _ in chat.parse(whole)] == [("user", text), ("assistant", text), ("r", text)]


def test_odd_logs(spark):
    rows = [
        (None, 0, 1, "message", "user", "null conversation"),
        (1, 0, None, "message", "user", "no number"),
        (1, None, 1, "message", "user", "no turn"),
        (1, 0, 1, "other", "user", "unknown kind"),
        (2, 0, 5, "delta", "user", "only a delta"),
        (2, 0, 5, "delta", "user", "only a delta"),
    ]
    found = {r["conv_id"]: r["formatted"] for r in chat.format_log(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {
        None: "[INST] null conversation [/INST]",
        2: "[INST] only a delta [/INST]",
    }
    assert chat.format_log(spark.createDataFrame([], SCHEMA)).count() == 0
