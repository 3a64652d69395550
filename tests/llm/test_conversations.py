from datetime import datetime

from sparkloom.llm.conversations import follow_paths, ordered_conversations, thread_conversations

MESSAGES = "message_id long, conversation_id long, role string, content string, turn_group string, version int, created_at long, ingested_at timestamp, position int"
CONVERSATIONS = "conversation_id long, title string"
NOW = datetime(2024, 1, 1)


def msg(i, conv, role, content="words", at=None, group=None, version=1, ingested=NOW):
    return (i, conv, role, content, group, version, 1_700_000_000 + i if at is None else at, ingested, 0)


def verdicts(spark, messages, conversations, **kw):
    m = spark.createDataFrame(messages, MESSAGES)
    c = spark.createDataFrame([(x, None) for x in conversations], CONVERSATIONS)
    return {r.conversation_id: r.reason for r in thread_conversations(m, c, **kw)[1].collect()}


def test_reasons(spark):
    rows = [
        msg(1, 1, "user"), msg(2, 1, "assistant"), msg(3, 1, "ai"),
        msg(4, 2, "Human "), msg(5, 2, "bot"), msg(6, 2, "user"),
        msg(7, 3, "assistant"), msg(8, 3, "user"), msg(9, 3, "assistant"),
        msg(10, 4, "user"), msg(11, 4, "?"), msg(12, 4, "assistant"),
        msg(13, 5, "user", "  "), msg(14, 5, "assistant", "[stream interrupted]"),
        msg(15, 6, "user"), msg(16, 6, "assistant"),
        msg(17, 7, "system"), msg(18, 7, "tool"),
        msg(19, 8, "user"), msg(20, 8, "system"), msg(21, 8, "assistant"),
        msg(22, 10, "user"), msg(23, 10, "assistant", "Error: 503 upstream unavailable (req 9f)"),
        msg(24, None, "user"),
    ]
    got = verdicts(spark, rows, [1, 2, 3, 4, 5, 7, 8, 9, 10])
    assert got == {1: None, 2: "reply", 3: "start", 4: "role", 5: "empty", 6: "unknown", 7: "start", 8: None, 9: "empty", 10: "reply"}


def test_versions_duplicates_and_units(spark):
    rows = [
        msg(1, 1, "user", at=1_700_000_000, group="g", version=1), msg(2, 1, "assistant", at=1_700_000_001_000, group="g", version=1),
        msg(3, 1, "user", at=1_700_000_002, group="g", version=2), msg(4, 1, "assistant", at=1_700_000_003_000, group="g", version=2),
        msg(4, 1, "assistant", at=1_700_000_003_000, group="g", version=2),
    ]
    m = spark.createDataFrame(rows, MESSAGES)
    c = spark.createDataFrame([(1, "t")], CONVERSATIONS)
    got = ordered_conversations(m, c).orderBy("position").collect()
    assert [(r.message_id, r.position, r.speaker) for r in got] == [(3, 0, "user"), (4, 1, "assistant")]


def test_long_conversation_in_runs_is_as_one(spark):
    # all but the last in one instant: message_id decides
    rows = [msg(i, 1, "user" if i % 2 else "assistant", at=1_700_000_000 + i // 399) for i in range(1, 401)]
    assert verdicts(spark, rows, [1]) == {1: None}
    m = spark.createDataFrame(rows, MESSAGES)
    c = spark.createDataFrame([(1, "t")], CONVERSATIONS)
    turns = thread_conversations(m, c)[0].orderBy("position").collect()
    assert [r.message_id for r in turns] == list(range(1, 401))
    assert [r.position for r in turns] == list(range(400))
    broken = rows[:200] + [msg(900, 1, "user", at=1_700_000_000)] + rows[200:]
    assert verdicts(spark, broken, [1]) == {1: "reply"}


def test_links_that_lead_nowhere(spark):
    nodes = [
        (11, 2, 1, "user"), (13, 11, 1, "assistant"),  # sound
        (21, 23, 2, "user"), (23, 25, 2, "assistant"), (25, 21, 2, "user"),  # a cycle
        (31, 6, 3, "user"), (33, 39, 3, "assistant"),  # 39 is missing
        (41, 8, 4, "user"), (43, 41, 4, "assistant"),  # conversation 4 is missing
        (51, 51, 5, "user"),  # itself
    ]
    nodes = spark.createDataFrame(nodes, "node long, parent long, conversation_id long, speaker string")
    paths, found = follow_paths(nodes, spark.createDataFrame([(i, "") for i in (1, 2, 3, 5, 6)], CONVERSATIONS))
    assert {r.conversation_id: r.reason for r in found.collect()} == {1: None, 2: "cycle", 3: "orphan", 4: "unknown", 5: "cycle", 6: "empty"}
    assert {r.node: (r.state, r.position) for r in paths.where("conversation_id IN (1, 4)").collect()} == {11: ("ok", 0), 13: ("ok", 1), 41: ("orphan", 0), 43: ("orphan", 1)}


def test_nulls_and_empty_tables(spark):
    rows = [(None, 1, None, None, None, None, None, None, None), (None, 1, "user", "x", None, None, None, None, None)]
    assert verdicts(spark, rows, [1]) == {1: "reply"}
    assert verdicts(spark, [], []) == {}
    assert verdicts(spark, [], [3]) == {3: "empty"}
