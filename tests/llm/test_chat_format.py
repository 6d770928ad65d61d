import hashlib

from pyspark.sql import functions as F

from lineweave.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, window string, t string"


def expected(rows):
    whole = {}
    for conv, turn, role, text, *_ in rows:
        whole.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in whole.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), said, loss)
    return out


ROWS = [
    (1, 0, "system", "be kind", "", ""), (1, 1, "user", "</s>[INST] ok [/INST]", "", ""), (1, 2, "assistant", "a\\b <| <\\| \\<| \\\\<|end|> <\\\\|", "", ""), (1, 3, "user", None, "", ""), (1, 4, "assistant", "x " * 50, "", ""), (1, 5, "assistant", "y é😀", "", ""), (1, 6, "user", "bye", "", ""), (1, 7, "assistant", "[\\INST] <<SYS>> <</SYS>> </s", "", ""),
    (2, 0, "assistant", "", "", ""), (3, 5, "user", "tie b", None, None), (3, 5, "user", "tie a", None, None), (3, 5, "user", "tie a", None, None), (3, None, "assistant", "first", None, None),
    (None, 1, None, "who", None, None), (4, 0, "<|turn|>", "<|text|>\n<|end|>", None, None), (5, 0, "user", "w " * 9000, None, None), (5, 1, "assistant", "v " * 9000, None, None),
]


def test_round_trip(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    want = expected(ROWS)
    for budget, history in ((2048, 2), (8, 2), (8, 0), (1, 5), (60, 1)):
        windows = C.format_chats(turns, budget, history)
        found = {r.conv_id: r for r in C.read_back(windows).collect()}
        assert found.keys() == want.keys()
        for conv, (n, said, loss) in want.items():
            r = found[conv]
            assert (len(r.turns), "".join(f"{t.role}\n{t.text}\n" for t in r.turns), r.loss) == (n, said, loss), (conv, budget)
        for w in windows.collect():
            assert w.n_repeated <= history + 1 and w.text.count(C.TURN) == w.n_turns == w.text.count(C.END)
            check_budget(w, budget)


def check_budget(w, budget):
    """A window's tokens, also the repeated ones, stay in the budget unless its one new turn doesn't."""
    tokens = [len(x.split(C.TEXT)[1].split()) + 1 for x in w.text.split(C.END)[:-1]]
    assert sum(tokens) <= budget or (w.n_repeated == 0 and len(tokens) == 1), (w.conv_id, w.window, tokens)


def test_budget_holds_with_repeated_turns(spark):
    rows = []
    for conv, (system, sizes) in enumerate([(1500, [900] * 6), (900, [900] * 6), (10, [300] * 20), (100, [5, 2000, 5, 1000, 1000, 1, 1, 3000, 1]), (2100, [10, 10]), (0, [700] * 9)]):
        said = ([("system", "s " * system)] if system else []) + [("assistant" if i % 2 else "user", "w " * n) for i, n in enumerate(sizes)]
        rows += [(conv, i, role, text, "", "") for i, (role, text) in enumerate(said)]
    windows = C.format_chats(spark.createDataFrame(rows, SCHEMA))
    found = windows.collect()
    for w in found:
        check_budget(w, 2048)
    # a small system turn opens each window, and history fills what is left
    later = [w for w in found if w.conv_id == 2 and w.window]
    assert later and all(w.text.startswith("<|turn|>system") and w.n_repeated in (2, 3) for w in later)
    assert max(w.n_turns for w in found if w.conv_id == 2) >= 5
    whole = {r.conv_id: r for r in C.read_back(windows).collect()}
    assert {c: "".join(f"{t.role}\n{t.text}\n" for t in r.turns) for c, r in whole.items()} == {c: said for c, (_, said, _) in expected(rows).items()}


def test_query_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + C.PLANTED
    found = {r.conv_id: r for r in C.op8_chat_format(spark, "/root/testdata/sf0.01").collect()}
    want = expected(rows)
    assert found.keys() == want.keys()
    for conv, (n, said, loss) in want.items():
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(said)


def test_native_and_empty(spark):
    plan = C.op8_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = spark.createDataFrame([], SCHEMA)
    assert C.read_back(C.format_chats(empty)).collect() == []
    # escaping leaves no mark in a text
    marked = spark.createDataFrame([("<|" + "".join(C.CONTROLS) + "\\",)], "s string").select(C.escape(F.col("s")).alias("e"), C.unescape(C.escape(F.col("s"))).alias("u"), "s").first()
    assert marked.u == marked.s and not any(c in marked.e for c in C.CONTROLS)
