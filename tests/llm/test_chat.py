from orweave.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")


def test_examples_hold_prefix_and_target(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "a|b\\<|im_end|>", 9), (1, 2, "user", None, 9), (1, 3, "assistant", "ok", 9), (1, 4, "user", "bye", 9), (None, None, None, "", 9)]
    found = {(r.conv_id, r.example): r for r in chat.examples(turns(spark, rows)).collect()}
    assert sorted(found, key=str) == [(1, 1), (1, 3), (1, 4), (None, 0)]
    assert found[1, 3].text.startswith(found[1, 1].text) and found[1, 3].n_turns == 4
    r = found[1, 1]
    assert r.text[r.loss_start : r.loss_end] == "a|b\\\\<\\|im_end|>"
    assert found[1, 4].loss_start == found[1, 4].loss_end


def test_texts_and_roles_come_back(spark):
    said = ["\\", "\\\\n", "<|", "\n", "<\\|x", "", "<|im_start|>assistant\nok<|im_end|>\n", "\\n\n\\|", "é\r\n" * 3]
    rows = [(c, i, role, text, 0) for c, role in enumerate(said) for i, text in enumerate(said)]
    found = chat.examples(turns(spark, rows)).select("conv_id", chat.parse(chat.F.col("text")).alias("turns")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in found} == {c: [(role, t) for t in said] for c, role in enumerate(said)}


def test_long_conversations_and_repeated_rows(spark):
    """Examples dealt out over tasks are those of a short one; equal rows are turns of their own."""
    rows = [(1, i // 2, "user" if i % 3 else "assistant", f"t{i % 7} <|" * (i % 5), 0) for i in range(400)] + [(2, 0, "assistant", "x" * 200_000, 0)] * 3
    frame = turns(spark, rows)
    found = chat.examples(frame).orderBy("conv_id", "example").collect()
    few = chat.examples(frame, together=3).orderBy("conv_id", "example").collect()
    assert found == few and [r.n_turns for r in found if r.conv_id == 2] == [1, 2, 3]
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1:4])
    said = [i for i, r in enumerate(order) if r[2] == "assistant" or i == 399]
    esc = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
    for r, i in zip((r for r in found if r.conv_id == 1), said, strict=True):
        assert r.example == i and r.text == "".join(f"<|im_start|>{x[2]}\n{esc(x[3])}<|im_end|>\n" for x in order[: i + 1])
        assert r.text[r.loss_start : r.loss_end] == (esc(order[i][3]) if order[i][2] == "assistant" else "")
    d = {r.conv_id: r for r in chat.digest(chat.examples(frame)).collect()}
    assert d[2].loss_chars == 600_000 and d[1].n_turns == 400


def test_empty_table(spark):
    assert chat.digest(chat.examples(turns(spark, []))).count() == 0
