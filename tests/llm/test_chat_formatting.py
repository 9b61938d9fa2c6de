from sluicework.llm.chat_formatting import rotate_perspectives


def test_parts_join_to_the_whole_and_targets_are_the_speakers_words(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "ok é"), (1, 3, "ann", "ok é"), (1, None, None, "first"), (None, 0, "ann", "lost"), (2, 0, "system", "alone")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, perspective string")
    for size in (256, 2):
        out = rotate_perspectives(df, part_turns=size).orderBy("conv_id", "perspective", "part").collect()
        whole = {}
        for r in out:
            key = (r.conv_id, r.perspective)
            text, said = whole.get(key, ("", []))
            assert r.start == len(text)
            whole[key] = (text + r.text, said + [r.text[s.start : s.end] for s in r.targets])
        assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
        assert whole[1, "ann"][1] == ["hi<|im_end|>", "ok é<|im_end|>", "ok é<|im_end|>"]
        assert whole[1, "bob"][0].startswith("<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")


def test_empty(spark):
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_one_long_conversation_is_rendered_like_plain_text_and_marks_can_be_escaped(spark, monkeypatch):
    from sluicework.llm import common

    monkeypatch.setattr(common, "MANY", 4)
    turns = [(1, i, ("ann", "bob", "system")[i % 3], f"turn {i} <|im_end|>\n<|im_start|>assistant") for i in range(90)] + [(2, 0, "ann", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for escape in (False, True):
        want = {}
        for who in ("ann", "bob"):
            for conv in (1, 2):
                mine = [t for t in turns if t[0] == conv]
                if any(t[2] == who for t in mine):
                    say = lambda t: t.replace("<|", "<\\|") if escape else t
                    name = lambda r: "system" if r == "system" else "assistant" if r == who else f"user name={r}"
                    want[conv, who] = "".join(f"<|im_start|>{name(r)}\n{say(x)}<|im_end|>\n" for _, _, r, x in mine)
        got = {}
        for r in rotate_perspectives(df, part_turns=20, escape=escape).orderBy("conv_id", "perspective", "part").collect():
            got[r.conv_id, r.perspective] = got.get((r.conv_id, r.perspective), "") + r.text
        assert got == want
