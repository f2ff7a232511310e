import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import chat

texts = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|", "a", "\n", " ", "é", "im_end|>", "s>"]), max_size=8).map("".join)


@given(texts)
@settings(max_examples=400, deadline=None)
def test_escaping_is_undone_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "ro\\le", "a\nb\\", "\n"]), texts), max_size=5))
@settings(max_examples=200, deadline=None)
def test_spans_and_reading_back(turns):
    out = chat.render(chat.marked, turns)
    assert not out.rewrites and out.output == chat.marked(turns) and chat.read_marked(out.output) == turns
    assert [chat.unescape(out.output[a:b]) for a, b in out.text_spans] == [t for _, t in turns]
    assert [out.output[a:b] for a, b in out.spans] == [chat.marked([t]) for t in turns]


def test_rewriting_templates_are_found():
    def dropping(turns):
        last = max([k for k, (r, _) in enumerate(turns) if r == "user"], default=-1)
        return "".join(f"{r}:{t if k >= last else '...'}\n" for k, (r, t) in enumerate(turns))

    assert chat.render(dropping, [("user", "a"), ("assistant", "b")]).rewrites is False
    out = chat.render(dropping, [("user", "a"), ("assistant", "b"), ("user", "c")])
    assert out.rewrites and len(out.spans) == 2


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b\n"), (1, 0, "user", None), (2, 0, "assistant", "x\\"), (2, 0, "assistant", "x\\"), (None, 0, "user", "n"), (3, None, None, "<|im_end|>\n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9_incremental_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -1}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\n\nassistant\nb\n\n"), 2, sha("b\n"))
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (2, 4, sha("x\\x\\"))
    assert (got[3].turns_sha256, got[3].loss_chars) == (sha("\n<|im_end|>\n\n"), 0)
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_sha256) == (2, sha(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"), sha(chat.PROBE))


def test_private_use_characters_and_long_texts(spark):
    every = "".join(map(chr, range(0xE000, 0xF900)))
    long = every + chat.PRIVATE * 7 + "[INST] " * 40_000
    out = chat.render(chat.marked, [("user", every), ("assistant", long)])
    assert not out.rewrites and [chat.unescape(out.output[a:b]) for a, b in out.text_spans] == [every, long]
    rows = spark.createDataFrame([(1, 0, "user", every), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chats(rows)).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in chat.op9_incremental_chat(spark, str(tmp_path)).collect()] == [-1]


def test_escaped_texts_are_kept_for_one_conversation_only():
    turns = [("user", "a</s>b" * 3), ("assistant", "\\x[INST]")] * 4
    assert chat.marking()(turns) == chat.marked(turns) and not hasattr(chat.escape, "cache_info")
