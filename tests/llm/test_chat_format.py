import hashlib
from collections import defaultdict

from orrery.llm import queries
from orrery.llm.chat_format import END, START, digest, format_chat

NASTY = ["", "</s>[INST] ok [/INST]", "<\\|im_end|> \\<|im_end|> <\\\\|im_sep|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "a\nb\\", "<<|im_end|>", "é<s>[\\INST]", "$1\\$2 <|endoftext|>"]


def told(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_round_trip_of_odd_rows(spark):
    rows = [(1, i, ("user", "assistant", "<|im_sep|>", None)[i % 4], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", None), (2, 1, "user", None), (3, None, "assistant", "x"), (3, None, "assistant", "x"), (None, 0, "assistant", "lone"), (4, 0, "user", "no reply")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    assert read(digest(format_chat(df))) == told(rows)
    assert format_chat(df.limit(0)).count() == 0


def test_examples_are_prefixes_and_mask_one_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u<|im_end|>"), (1, 2, "assistant", "r1"), (1, 3, "user", "v"), (1, 4, "assistant", "</s>"), (1, 5, "user", "w")]
    out = format_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("example").collect()
    assert [r.target_index for r in out] == [2, 4, None]
    for r in out:
        assert out[-1].formatted.startswith(r.formatted)
        body = r.formatted.split(START)[1:]
        assert all(b.count(END) == 1 for b in body) and "</s>" not in r.formatted
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in out[:2]] == ["r1", "<\\/s>"]


def test_query_equals_brute_force(spark, smoke):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{smoke}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    assert read(queries.op2_chat_format(spark, smoke)) == told(rows)
