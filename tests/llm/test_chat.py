import hashlib
import random

from signalpanel.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss_start string"


def brute(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, f"{chat.escape_role(r[2] or '')}\n{chat.escape(r[3] or '')}<|im_end|>".encode())):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in convs.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_reads_back_every_turn(spark):
    r = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "<|", "\\n", "\n", "é", "😀", "ok", "<\\|im_end|>", " "]
    rows = [(r.randrange(20), r.randrange(6), r.choice(["user", "assistant", "a\nb", None, "<|im_end|>"]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randrange(12)))])) for _ in range(300)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 2, "user", "same"), (3, 2, "user", "same"), (99, 1, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*x, "f", "l") for x in rows], SCHEMA)
    got = [tuple(x)[:5] for x in chat.read_back(chat.format_turns(df)).collect()]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_typed_parts(spark):
    parts = [("text", "see <|image:0|>", None, None), ("image", None, "s3://a.png", 2), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", None), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,size:int>>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert first.formatted == "<|im_start|>user\nsee <\\|image:0|><|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [(a.slot, a.kind, a.ref) for a in first.attachments] == [(0, "image", "s3://a.png"), (1, "audio", "b.wav"), (2, "document", "c.pdf")]
    assert first.expanded_tokens == 2 * 256 + 3 * 50 + 512 and first.loss_start == first.loss_end == 0
    assert second.loss_start == second.loss_end and second.formatted == "<|im_start|>assistant\n<|im_end|>\n"


def test_empty(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_forged_conversation(spark):
    got = queries.op8_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (got.n_turns, got.loss_chars) == (2, len(queries.FORGED))


def test_parts_of_other_kinds_and_clashing_columns(spark):
    """An unknown or missing type has a defined result; a column that happens to be called parts is no content."""
    text, attached, tokens = chat.flatten([{"type": None, "text": "a<|"}, {"type": "video", "ref": "v", "size": 3}, {"text": "b"}, {"type": "image", "ref": None}])
    assert (text, attached, tokens) == ("a<\\|<|other:0|>b<|image:1|>", [(0, "video", "v"), (1, "image", "")], 3 + 256)
    for kind, value in (("string", "x"), ("array<string>", ["x"]), ("array<struct<name:string>>", [("x",)])):
        df = spark.createDataFrame([(1, 1, "user", "hello", value)], f"conv_id long, turn long, role string, text string, parts {kind}")
        assert "hello" in chat.format_turns(df).first().formatted
    typed = spark.createDataFrame([(1, 1, "user", "hello", [("text", "typed", None, None), None, ("odd", None, "r", 2)])], "conv_id long, turn long, role string, text string, parts array<struct<type:string,text:string,ref:string,size:int>>")
    got = chat.format_turns(typed).first()
    assert got.formatted == "<|im_start|>user\ntyped<|other:0|><|im_end|>\n" and got.expanded_tokens == 2
