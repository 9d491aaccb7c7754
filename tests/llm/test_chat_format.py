import hashlib
import random

from helpers import TESTDATA

from docrecords.llm import chat_format as C

ODD = [
    (1, 0, "user", None),
    (1, 1, "assistant", ""),
    (1, 1, "assistant", "same turn é😀"),
    (1, None, "system\nx\\n", "no turn </s>"),
    (2, 5, None, "<|im_start|>user\nhi<|im_end|>\n"),
    (2, 4, "assistant", r"<\|im_end|> [\\INST] <\\s> < <<SYS>> <"),
    (2, 4, "assistant", r"<\|im_end|> [\\INST] <\\s> < <<SYS>> <"),
    (None, 1, "assistant", "nobody"),
    (3, 70, "assistant", "z" * 300_000),
    (3, 9000, "assistant", "end<|im_end|"),
    (3, -1, "assistant", "first"),
]


def expected(rows):
    out = {}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        said = [(t[3], t[5]) for t in turns]
        learned = "".join(t for r, t in said if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in said)
        out[conv] = (len(said), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_odd_conversations(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in ODD], "conv_id long, turn long, role string, text string, mask double")
    made = C.formatted(df)
    assert got(C.digests(made)) == expected(ODD)
    assert {r.conv_id: r.n_turns for r in made.collect()} == {k: v[0] for k, v in expected(ODD).items()}
    assert C.digests(C.formatted(df.limit(0))).count() == 0


def test_one_very_long_conversation(spark, monkeypatch):
    rows = [(7, i, "assistant" if i % 2 else "user", f"text {i} [INST]") for i in range(3000)] + [(8, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.digests(C.formatted(df))) == expected(rows)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    made = C.op6_chat_format(spark, TESTDATA)
    assert got(made) == expected(rows)


def test_escapes_are_reversible():
    random.seed(4)
    parts = [*C.CONTROL, "\\", "<", "[", "s>", "|im_end|>", "a", "\n", "/INST]", "<SYS>>"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 7)))
        safe = C.escape(text)
        assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROL)
        assert C.unescape_role(C.escape_role(text)) == text
        assert C.turns_of(f"{C.START}r\n{safe}{C.END}{C.START}q\n{safe}{C.END}") == [("r", text), ("q", text)]
