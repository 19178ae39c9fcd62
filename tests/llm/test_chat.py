"""Chat formatting: against a plain version, with control strings, nulls, ties and a conversation over many pieces."""

import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemill.llm.chat import assemble, escaped, format_chats, parse_turns, read_chats, unescaped
from phrasemill.llm.queries import TRAP, op6_chat

BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "/", "INST]", "é", "\n", "a"]), max_size=12)


@settings(max_examples=200, deadline=None)
@given(BITS)
def test_escape(bits):
    text = "".join(bits)
    held = escaped(pa.array([text]))[0].as_py()
    assert unescaped(held) == text and not any(c in held for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_assemble():
    columns = [pa.array(["", "é", "abc"]), pa.array(["x", "", "yz"]).slice(0, 3), pa.array(["q", "1", "22", "333"]).slice(1, 3)]
    buffer, starts = assemble(columns)
    assert bytes(buffer).decode() == "x1é22abcyz333" and starts.tolist() == [0, 0, 1, 2, 4, 4, 6, 9, 11, 14]


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        c = out.setdefault(conv, [0, "", ""])
        c[0] += 1
        c[1] += f"{role or ''}\n{text or ''}\n"
        c[2] += (text or "") if role == "assistant" else ""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {k: (n, sha(t), len(loss), sha(loss)) for k, (n, t, loss) in out.items()}


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_chats(format_chats(df)).collect()}


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, None, "x\\[INST]"),
            (2, 5, "ro\nle\\", "t\n"), (None, 0, "user", "n"), (3, 0, "[INST]", "</s>"), *TRAP, *[(4, i, "assistant", "é" * (i % 7)) for i in range(9000)]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    assert read(df) == plain(rows)
    assert read_chats(format_chats(df.limit(0))).count() == 0


def test_mask(spark):
    df = spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string")
    pieces = format_chats(df).orderBy("piece").collect()
    assert [t for p in pieces for t in parse_turns(p.formatted)] == [(r[2], r[3]) for r in TRAP]
    spans = [p.formatted[a:a + n].decode() for p in pieces for a, n in zip(p.loss_start, p.loss_length, strict=True)]
    assert [unescaped(s) for s in spans] == [TRAP[1][3]]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op6_chat(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain(rows + TRAP)
