"""Chat formatting: escapes round trip, pieces read back, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalcount.llm import chat
from shoalcount.llm.queries import QUERIES
from shoalcount.session import materialize

TURNS = "conv_id bigint, turn bigint, role string, text string, piece string, loss int"
T = chat.Template()


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def texts_of(data, offsets):
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def test_escape_is_reversible_and_leaves_no_control_string(monkeypatch):
    rng = random.Random(3)
    bits = [c.decode() for c in T.controls()] + ["<", "[", "]", ">", "s>", "/s>", "\\", "\\\\", "INST]", "é", "中", "😀", " ", "a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["<" + "\\" * 500 + "s>", "", "<s", "s>"]
    for window in (1 << 20, 5):
        monkeypatch.setattr(chat, "WINDOW", window)
        data, offsets = chat.escaped(*laid(texts), T.controls())
        shown = texts_of(data, offsets)
        assert not any(c.decode() in t for t in shown for c in T.controls())
        assert texts_of(*chat.unescaped(data, offsets, T.controls())) == texts
    assert shown[texts.index("<s")] == "<s" and len(set(shown)) == len(set(texts))


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        learned = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:5] for r in rows}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    assert got(QUERIES["op12_chat"](spark, sf)) == brute(rows)


def test_pieces_carry_turns_and_spans(spark):
    rows = [(1, 0, "user", "hi <s>", "p", 1), (1, 1, "assistant", "a[/OUT]", "p", 1), (1, 2, "tool [SAYS] x", "<s", "p", 1), (1, 3, None, None, "p", 1)]
    piece = chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()
    text = "".join(r["formatted"] for r in sorted(piece, key=lambda r: r["piece"]))
    assert text == r"<s>[INST] hi <\s> [/INST][OUT] a[\/OUT] [/OUT]</s>[ROLE] tool [\SAYS] x [SAYS] <s [/ROLE][ROLE]  [SAYS]  [/ROLE]"
    spans = [r["formatted"].encode()[s["start"] : s["end"]] for r in piece for s in r["loss"]]
    assert spans == [rb"a[\/OUT]"] and sum(r["n_turns"] for r in piece) == 4
    assert chat.turns_of(text.encode(), T) == [(b"user", b"hi <s>"), (b"assistant", b"a[/OUT]"), (b"tool [SAYS] x", b"<s"), (b"", b"")]
    with pytest.raises(ValueError):
        chat.Template(roles=(("user", "[U]", " [/U]"),))


@pytest.mark.parametrize("piece_bytes", [1 << 20, 90])
def test_odd_rows_and_a_hot_conversation(spark, piece_bytes):
    rng = random.Random(8)
    bits = ["<s>", "</s>", "[INST]", "[OUT]", "[/OUT]", "\\", "\n", "é", "😀", "x", "[SAYS]", "assistant"]
    roles = ["user", "assistant", "system", "tool", "", None, "a\nb", "[ROLE]"]
    rows = [(rng.choice([1, 2, 3, None, 5, 6, 7]), rng.choice([0, 1, 2, None, 3]), rng.choice(roles), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randrange(9)))])) for _ in range(200)]
    rows += [(9, i, roles[i % 3], "hot " * (i % 5)) for i in range(600)] + [(10, 0, "assistant", "<s>é" * 400_000)] + [rows[0]] * 5
    table = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a conversation meets partition borders
    try:
        pieces = materialize(chat.format_conversations(table, T, piece_bytes))
        of_hot = pieces.where("conv_id = 9").agg(F.count("*"), F.max("n_turns"), F.countDistinct(F.shiftright("piece", 40)), F.sum(F.col("whole").cast("int"))).first()
        assert of_hot[2] > 1 and of_hot[3] == 0 and (piece_bytes > 90 or of_hot[1] <= 5)
        assert got(chat.read_back(pieces)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert piece_bytes == 90 or pieces.where("whole").count() > 0
    assert chat.digests(table.where(F.lit(False))).count() == 0
