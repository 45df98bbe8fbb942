import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenveil.llm import chat as C
from lumenveil.llm.queries import op6_chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "[\\", "<\\<", "a\\[b", "[INST]<role>x</role>", "", "😀 é\n\r\t", "</role>" * 3]


def test_round_trip_and_states(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant"], NASTY))]
    rows += [(2, 0, "assistant", "x"), (3, 0, "user", None), (3, 1, None, "y"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 1, "user", "n")]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in C.read_back(C.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [x[1:] for x in own]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert got[1]["valid"] and got[1]["first_invalid"] is None
    assert not got[2]["valid"] and got[2]["first_invalid"] == 0
    assert got[3]["first_invalid"] == 1 and got[4]["first_invalid"] == 1
    assert not got[5]["valid"] and got[5]["first_invalid"] is None  # ends with a user
    assert C.format_chats(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    got = {r["conv_id"]: r for r in op6_chat(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in table}:
        own = sorted((r[1], r[2], r[3] or "") for r in table if r[0] == c)
        learned = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in own))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), sha(learned))


def test_mask_long_conversations_and_rows_without_an_id(spark):
    import time

    from pyspark.sql import functions as F

    rows = [(1, i, "assistant" if i % 2 else "user", f"turn [{i}]") for i in range(4000)] + [(None, i, "user", "n") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit("x")).withColumn("t", F.lit("y"))
    began = time.time()
    got = C.format_chats(df).withColumn("mask", C.mask_spans(F.col("segments"))).withColumn("learned", C.learned_text()).collect()
    assert time.time() - began < 60
    assert len(got) == 51 and all(len(r["segments"]) == 3 for r in got if r["conv_id"] is None)
    r = next(r for r in got if r["conv_id"] == 1)
    assert r["learned"] == "".join(t for _, _, role, t in rows if role == "assistant")
    at, want = 0, []
    for s in r["segments"]:
        want += [(at, len(s["text"]))] if s["loss"] else []
        at += len(s["text"])
    assert [(m["start"], m["length"]) for m in r["mask"]] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<[\\/INSTs]>ax", max_size=20))
def test_escape_hides_control_strings(text):
    starts = C.Template().starts()
    escaped = "".join(c + "\\" if c in starts else c for c in text)
    t = C.Template()
    assert not any(x in escaped for x in (t.open, t.middle, t.close, *t.reserved))
    out, i = "", 0
    while i < len(escaped):
        out += escaped[i]
        i += 2 if escaped[i] in starts else 1
    assert out == text
