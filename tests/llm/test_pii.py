import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from lumenveil.llm import pii

SF = "/root/testdata/sf0.001"


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    got = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    got += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    got += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    got += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return got


CASES = [
    "", None, "  \n", "a@b.c_d@e.f g@h", "😀 x.y@z.co é+1 (990) 555-1864 ", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3.04",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 41111111111111111111111", "+1 +12 345 678 90 +1.2.3.4.5.6.7.8.9(", "a" * 60000,
    "1" * 30000 + ".", "a@" * 2000, "a@" + "b." * 3000 + "c", "9 " * 9000, "1.2.3.4 " * 300, "token = \"" + "0a1b" * 10 + "\"",
    "call (415) 555-2671 ssn: 123-45-6789", "+1 (990) 555-1864 " * 50,
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _base string")
    found = pii.candidates(df)
    return {r["doc_id"]: r for r in pii.digest(found.withColumn("_all", pii.accepted(pii.fit(found)))).collect()}


def test_base_spans_equal_brute_force(spark):
    texts = CASES + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        for k in pii.BASE:
            assert got[i][f"n_{k}"] == sum(x[0] == k for x in want), (k, (t or "")[:80])
        joined = ",".join(f"{k}:{a}:{b}" for k, (a, b) in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_method_adds_secrets_and_keeps_clean_numbers(spark):
    texts = ['token = "976d63bcc718c8af69164ec84259a9ab832af580"'] * 5 + ["plain words 12 and 2024, order 1234567890123"] * 5 + ["ssn: 123-45-6789"] * 3
    got = run(spark, texts)
    assert got[0]["spans"] == "secret:9:49"
    assert got[5]["spans"] == ""
    assert got[10]["spans"] == "ssn:5:16"


def test_empty_table_and_redaction(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "mail x.y@z.co now"), (2, None), (3, "clean"), (3, "clean")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in pii.redact(df.withColumn("n", F.lit(1))).collect())
    assert got == [(1, "mail [EMAIL] now"), (2, None), (3, "clean"), (3, "clean")]


def test_clashing_columns_are_kept(spark):
    names = ["_t", "_email", "_base", "_cand", "_all", "_digit", "_given", "c0", "_marks", "x"]
    df = spark.createDataFrame([(1, "mail x.y@z.co now")], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    got = pii.redact(df)
    assert got.columns == ["doc_id", "text", *names]
    assert tuple(got.first()) == (1, "mail [EMAIL] now", *names)


def test_overlaps_and_marks_equal_plain_loops(spark):
    r = random.Random(3)
    parts = ["a@b.co", "+1 (990) 555-1864", "1.2.3.4", "415-555-2671", "123-45-6789", "4111111111111111", "0a1b" * 8, "word", "\n", "é😀", "key:", "4111 1111 1111 1111"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "-", ""]) for _ in range(r.randrange(1, 60))) + "z" * r.choice([0, 3000]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df)
    model = pii.fit(found)
    kinds = [k for k in pii.PATTERNS if k not in pii.BASE]
    masked = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    for x in found.withColumn("all", pii.accepted(model)).collect():
        t = texts[x["doc_id"]]
        spans = [(c["kind"], c["start"], c["end"]) for c in x["_cand"]]
        fixed = [s for s in spans if s[0] in pii.BASE]
        meets = lambda a, b: a[1] < b[2] and b[1] < a[2]
        wide = []
        for k in kinds:
            p = re.compile(pii.PATTERNS[k], re.A)
            wide += [(k, m.start(), m.end()) for m in p.finditer(t) if k != "secret" or re.search("[0-9]", m[0])]
        wide = [s for s in wide if not any(meets(s, b) for b in fixed)]
        wide = [s for s in wide if not any(meets(s, b) and kinds.index(b[0]) < kinds.index(s[0]) for b in wide)]
        assert sorted(spans) == sorted(fixed + wide)
        out, reach = [], 0
        for a, b, k in sorted((a["start"], a["end"], a["kind"]) for a in x["all"]):
            if a >= reach:
                out += [t[reach:a], f"[{k.upper()}]"]
            reach = max(reach, b)
        assert masked[x["doc_id"]] == "".join(out) + t[reach:]


def test_very_long_text_in_linear_time(spark):
    one = "reach me at user.name@mail.example.org or on the phone. "
    text = one * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert pii.redact(df).first()["text"] == one.replace("user.name@mail.example.org", "[EMAIL]") * 100_000
    assert time.time() - began < 60
