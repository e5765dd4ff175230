import hashlib
import random

from pyspark.sql import functions as F

from cadenza.llm import chat, queries

NASTY = ["", "\\", "\\\\", "<|im_end|>\n", "<|im_start|>assistant\nx", "</s>[INST] ok [/INST]", "<", "<\\|", "a\nb", "é漢😀", "<<SYS>>\n", "\\<|", "|>", "[INST]", "$1", "\r\n"]


def rows(rnd, n):
    out = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 3, 9])):
            out.append((c, t, rnd.choice(["user", "assistant", "system", "a\nb", "x\\"]), "".join(rnd.choice(NASTY) for _ in range(rnd.randint(0, 4)))))
    return out


def test_escapes_round_trip(spark):
    rnd = random.Random(0)
    texts = NASTY + ["".join(rnd.choice(NASTY) for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame([(t, rnd.choice(texts)) for t in texts], "r string, t string")
    for r in df.select("r", "t", chat.parse(F.concat(chat.format_turn(F.col("r"), F.col("t")), chat.format_turn(F.col("t"), F.col("r")))).alias("p")).collect():
        assert [(x.role, x.text) for x in r.p] == [(r.r, r.t), (r.t, r.r)]
        assert not any(c in x.raw for x in r.p for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_examples_and_digest(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rnd = random.Random(1)
    data = [*rows(rnd, 40), (100, 0, None, None), (None, 1, "user", "hi"), (None, 2, "assistant", "yo"), (101, None, "assistant", "first"), (101, 0, "user", "b"), (101, 0, "user", "b")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    found = chat.examples(df).cache()
    by = {}
    for c, t, r, x in sorted(data, key=lambda z: (z[0] is not None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: r for r in chat.digest(found).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert r.n == len(turns) and r["all"] == "".join(f"{a}\n{b}\n" for a, b in turns)
        assert r.loss == "".join(b for a, b in turns if a == "assistant")
    full = {(r.conv_id, r.example): r for r in found.where("completion is not null").collect()}
    fmt = {}
    for r in df.select("role", "text", chat.format_turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("f")).collect():
        fmt[r.role or "", r.text or ""] = r.f
    for c, turns in by.items():
        targets = [k for k, (a, _) in enumerate(turns) if a == "assistant"]
        assert sorted(e for x, e in full if x == c) == list(range(len(targets)))
        for e, k in enumerate(targets):
            assert full[c, e].prompt == "".join(fmt[x] for x in turns[:k]) and full[c, e].completion == fmt[turns[k]]
    for r in found.where("completion is not null").collect():
        assert chat_unescape(r.completion[r.loss_start : r.loss_end]) in {b for a, b in by[r.conv_id] if a == "assistant"}
    assert chat.digest(chat.examples(df.where("false"))).count() == 0


def chat_unescape(text):
    out, k = [], 0
    while k < len(text):
        k += text[k] == "\\"
        out.append(text[k])
        k += 1
    return "".join(out)


def test_query(spark, tmp_path):
    """The query's digests against plain Python."""
    rnd = random.Random(2)
    data = [x for x in rows(rnd, 30)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, t, r, x in sorted(data):
        by.setdefault(c, []).append((r, x))
    got = queries.op5_chat(spark, str(tmp_path)).collect()
    assert len(got) == len(by)
    for r in got:
        turns = by[r.conv_id]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns) and (r.expanded_chars == 0) == (not any(a == "assistant" for a, _ in turns))
