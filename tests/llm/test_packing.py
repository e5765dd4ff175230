import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cadenza.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    bits = ["It's", "<|endoftext|>", "a<|startoftext|>b", "é", " ", "\n", "\t", " ", "\x1c", "Σ", "ΑΣ", "12,5", "…", "ﬁ", "漢字", "İ", "\r\n", "́x", "don't", "<|", "|>", "　", "", "ab c", "('s", "x'll", "ÀÉß", "ÿ÷", "ª", "%%%", "''d"]
    encode = packing.Encoder(PATH)
    for _ in range(1500):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        if rnd.random() < 0.5:
            t = "".join(c for c in t if c in " \n\t\r" or "!" <= c <= "~" or c in "éÀÉßÿ")
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_scores_are_bm25():
    ids = [np.array(x) for x in ([1, 1, 3], [3, 4], [5], [])]
    of = packing.Corpus(10, 3.0, np.linspace(1, 2, 8).astype(np.float32))
    got = packing.Index(ids, of).scores(np.array([1, 3]))
    for k, x in enumerate(ids):
        want = sum(of.idf[t] * (n := (x == t).sum()) * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(x) + 1) / 3)) for t in (1, 3))
        assert abs(got[k] - want) < 1e-6


def test_every_id_lies_in_one_piece(spark):
    rnd = random.Random(1)
    vocab = ["river", "stone", "Cloud", "été", "zq", "12", "..."]
    rows = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 50, 3000])))) for k in range(200)] + [(300, None), (301, ""), (5, "river"), (5, "river"), (None, "stone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length * 4 == len(r.ids) and r.length > 0
    for k, t in rows:
        if k in (5, None):
            continue
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        want = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(want)
            at += r.length
    assert len(by_doc[5]) >= 3
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_neighbours_come_first():
    of = packing.Corpus(6, 4.0, np.ones(100, np.float32))
    docs = [np.array([10, 11, 2]), np.array([50, 51, 2]), np.array([10, 60, 2]), np.array([10, 11, 2])]
    packer = packing._Packer(of, 0, 6)
    packer.shard(list("abcd"), docs)
    packer.finish()
    assert [(r[0], r[5]) for r in packer.rows] == [("a", 0), ("d", 0), ("b", 1), ("c", 1)]


def test_shards_that_come_out_even(spark, monkeypatch):
    """A task whose documents fill its last shard to the last one, and a table of empty texts."""
    rows = [(k, "river stone" if k % 2 else None) for k in range(packing.SHARD_DOCS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, PATH).collect()
    assert sorted(r.doc_id for r in got if r.start == 0) == list(range(packing.SHARD_DOCS))
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_query(spark, tmp_path):
    """The query's checksums, against the tokenizer."""
    import zlib

    from cadenza.llm import queries

    rows = [(k, " ".join(["river", "stone", "Cloud", "12,5"][j % (k % 4 + 1)] for j in range(k * 37))) for k in range(40)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole, seen = Tokenizer.from_file(PATH), {}
    ids = {k: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in rows}
    for r in queries.op2_pack(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {k: len(x) for k, x in ids.items()}
