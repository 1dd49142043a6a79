import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivulet.llm import queries
from rivulet.llm.packing import SumOfSquares, pack

PATH = queries.tokenizer_path("word_bpe_49k.json")


def check(pieces, docs, window=2048):
    """Every id lies in exactly one piece; sequences are gapless and full, or a power of two."""
    t = Tokenizer.from_file(PATH)
    left = {}
    for doc_id, text in docs:
        left.setdefault(doc_id, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    at = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id or 0, p.start)):
        ids = list(np.frombuffer(p.ids, "<u4"))
        assert any(x[p.start : p.start + p.length] == ids and len(x) == p.doc_tokens for x in left[p.doc_id])
        at[p.doc_id] = at.get(p.doc_id, 0) + p.length
    assert at == {k: sum(map(len, v)) for k, v in left.items()}
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == window or (end < window and end & (end - 1) == 0)


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("window", [8, 64])
def test_small_windows_and_odd_rows(spark, window):
    rows = [(1, "a b  c"), (1, "a b  c"), (2, None), (3, ""), (None, "x y"), (4, "It's\x1cOK ÄÖ é <|endoftext|> 12 " * 40), (5, " \n\t"), (6, "w" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "sequence_id": F.lit(1)})
    check(pack(docs, PATH, window=window, max_open=3).collect(), rows, window)


def test_special_tokens_are_those_of_the_plain_tokenizer():
    from rivulet.llm.packing import WordMemo

    memo, plain = WordMemo(PATH), Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|> a", "x<|endoftext|>Y, z. <|startoftext|>\n<|endoftext|>", "<|endoftext|", "É<|endoftext|>É.", "<|EndOfText|><|endoftext|> A.<|endoftext|>,"]
    for text, ids in zip(texts, memo.encode([t.encode() for t in texts], 1)):
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text
    assert list(next(memo.encode([texts[0].encode()], 1))) == [320, 49407, 321, 1]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_level_choice_is_the_least_sum_of_squares():
    rng, packer = np.random.default_rng(5), SumOfSquares(16, max_open=10**6)
    for k in range(500):
        size = int(rng.integers(1, 16))
        cost = {}
        for h in range(16 - size + 1):
            if h == 0 or packer.levels[h]:
                after = packer.levels.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                cost[h] = int((after**2).sum())
        assert cost[packer.level(size)] == min(cost.values())
        packer.place((k, 0, np.zeros(size, "<u4")))
    assert packer.n_open < 40


def test_query_gives_unsigned_crc(spark, sf):
    got = queries.op9_packing(spark, sf).limit(20).collect()
    ids = {(p.doc_id, p.start): p.ids for p in pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id, r.start]) for r in got)


def test_words_of_letters_skip_splitting_with_the_same_ids():
    from rivulet.llm.packing import WordMemo

    memo = WordMemo(PATH)
    assert memo.direct
    for word in ["The", "ärger", "ÑANDÚ", "µª", "œuvre", "日本", "naïve,", "x1", "don't", "ß.", "..", "é,", "A.", "İstanbul", "ﬁn", "ét"]:
        assert list(np.frombuffer(memo[word.lower().encode() if word.isascii() else word.encode()], "<u4")) == memo._ids(word), word
