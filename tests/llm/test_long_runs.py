"""Texts of very long words and runs of white space: equal to the tokenizers files, and through every operator."""

import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, packing

RUNS = {
    "spaces": " " * 3_000_000 + "x", "only spaces": " " * 1_000_000, "line ends": "\n" * 1_000_000 + "word", "tabs": "a\t" + "\t" * 1_000_000,
    "mixed": " \n" * 500_000 + " b", "no-break": "\xa0" * 300_000 + "x", "special": " " * 20_000 + "<|endoftext|>" + " " * 20_000 + "a" + "\n" * 20_000,
    "not white space to all": "\x1c" * 20_000 + "q" + "\x1c " * 9_000, "letters": "a" * 1_000_000, "digits": "7" * 150_000,
}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", RUNS)
def test_packing_ids(name, tokenizer):
    assert packing.token_ids(RUNS[name]).tolist() == [*tokenizer.encode(RUNS[name], add_special_tokens=False).ids, 1]


def test_packing_ids_about_the_limit(tokenizer):
    for n in range(packing.RUN - 2, packing.RUN + 3):
        for after in ("", "x", "!", "\n", "1", "<|endoftext|>", "é"):
            text = "a" + " " * n + after
            assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_bpe_ids():
    words, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.bpe(public_tokenizers.path("word_bpe_49k.json"))
    for name in ("only spaces", "mixed", "letters", "tabs"):
        ids = words.encode(RUNS[name], add_special_tokens=False).ids
        assert own.encode_block([RUNS[name]]) == [struct.pack(f"<{len(ids)}I", *ids)]


def test_pack_whole_runs(spark, tokenizer):
    rows = list(enumerate(RUNS.values()))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids), hashlib.md5(text.encode()).hexdigest()
