import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from termforge.llm import tokenfst

ORACLE = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def machine():
    with open(tokenfst.VOCABULARY, "rb") as f:
        return tokenfst.Transducer(tokenfst.read_ranks(f.read()))


@pytest.fixture(scope="module")
def oracle():
    tokenizer = Tokenizer.from_file(ORACLE)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_those_of_the_tokenizer(machine, oracle):
    rng = random.Random(3)
    alphabet = "aaeinorst  \n\t'\"-,.0123ABcd§éüßж日本𝒳 　"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["don't we'll I'm they've 'tis o'clock''s", "<|endoftext|> x", "a" * 3000, " " * 1500 + "x", "ab" * 2000, "\r\n\r\n x", "1234567 89", "'s", " 's"]
    assert tokenfst.count_tokens(texts, machine).tolist() == oracle(texts)


def test_chunks_compose_to_the_same_emissions(machine):
    data = np.frombuffer(("internationalization" * 60 + " of the " + "x" * 700).encode(), dtype=np.uint8)
    resets = np.zeros(len(data), dtype=bool)
    resets[[0, 1200, 1203, 1207]] = True
    whole = machine.emissions(data, resets, chunk=len(data))
    for chunk in (1, 2, 7, 64, 512):
        assert (machine.emissions(data, resets, chunk=chunk) == whole).all()


def test_a_full_table_is_compiled_anew(oracle):
    with open(tokenfst.VOCABULARY, "rb") as f:
        small = tokenfst.Transducer(tokenfst.read_ranks(f.read()), most_states=50)
    texts = ["some words to compile", "and others, quite different ones", "some words to compile"]
    assert [int(tokenfst.count_tokens([t], small)[0]) for t in texts] == oracle(texts)


def test_whole_table(spark, sf_dir, oracle):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r["tokens"] for r in tokenfst.op3_token_counts(spark, sf_dir).collect()}
    assert found == dict(zip(docs, oracle(list(docs.values()))))


def test_hard_rows(hard, nothing, hard_rows, oracle):
    found = sorted((r["doc_id"] or 0, r["tokens"]) for r in tokenfst.token_counts(hard).collect())
    texts = [r[1] or "" for r in hard_rows]
    assert found == sorted(zip([r[0] or 0 for r in hard_rows], oracle(texts)))
    assert tokenfst.token_counts(nothing).count() == 0
