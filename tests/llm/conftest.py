import public_tokenizers
import pytest

from nightwarden.llm.pieces import read_spec

from .plain import hard_texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def spec():
    return read_spec(VOCABULARY)


@pytest.fixture(scope="session")
def library():
    """The tokenizers library itself."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): hard texts, two rows that are equal, one id with two texts, and null ids."""
    texts = hard_texts()
    out = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    return out + [out[20], (out[21][0], "another text of one id"), (None, "no id here"), (None, texts[22])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those that operators use."""
    schema = "doc_id long, text string, score string, shard string, slot string, kept string, sequence_id string, key string, h1 string"
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
