import numpy as np
import public_tokenizers
import pyarrow as pa
from brute import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from topicmoments.llm.bpe import Fragments, encode_texts, forced_pairs
from topicmoments.llm.common import text_bytes
from topicmoments.llm.merges import MergeTable
from topicmoments.llm.token_counts import PieceCounter, count_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_TABLE, WORD_TABLE = MergeTable.read(BYTE), MergeTable.read(WORD)
FORCED = forced_pairs(BYTE_TABLE.token_bytes)
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
AWKWARD = [
    "", " ", "  a  \tb", " x''s !'s don't we'll I'D <|endoftext|>  <|endoftext|>x <|startoftext|>ab<|endoftext|>'s", "ΑΣ Σ aaaaaaaaaaa",
    "\n\n  foo  bar　 x\x1cy\x85z a\x85 b é c\xa0 d", "日本語テキスト です", "é É İ ǅ", "\r\n a\x0b\x0c b   ", "x \n y",
    "12 345  6", "\0 \0\0 a\0b", "é a ́b", "ab" * 3000, "a" * 5000 + " " * 300 + "b", "été là-bas, naïve façon  où", "<|endoftext|>" * 3,
]
LETTERS = st.text(alphabet=st.sampled_from("ab eé's!'\n\t  <|>endoftext01Σß　日́"), max_size=60)


def own_ids(texts):
    ids, parts = Fragments(BYTE_TABLE, FORCED)(*text_bytes(pa.array(texts, pa.string())))
    out, at = [], 0
    for n in parts:
        out.append(np.frombuffer(b"".join(ids[at:at + n]), dtype=np.int32).tolist())
        at += n
    return out


def own_counts(texts):
    counter = PieceCounter(WORD_TABLE)
    split = [t.encode().split() for t in texts]
    pieces = list(set().union(*split))
    known = dict(zip(pieces, counter.count(pieces).tolist()))
    return [sum(known[p] for p in s) for s in split]


def library(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_awkward_texts_as_the_libraries_do():
    assert own_ids(AWKWARD) == library(BYTE_LIB, AWKWARD)
    assert own_counts(AWKWARD) == [len(x) for x in library(WORD_LIB, AWKWARD)]


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=5))
def test_random_texts_as_the_libraries_do(texts):
    assert own_ids(texts) == library(BYTE_LIB, texts)
    assert own_counts(texts) == [len(x) for x in library(WORD_LIB, texts)]


def test_operators_on_whole_tables(spark):
    rows = [*enumerate(AWKWARD), (3, AWKWARD[3]), (None, "a b"), (900, None)]
    docs = documents(spark, rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"], r["decoded"]) for r in encode_texts(docs, BYTE).collect())
    want = sorted((-1 if i is None else i, ids, BYTE_LIB.decode(ids, skip_special_tokens=False))
                  for (i, t), ids in zip(rows, library(BYTE_LIB, [t or "" for _, t in rows])))
    assert got == want
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, WORD, limit=40).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(ids), len(ids) > 40) for (i, t), ids in zip(rows, library(WORD_LIB, [t or "" for _, t in rows])))
    assert got == want
    assert encode_texts(docs.limit(0), BYTE).count() == 0 and count_tokens(docs.limit(0), WORD).count() == 0
