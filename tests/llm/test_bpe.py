import hashlib

import public_tokenizers
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.vocabulary(PATH)


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def check(text, theirs, ours):
    told = theirs.encode(text, add_special_tokens=False).ids
    packed = ours.encode(text)
    assert ids(packed) == told, text
    assert ours.decode(packed).decode() == theirs.decode(told, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])) | st.text(alphabet="abehinrst'0 .") | st.text(alphabet="aà ΣσſİßéÉ \x1c\x85​"))
def test_any_text(text):
    check(text, _theirs(), bpe.vocabulary(PATH))


def _theirs(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(PATH))
    return kept[0]


def test_every_token_is_what_its_own_text_gives(ours):
    """The backtracking is exact only if each token comes out of the merges."""
    for whole, (a, b, rank) in ours.halves.items():
        assert ours.merges[a, b] == rank
        assert ours._is_compatible(a, b) is False


def test_documents_and_odd_rows(documents, odd, theirs, ours):
    for r in documents.collect():
        check(r.text or "", theirs, ours)
    for _, text in ODD:
        check(text or "", theirs, ours)


def test_job(odd, none, theirs):
    rows = bpe.encode_texts(odd, PATH, round_trip=True).collect()
    assert len(rows) == len(ODD)
    told = sorted(hashlib.sha256(theirs.decode(theirs.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest() for _, t in ODD)
    assert sorted(hashlib.sha256(r.decoded.encode()).hexdigest() for r in rows) == told
    decoded = bpe.decode_ids(bpe.encode_texts(odd, PATH), PATH).collect()
    assert sorted(r.text for r in decoded) == sorted(r.decoded for r in rows)
    assert bpe.encode_texts(none, PATH).count() == 0
