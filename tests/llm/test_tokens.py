import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querylode.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PLAIN = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
OURS = {n: Encoder(public_tokenizers.path(n), slots=64, bound=300) for n in NAMES}
for t in PLAIN.values():
    t.encode_special_tokens = True
TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t\n", "\r\n", "\xa0", "　", "\x1c", "\x85", "\x01", "the", "The", "it's", "'re", "été", "é", "́", "İ", "Σ", "ς", "1234", "...", "!!", "<|endoftext|>", "<|startoftext|>", "日本語", "a‍b", "😀", "x" * 90]), max_size=14).map("".join) | st.text(max_size=30)


@pytest.mark.parametrize("name", NAMES)
@given(texts=st.lists(TEXT, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_whole_text(name, texts):
    got = OURS[name].encode([t.encode() for t in texts])
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, OURS[name].dtype).tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids
    assert OURS[name].counts([t.encode() for t in texts]).tolist() == [len(raw) // OURS[name].dtype.itemsize for raw in got]
