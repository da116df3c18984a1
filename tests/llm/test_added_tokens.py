import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from frameflow.llm.wordcode import WordEncoder

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
FRESH = {p: (tokenizers.Tokenizer.from_file(p), WordEncoder(p)) for p in PATHS}


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a ", " b", "c\n", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "é", "  "]), max_size=6).map("".join), max_size=5))
def test_added_tokens_encode_as_the_library_does(path, texts):
    fresh, code = FRESH[path]
    got = [np.frombuffer(g, "<u4").tolist() for g in code.encode(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_end_of_text_is_one_id():
    assert np.frombuffer(FRESH[PATHS[0]][1].encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_ids_don_t_depend_on_what_is_remembered():
    import public_tokenizers

    from frameflow.llm.wordcode import WordEncoder

    texts = [" ".join(f"w{(k * j) % 211} zeta{j % 7}, É{k % 5}" for j in range(40)) for k in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        small, whole = WordEncoder(public_tokenizers.path(name), limit=20), WordEncoder(public_tokenizers.path(name))
        for k in range(0, 300, 10):
            assert small.encode(texts[k : k + 10]) == whole.encode(texts[k : k + 10])
        assert len(small) + len(small.older) < len(whole) * 2 and small.older
