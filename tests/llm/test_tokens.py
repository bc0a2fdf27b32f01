import random

import pytest

from calibra.llm.tokens import Encoder, tokenizer_path

ODD = ["", " ", "   ", "a  b", "a  b\n\n c", " x\u0085 y", "Σας ΣΑΣ İx", "é ́e <|endoftext|> q", "it's I'LL\tdon't\r\n", "\x1c!a\x1d b", "a 　b", "a   b", "日本語 テスト ", "x" * 5000, "foo ́bar", "\ńa", "one two\nThree, four. (five) six;seven"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cut_texts_encode_as_whole_ones(name):
    encode, rnd = Encoder(tokenizer_path(name)), random.Random(5)
    marks = " \n\t\r.,'sLl1é́ \x1c日Ⅷ&;!?%aab"
    for text in ODD + ["".join(rnd.choice(marks) for _ in range(rnd.randint(1, 40))) for _ in range(3000)] + ["".join(rnd.choice("ab, .\né") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]:
        assert encode.ids(text).tobytes() == encode.whole(text), repr(text)
