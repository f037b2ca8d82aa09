"""The words that a task of op3 keeps."""

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tripspark.llm import op3_token_files


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, 0

    def tokenize(self, word):
        self.asked += 1
        return self.model.tokenize(word)


def test_rare_words_are_learnt_once(monkeypatch):
    monkeypatch.setattr(op3_token_files, "WORDS", 40, raising=False)
    encoder = op3_token_files.WordIds(P.path("word_bpe_49k.json"))
    encoder.model = counted = Counted(encoder.library.model)
    words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(120)]
    parts = [" ".join(words[i : i + 30]) for i in range(0, 120, 30)]
    encoder.encode(parts[:1])
    encoder.encode(parts[1:2])
    encoder.encode(parts[:1])  # of the generation before
    assert counted.asked == 60
    for part in parts * 3:
        encoder.encode([part])
        assert len(encoder.memo) + len(encoder.memo.before) <= 2 * (40 + 30)


def test_odd_words_against_the_library():
    path = P.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), op3_token_files.WordIds(path)
    texts = ["", "a\x00b \x7f\x01\x01 c", "naïve ΣΟΦΟΣ straße İx", "x" * 300 + " y " + "x" * 300, "it's 42 日本語 🙂🙂", "<|endoftext|> a", "é ﬁ \x1c\x85z"]
    for _ in range(2):
        got = encoder.encode(texts)
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
